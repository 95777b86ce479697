"""Token counts, encoding and decoding against the libraries, on odd documents and random strings."""

import base64
import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanternlog.llm.bpe import codec, decode_ids, encode_texts
from lanternlog.llm.tokencount import count_tokens, transducer

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "é", "1", "23", "!", "<|endoftext|>", "漢", "😀", "Hello", "the", "ing", "\u00a0", "\x1c", "\x85", "====", "ՠ", "Ⅰ", "'ve", "'S", "\x00", "zzzz", "tion"]


def random_texts(n=1500):
    rnd = random.Random(9)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(50))) for _ in range(n)] + ["", " " * 700, "a" * 900, "=" * 1300]


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    texts, lib = random_texts(), Tokenizer.from_file(JSON)
    assert transducer(JSON).count(texts).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library_and_round_trip():
    texts, lib = random_texts(), library()
    got = codec(RANKS).encode(texts)
    assert [x.tolist() for x in got] == [lib.encode_ordinary(t) for t in texts]
    assert codec(RANKS).decode(got) == [t.encode() for t in texts]


def test_odd_documents(docs, no_docs):
    lib, tok = library(), Tokenizer.from_file(JSON)
    both = decode_ids(encode_texts(count_tokens(docs, "text", JSON), "text", RANKS), "ids", RANKS).select("text", "n_tokens", "ids", "decoded").collect()
    assert len(both) == docs.count()
    for r in both:
        text = r.text or ""
        assert r.n_tokens == len(tok.encode(text, add_special_tokens=False).ids)
        assert list(r.ids) == lib.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert count_tokens(no_docs, "text", JSON).count() == encode_texts(no_docs, "text", RANKS).count() == 0


def test_decoding_nulls(spark):
    df = spark.sql("select cast(null as array<int>) ids union all select array(64, 999999)")
    assert sorted(bytes(r.decoded) for r in decode_ids(df, "ids", RANKS).collect()) == sorted([b"", bytes(codec(RANKS).decode([[64]])[0])])
    assert df.select(F.size("ids")).count() == 2


def long_pieces():
    rnd = random.Random(12)
    letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    dna = "".join(rnd.choice("ACGT") for _ in range(30_000))
    coded = base64.b64encode(rnd.randbytes(1_500_000)).decode()
    return {"letters": letters, "dna": dna, "run": "x" * 70_000, "marks": "=-" * 20_000, "wide": "漢字é" * 3000, "mixed": "the" * 400 + letters[:3000] + "x" * 4000 + dna[:3000], "edge": letters[:2049], "base64": coded}


def test_long_pieces_are_cut_and_joined():
    """Words without a space: chunks contract side by side, and give what the libraries give for the whole."""
    import resource
    import time

    lib, tok, own, counts = library(), Tokenizer.from_file(JSON), codec(RANKS), transducer(JSON)
    began, before = time.monotonic(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for name, text in long_pieces().items():
        want = lib.encode_ordinary(text)
        if name != "base64":
            assert own.encode([text])[0].tolist() == want, name
        assert counts.count([text, text[:5000]]).tolist() == [len(want), len(tok.encode(text[:5000], add_special_tokens=False).ids)], name
    assert time.monotonic() - began < 240 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1200


def test_many_states_are_forgotten_within_a_block(monkeypatch):
    from lanternlog.llm import tokencount

    monkeypatch.setattr(tokencount, "MOST_STATES", 300)
    text = long_pieces()["letters"][:20_000]
    small = tokencount.Transducer(JSON)
    assert small.count([text, text[:3000] + " " + text[3000:4000]]).tolist() == [len(Tokenizer.from_file(JSON).encode(t, add_special_tokens=False).ids) for t in (text, text[:3000] + " " + text[3000:4000])]
    assert len(small.keys) < 3000
