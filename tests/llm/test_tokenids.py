"""Token ids in compressed files: the coder's round trips and damage, files against the library, digests against plain code."""

import random
import zlib
from dataclasses import replace

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanternlog.llm import rans
from lanternlog.llm.queries import QUERIES
from lanternlog.llm.tokenids import LibraryIds, given_ids, library_ids, read_ids, write_ids

from .test_tokens import random_texts

JSON = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 255, 256, 257, 1000, 2048, 2049, 9999])
@pytest.mark.parametrize("kind", ["skewed", "even", "one"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"skewed": np.minimum(rng.zipf(1.2, n), 50256), "even": rng.integers(0, 1 << 20, n), "one": np.full(n, 7)}[kind].astype(np.uint32)
    table = rans.Table.of(ids)
    again = rans.Table.from_bytes(table.to_bytes())
    assert (again.ids == table.ids).all() and (again.freqs == table.freqs).all() and (again.freqs > 0).all()
    assert not n or int(table.freqs.sum()) == 1 << rans.BITS
    blocks = rans.encode(ids, table, 1024, 256)
    assert [b.n_ids for b in blocks] == [min(1024, n - i) for i in range(0, n, 1024)]
    got = rans.decode(blocks, again, 256)
    assert np.array_equal(np.concatenate([np.empty(0, np.uint32), *got]), ids)
    for b, x in zip(blocks, got, strict=True):  # a block needs the table, but no other block
        assert np.array_equal(rans.decode([b], again, 256)[0], x)


def test_coder_comes_near_the_entropy_and_sees_damage():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 300_000), 50256).astype(np.uint32)
    table = rans.Table.of(ids)
    blocks = rans.encode(ids, table)
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert sum(len(b.words) for b in blocks) < 1.01 * len(ids) * -(share * np.log2(share)).sum() / 8 + 2000
    for damage in (b"\x00" + blocks[0].words[1:], blocks[0].words[:-4]):
        with pytest.raises(ValueError, match="checksum"):
            rans.decode([replace(blocks[0], words=damage if damage != blocks[0].words else b"\x01" + damage[1:])], table)
    with pytest.raises(ValueError, match="checksum"):
        rans.decode([replace(blocks[0], ids_crc32=blocks[0].ids_crc32 ^ 1)], table)
    with pytest.raises(ValueError, match="below"):
        rans.Table.of(np.array([1 << 20], np.uint32))


def test_checksums_join():
    for a, b in ((b"", b"abc"), (b"abc", b""), (b"hello", b" world" * 1000), (b"\x00" * 70_000, b"\x00")):
        assert rans.join_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_give_the_library_s_ids():
    lib, own = Tokenizer.from_file(JSON), LibraryIds(JSON)
    texts = [*random_texts(), "a  b", "a \n b", "x\n <|endoftext|>  y", " \x1c a", "a \x85 b", "it's 'sabc we'll", "w " * 300, "é é  é", "Q" * 300, "a " + "Q" * 300 + " b", " ", "  ", " a", "a ", "3 4a ! b!c", "\0\0 a'b \0 c", "ªº µm ×÷ ÀÿŁɏ ɐ"]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice("ab1!'\n \t\x1cé") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.by_piece and own.encode(None) == b""
    words = LibraryIds(P.path("word_bpe_49k.json"))
    assert not words.by_piece and np.frombuffer(words.encode("Some text, here"), "<u4").tolist() == words.tokenizer.encode("Some text, here", add_special_tokens=False).ids


def test_files_of_odd_documents(spark, docs, no_docs, tmp_path):
    lib = Tokenizer.from_file(JSON)
    small = dict(run=2048, block=1024, segment=256)
    write_ids(docs, f"{tmp_path}/ids", "doc_id", "text", library_ids(JSON, end=2), **small)
    rows = sorted(read_ids(spark, f"{tmp_path}/ids", segment=256).collect(), key=lambda r: r.start)
    digests = {(r.start, r.n_ids, r.ids_crc32, r.key) for r in read_ids(spark, f"{tmp_path}/ids", digest=True, segment=256).collect()}
    expected = sorted((r.doc_id is not None, r.doc_id or 0, tuple([*lib.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    assert [r.key for r in rows] == [k if known else None for known, k, _ in expected]
    assert sorted((r.key is not None, r.key or 0, tuple(r.ids)) for r in rows) == expected
    at = 0
    for r in rows:  # documents stand one after the other, also those longer than a run
        assert r.start == at and r.n_ids == len(r.ids)
        assert (r.start, r.n_ids, zlib.crc32(np.array(r.ids, "<u4").tobytes()), r.key) in digests
        at += r.n_ids
    assert max(r.n_ids for r in rows) > 4 * 2048
    write_ids(no_docs, f"{tmp_path}/none", "doc_id", "text", library_ids(JSON), **small)
    assert read_ids(spark, f"{tmp_path}/none", segment=256).count() == 0


def test_files_of_given_ids(spark, tmp_path):
    rows = [("b", [5, 6]), ("a", []), ("c", None), ("a", [1] * 700), ("", [(1 << 20) - 1])]
    write_ids(spark.createDataFrame(rows, "name string, tokens array<int>"), f"{tmp_path}/ids", "name", "tokens", given_ids, run=256, block=256, segment=64)
    got = read_ids(spark, f"{tmp_path}/ids", segment=64).collect()
    assert sorted((r.key, list(r.ids)) for r in got) == sorted((k, x or []) for k, x in rows)
    assert [r.start for r in sorted(got, key=lambda r: (r.key, r.start))][-1] == 703


def test_query_against_the_library(spark):
    """The whole of the smallest documents table."""
    sf_dir = "/root/testdata/sf0.001"
    lib, at = Tokenizer.from_file(JSON), 0
    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    df = QUERIES["op13_range_numerals"](spark, sf_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()} == expected
    assert df.where(F.col("doc_id").isNull()).count() == 0


def test_columns_of_texts_give_the_library_s_ids(monkeypatch):
    """Also with little room for words, so that they are passed over and forgotten, and with texts cut into parts."""
    lib, rnd = Tokenizer.from_file(JSON), random.Random(7)
    texts = [None, "", "\n", "a\n", "\na", "one", "One word.\nThen\tanother\x0bone, 3 4.5 x1y.", "schön, ª º µm ÀÿŁɏ ß.", "a\n b", "a \nb", "a\n\nb", "a\r\nb", "x £ ®, y", "<|endoftext|> a", "it's so", "a " + "Q" * 300 + " b", "w " * 300, "漢字 b", "\0 a\x1c b"]
    texts += ["".join(rnd.choice("aB1!é'\n \t") for _ in range(rnd.randrange(30))) for _ in range(1500)]
    texts += [" ".join("".join(rnd.choice("abcé.,1") for _ in range(rnd.randrange(1, 6))) + rnd.choice(["", "", "\nX"]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    rnd.shuffle(texts)
    expected = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most, gathered in ((1_000_000, 1 << 19), (150, 40)):
        monkeypatch.setattr("lanternlog.llm.tokenids.MOST_WORDS", most)
        monkeypatch.setattr("lanternlog.llm.tokenids.GATHERED", gathered)
        own = LibraryIds(JSON)
        for _ in range(2):
            for i in range(0, len(texts), 100):
                assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts[i : i + 100])] == expected[i : i + 100]
        assert len(own.columns.number) <= most and not any(len(w) > 64 for w in own.columns.number)
    assert list(own.encode_all([])) == []
    assert len(list(LibraryIds(JSON).encode_all(["漢字 漢字", " "]))) == 2  # not one word for the columns


def test_new_words_are_encoded_together():
    """A column's new words take the model a call for some thirty of them, and none when they come again."""
    own, calls = LibraryIds(JSON), []

    def counted(tokenize):
        return lambda text: calls.append(text) or tokenize(text)

    own.pieces.tokenize = counted(own.pieces.tokenize)
    if getattr(own, "columns", None):
        own.columns.tokenize = counted(own.columns.tokenize)
    texts = [" ".join(["the", *(f"{a}{b}q." for b in "bcdfgh")]) for a in ["ab" * i + "x" for i in range(1, 200)]]
    ids = lambda: b"".join(own.encode_all(texts) if hasattr(own, "encode_all") else map(own.encode, texts))
    assert np.frombuffer(ids(), "<u4").tolist() == [i for t in texts for i in own.tokenizer.encode(t, add_special_tokens=False).ids]
    assert len(calls) < 6 * 199 / 20
    calls.clear()
    assert ids() and len(calls) < 199


def test_models_that_merge_across_pieces_take_the_other_way(tmp_path):
    import json

    with open(JSON, encoding="utf-8") as f:
        spec = json.load(f)
    at = len(spec["model"]["merges"])
    spec["model"]["merges"].append(["a", "1"])
    spec["model"]["vocab"]["a1"] = max(spec["model"]["vocab"].values()) + 1 if at else 0
    path = tmp_path / "crossing.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    own = LibraryIds(str(path))
    assert LibraryIds(JSON).columns is not None and own.by_piece and own.columns is None
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(["za1 b"])] == [own.tokenizer.encode("za1 b", add_special_tokens=False).ids]
