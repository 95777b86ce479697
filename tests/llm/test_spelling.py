"""Spelling variants: tries against all pairs, both ways of dealing words, the query against its SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lanternlog.llm import spelling as S
from lanternlog.llm.queries import QUERIES, SQL


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    """(word, form, root, n, n_near, form_n) by comparing all pairs."""
    out, forms = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], counts[forms[w]] if forms[w] is not None else None))
    return rows


def vocabulary(seed, n):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 10))) for _ in range(n)} | {"x" * 3000, "x" * 2999, "x" * 2998, "x" * 1500 + "y" + "x" * 1499, "a" * 7, "a" * 8, "ab" * 4, "ba" * 4}
    return {w: rnd.choice([2, 3, 20, 30, 200, 300, 5000]) for w in sorted(words)}


def test_tries_find_each_neighbour_once():
    for seed, n in ((0, 0), (1, 1), (2, 40), (3, 600)):
        words = sorted(vocabulary(seed, n))
        trie = S.Trie(words, [1] * len(words))
        for w in [*words, "", "a", "aab", "éa"]:
            got = [words[i] for i in trie.near(w)]
            assert sorted(got) == [x for x in words if one_apart(w, x)], w
    assert S.Trie([], []).near("word") == [] and S.Trie(["", "a"], [1, 1]).near("a") == [0]


@pytest.mark.parametrize("most", [S.MOST_WORDS, 0])
def test_variants_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(S, "SHARD_WORDS", 40)  # many shards; halves with several tries
    counts = vocabulary(7, 500)
    rows = spark.createDataFrame([(w, n, "key", 1) for w, n in counts.items()] + [(None, 5, "k", 0)], "word string, n long, half string, m int").repartition(3)
    want = plain(counts)
    assert {tuple(r) for r in S.variants(rows, most_words=most).collect()} == want
    assert any(r[1] and r[2] != r[1] for r in want) and max(r[4] for r in want) > 5
    assert S.variants(rows.where("false"), most_words=most).count() == 0


def plain_words(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def test_words_of_odd_documents(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    more = [(100 + i, "Straßen ÀÉÎõü×÷ bigwords, bigwörds: " + "LETTERS" * 3 + " seven_letters sevenletters") for i in range(80)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string")
    words = S.counted_words(df, "doc_id", "text")
    assert {r.word: r.n for r in words.collect()} == plain_words(rows + more)
    assert S.counted_words(no_docs, "doc_id", "text").count() == 0


def test_query_against_sql_and_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = QUERIES["op11_spelling_variants"](spark, sf_dir)
    got = {tuple(r) for r in df.collect()}
    result = con.execute(SQL["op11_spelling_variants"])
    assert [d[0] for d in result.description] == df.columns
    assert got == set(result.fetchall())
    counts = plain_words(con.execute("SELECT doc_id, text FROM documents").fetchall())
    assert {(r[0], r[3]) for r in got} == set(counts.items())
    sample = {w: n for w, n in counts.items() if len(w) in (12, 13)}  # neighbours of words of 13 characters may have 14
    near = {r[0]: r[4] for r in got}
    assert all(near[w] == sum(one_apart(w, x) for x in counts if abs(len(x) - len(w)) < 2) for w in list(sample)[:300])
