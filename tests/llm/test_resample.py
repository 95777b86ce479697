"""Importance resampling against plain Python on odd documents, and the query against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from lanternlog.llm import resample as R
from lanternlog.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain(docs, target, share=(5, 100), least=20):
    """(key, n_features, weight, score) of each row, and the drawn ones by rank."""
    s, t = (Counter(bucket(f) for x in side for f in plain_features(x)) for side in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    out = []
    for key, text in docs:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in plain_features(text))
        out.append((key, len(plain_features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text))))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    return out, able[: len(able) * share[0] // share[1]]


def test_features_of_blocks_and_long_texts(monkeypatch):
    rnd = random.Random(5)
    words = ["the", "THE", "a1", "é漢", "x", "Ärger", "z" * 40]
    texts = [None, "", "...", "one", "One two", *(rnd.choice([" ", "-", "\x00", "'"]).join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(60))]
    for most in (7, 50, 1 << 19):
        monkeypatch.setattr(R, "BLOCK_WORDS", most)
        got = list(R.features(texts))
        assert [n for n, _ in got] == [len(plain_words(t)) for t in texts]
        for t, (_, b) in zip(texts, got, strict=True):
            assert sorted(np.frombuffer(b, "<u2").tolist()) == sorted(map(bucket, plain_features(t)))


def test_resampling_odd_documents(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, f"{i} " + "words of a filler text go on and on so that it counts twenty of them and more in all") for i in range(60)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    goal = ["filler text", "ka ra", None, "é漢字"]
    target = spark.createDataFrame([(x, 1) for x in goal], "item string, key int")
    got = R.resample(more, target, "doc_id", "text", "item").collect()
    want, drawn = plain(rows, goal)
    assert Counter((r.key, r.n_features, r.weight, r.score, r.n_words) for r in got) == Counter(want)
    assert [(r.key, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(k, s) for k, _, _, s, _ in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1)) and drawn
    none = spark.createDataFrame([], "item string")
    assert R.resample(docs, none, "doc_id", "text", "item").count() == docs.count()
    assert R.resample(no_docs, target, "doc_id", "text", "item").count() == 0


def test_ties_go_to_the_smaller_key(spark):
    """Gains of equal texts are equal; only the noise parts their keys, and rows of one key share it."""
    text = "same words " * 20
    rows = [(k, text) for k in (5, 3, 3, 9, None)]
    got = R.resample(spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame([(text,)], "t string"), "k", "t", "t", share=(1, 1)).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    order = [(-r.score, r.key or -1) for r in sorted(got, key=lambda r: r["rank"])]
    assert order == sorted(order) and len({r.score for r in got if r.key == 3}) == 1


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_sql_and_plain_code(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES["op12_importance_resampling"](spark, sf_dir)
    got = {tuple(r) for r in df.collect()}
    result = con.execute(SQL["op12_importance_resampling"])
    assert [d[0] for d in result.description] == df.columns
    assert got == set(result.fetchall())
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    want, drawn = plain(rows, [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()])
    rank = {r[0]: i + 1 for i, r in enumerate(drawn)}
    assert got == {(k, n, w, s, rank.get(k), c) for k, n, w, s, c in want}
