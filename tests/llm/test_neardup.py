"""Near-duplicate groups against all pairs, components against a union-find."""

import random
import re

import numpy as np

from lanternlog.llm import neardup, shingles
from lanternlog.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2080)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == groups(real, {n for e in real for n in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_equal_all_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for g in range(6):  # bases with chains of edits, so that some pairs lie on either side of the threshold
        text = [rnd.choice(words) for _ in range(rnd.choice([40, 90, 200]))]
        for _ in range(25):
            texts[len(texts)] = " ".join(text)
            if rnd.random() < 0.5:
                text = list(text)
            for _ in range(rnd.randrange(1, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
    sets = {i: plain_set(t) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = groups(pairs, sets)
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_odd_documents(docs, no_docs):
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].component_id for i in (0, 1, 2, 3)] == [0, 0, 0, 3]
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (4, 5, 6))
    assert (by[7].component_id, by[8].component_id, by[10].component_id) == (7, 7, 9)
    assert sorted((r.component_id is None, r.kept, r.first) for r in rows if r.doc_id is None) == [(False, False, False), (True, True, True)]
    assert {r.doc_id for r in rows if r.component_id == 0 and r.first} == {0}
    assert sum(r.kept for r in rows if r.doc_id == 3) == 3
    assert neardup.near_duplicates(no_docs).count() == 0


def test_blocks_join_what_pivots_miss(spark, monkeypatch):
    """In a bucket with many components, dealt into several blocks, links give the components of all pairs and no more links
    than rows leave a comparison."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows, nodes, sets = [], [], {}
    for i in range(40):
        base = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)) if i % 4 == 0 else np.unique(np.concatenate([sets[i - 1][:290], rng.integers(0, 2**63, 10, dtype=np.uint64)]))
        sets[i] = base
        rows.append((1, i, i if i > 20 else i % 2, len(base)))
        nodes.append((i, len(base), bytearray(shingles.odd_sketch(base))))
    of = lambda schema, data: spark.createDataFrame(data, schema)

    def linked(rows, nodes, sets):
        nodes = of("node long, n long, sketch binary", nodes)
        candidates = neardup.block_candidates(of("key long, node long, component long, n long", rows), nodes, 75)
        return neardup.block_links(candidates, nodes, of("node long, set binary", sets), 75).collect()

    got = linked(rows, nodes, [(i, bytearray(s.tobytes())) for i, s in sets.items()])
    links = {(min(r), max(r)) for r in got}
    assert all(shingles.similar(sets[a], sets[b]) for a, b in links)
    same = [(i, c) for _, i, c, _ in rows]
    start = [(x, y) for x, c in same for y, d in same if x < y and c == d]
    pairs = [(a, b) for a in sets for b in sets if a < b and shingles.similar(sets[a], sets[b])]
    assert groups([*start, *links], sets) == groups([*start, *pairs], sets)
    dense = [(1, i, i, len(sets[0])) for i in range(40)]  # all equal: 780 similar pairs
    monkeypatch.setattr(neardup, "BLOCK", 1024)
    more = linked(dense, [(i, len(sets[0]), nodes[0][2]) for i in range(40)], [(i, bytearray(sets[0].tobytes())) for i in range(40)])
    assert len(more) == 39


def test_repeated_and_missing_keys_lose_no_link(spark):
    rnd = random.Random(8)
    text = lambda: [rnd.choice(WORDS) for _ in range(60)]
    WORDS = [f"v{i}" for i in range(400)]
    a, b, c = text(), text(), text()
    j = " ".join
    rows = [(5, j(a)), (5, j(b)), (6, j([*a, "x"])), (7, j([*b, "x"])), (1, j(["y", *b])), (None, j(c)), (9, j([*c[1:], "q"])), (8, j(["p", *c[:-1]])), (None, j(text())), (5, j(b))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got)
    assert found == sorted([(5, 5), (6, 5), (5, 1), (5, 1), (7, 1), (1, 1), (-1, 8), (9, 8), (8, 8), (-1, -1)])
    assert sorted((r.doc_id, r.component_id) for r in got if r.first and r.doc_id is not None) == [(1, 1), (5, 5), (8, 8)]


def test_recall_over_many_near_pairs(spark):
    """Links at and just above the threshold are all found: 400 pairs of similarity 0.75 to 0.8."""
    rnd = random.Random(12)
    texts, want = [], []
    for i in range(400):
        words = [f"t{i}x{k}" for k in range(104)]  # 100 shingles; 7 words replaced at the end: 93 of 107 or 80 of 100 and so on
        cut = rnd.choice((11, 12, 13, 14))
        texts += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-cut], *(f"u{i}x{k}" for k in range(cut))]))]
        want.append(100 * (100 - cut) >= 75 * (100 + cut))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(400)] == want


def test_sketch_never_refuses_similar_sets():
    rng = np.random.default_rng(1)
    for n in (20, 200, 4000):
        for _ in range(100):
            x = rng.integers(0, 2**63, 2 * n, dtype=np.uint64) * np.uint64(2)
            both = -(-n * 6 // 7)
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:both], x[n : 2 * n - both]]))
            bits = np.bitwise_count(np.frombuffer(shingles.odd_sketch(a), np.uint8) ^ np.frombuffer(shingles.odd_sketch(b), np.uint8)).sum()
            assert shingles.may_reach(np.array([bits]), np.array([n]), np.array([n]), 75)[0]


def test_sketch_never_refuses_short_similar_sets():
    """Slice collisions of 8 to 40 hashes: a pair of similarity 0.75 or more goes on to the full sets."""
    rng = np.random.default_rng(4)
    for both, only_a, only_b in ((6, 1, 1), (9, 3, 0), (12, 2, 2), (30, 5, 5)):
        x = rng.integers(0, 2**63, (10_000, both + only_a + only_b), dtype=np.uint64) * np.uint64(2)
        sketch = lambda rows: np.frombuffer(b"".join(shingles.odd_sketch(np.sort(r)) for r in rows), np.uint64).reshape(len(rows), -1)
        bits = np.bitwise_count(sketch(x[:, : both + only_a]) ^ sketch(np.delete(x, np.s_[both : both + only_a], axis=1))).sum(axis=1)
        size = lambda n: np.full(len(x), both + n)
        assert shingles.may_reach(bits, size(only_a), size(only_b), 75).all()


def test_sketch_still_refuses_short_sets_that_share_little():
    rng = np.random.default_rng(6)
    for n in (10, 40, 400):
        x = rng.integers(0, 2**63, (200, 2 * n - n // 2), dtype=np.uint64) * np.uint64(2)
        for r in x:
            bits = np.bitwise_count(np.frombuffer(shingles.odd_sketch(np.sort(r[:n])), np.uint8) ^ np.frombuffer(shingles.odd_sketch(np.sort(r[n - n // 2 :])), np.uint8)).sum()
            assert not shingles.may_reach(np.array([bits]), np.array([n]), np.array([n]), 75)[0]
