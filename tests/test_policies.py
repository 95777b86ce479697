"""Write policies against folds over each change in turn."""

import random

from lanternlog.operators import policies as P
from pyspark.sql import functions as F


def test_status_upsert_and_children(spark):
    rnd = random.Random(5)
    stored = [(c, q, "active", 1, None) for c in range(4) for q in range(6) if rnd.random() < 0.6]
    changes = [(rnd.randrange(4), rnd.randrange(6), n, rnd.choice(["active", "completed", "untracked"]), 10 + n) for n in range(1, 60)]
    want = {s[:2]: s[2:] for s in stored}
    for c, q, _, status, at in changes:
        if status == "untracked":
            want.pop((c, q), None)
        else:
            want[c, q] = (status, want.get((c, q), (0, at))[1], at if status == "completed" else None)
    old = spark.createDataFrame(stored, "c long, q long, status string, added_at long, completed_at long")
    new = spark.createDataFrame(changes, "c long, q long, n long, status string, at long")
    got = {(r.c, r.q): (r.status, r.added_at, r.completed_at) for r in P.status_upsert(old, new, ["c", "q"]).collect()}
    assert got == want and got
    gone = {(c, q) for c, q, _, status, _ in changes if status == "untracked"}
    steps = spark.createDataFrame([(c, q, s) for c in range(4) for q in range(6) for s in range(2)], "c long, q long, step long")
    left = {(r.c, r.q) for r in P.without_untracked(steps, new, ["c", "q"]).collect()}
    assert left == {(c, q) for c in range(4) for q in range(6)} - gone


def test_toggles(spark):
    rnd = random.Random(6)
    stored = {k: (done, 1 if done else None) for k in range(20) if rnd.random() < 0.7 for done in [rnd.random() < 0.5]}
    toggles = [(rnd.randrange(24), n, 100 + n) for n in range(40)]
    want = dict(stored)
    for k, _, at in toggles:
        done = not want.get(k, (False, None))[0]
        want[k] = (done, at if done else None)
    old = spark.createDataFrame([(k, *v) for k, v in stored.items()], "k long, done boolean, done_at long")
    got = P.toggle_steps(old, spark.createDataFrame(toggles, "k long, n long, at long"), ["k"])
    assert {r.k: (r.done, r.done_at) for r in got.collect()} == want
    assert P.toggle_steps(old.limit(0), spark.createDataFrame([], "k long, n long, at long"), ["k"]).count() == 0


def test_latest_upsert_keeps_known_values(spark):
    rows = [("a", 1, "imported", "s1", 1), ("a", 2, "error", None, None), ("b", 1, "seen", None, None), ("a", 3, None, None, None), ("b", 2, "imported", "s2", 2)]
    df = spark.createDataFrame(rows, "k string, n long, status string, sha string, at long")
    got = {r.k: (r.status, r.sha, r.at, r.n) for r in P.latest_upsert(df, ["k"], F.col("n"), ["status"], ["sha", "at"], ["n"]).collect()}
    assert got == {"a": (None, "s1", 1, 1), "b": ("imported", "s2", 2, 1)}


def test_override_and_rekey(spark):
    rows = spark.createDataFrame([(1, "active", None), (2, None, None), (3, "completed", 5), (4, None, None)], "k long, status string, completed_at long")
    won = spark.createDataFrame([(3, 9), (4, 8), (4, 7)], "k long, at long")
    got = {r.k: (r.status, r.completed_at, r.source) for r in P.override_status(rows, won, "k").collect()}
    assert got == {1: ("active", None, "manual"), 2: (None, None, None), 3: ("completed", 5, "achievement"), 4: ("completed", 7, "achievement")}
    keys = spark.createDataFrame([(1, "A"), (2, "a"), (3, "B"), (4, "b "), (5, "c")], "id long, k string")
    assert {(r.id, r.k) for r in P.rekey(keys, "k", F.lower(F.trim("k")), "id").collect()} == {(2, "a"), (3, "b"), (5, "c")}


def test_removed_owners_and_containers(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string")
    left = P.without_owners({"t": t}, spark.createDataFrame([(2,), (2,)], "k long"), "k")["t"]
    assert {r.v for r in left.collect()} == {"x", "z"}
    rows = spark.createDataFrame([(1, 2, False), (1, 2, False), (1, 2, False), (2, None, True), (2, None, False), (3, 0, True)], "host long, slots int, is_empty boolean")
    got = {r.host: (r.capacity, r.used, r.free) for r in P.containers(rows, ["host"]).collect()}
    assert got == {1: (2, 3, 0), 2: (2, 1, 1), 3: (1, 0, 1)}


def test_pages_and_children(spark):
    stored = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "id long, name string, v int")
    pages = spark.createDataFrame([(1, "A", 1), (9, "b", 1)], "id long, name string, v int")
    assert {tuple(r) for r in P.upsert_pages(stored, pages, "id", "name").collect()} == {(1, "A", 1), (9, "b", 1), (3, "c", 0)}
    kids = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, t string")
    fresh = spark.createDataFrame([(9, "n")], "id long, t string")
    assert {tuple(r) for r in P.replace_children(kids, fresh, stored, pages, "id", "name").collect()} == {(3, "z"), (9, "n")}


def test_socket_candidates_against_all_pairs(spark):
    rnd = random.Random(7)
    sockets = [(rnd.randrange(3), s, rnd.random() < 0.4) for s in range(70)]
    items = [(rnd.randrange(5), i, rnd.random() < 0.5) for i in range(40)]
    out = P.socket_candidates(spark.createDataFrame(items, "k long, item long, needs_weapon boolean"), spark.createDataFrame(sockets, "k long, seq long, is_weapon boolean"), "k")
    fits = {i: [s for q, s, weapon in sockets if q == k and (weapon or not needs)] for k, i, needs in items}
    assert {r.item: (r.n, r["first"]) for r in out.collect()} == {i: (len(f), f[:12]) for i, f in fits.items()}


def test_due_files(spark):
    from lanternlog.sources.snapshots import due_files

    at = lambda s: F.to_timestamp(F.lit(f"2026-01-01 00:00:{s:02d}"))
    rows = lambda x: spark.createDataFrame(x, "path string, s int, size long, sha256 string").select("path", F.expr("timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("modified"), "size", "sha256")
    files = rows([("new", 1, 5, "a"), ("hot", 9, 5, "a"), ("same", 1, 5, "a"), ("touched", 3, 5, "a"), ("other", 3, 6, "b")])
    seen = rows([("same", 1, 5, "a"), ("touched", 1, 5, "a"), ("other", 1, 5, "a")])
    assert {r.path for r in due_files(files, seen, at(10)).collect()} == {"new", "other"}
