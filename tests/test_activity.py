"""Sessions, clocks, links and balances against hand-computed results and plain loops."""

import random

from pyspark.sql import functions as F

from lanternlog.operators import activity as A
from lanternlog.operators import merge as M


def test_gap_boundary_and_time_running_back(spark):
    times = [0, 1800, 3601, 3500, 5299]  # a gap of 1800 stays, 1801 parts, backwards adds nothing
    ev = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], "c string, n int, t long")
    rows = A.gap_sessions(ev, "c", "n", F.col("t")).orderBy("n").collect()
    assert [r.session for r in rows] == [0, 0, 1, 1, 1]
    assert [r.active for r in rows] == [0, 1800, 0, 0, 1799]


def test_zone_clock_credits_the_old_zone(spark):
    ev = spark.createDataFrame([("a", 0, 0, None), ("a", 1, 10, "N"), ("a", 2, 40, None), ("a", 3, 50, "P"), ("a", 4, 60, None)], "c string, n int, t long, z string")
    rows = A.zone_clock(ev, "c", "n", F.col("t"), F.col("z"), F.lit(True)).groupBy("zone_before").agg(F.sum("spent")).collect()
    assert dict(map(tuple, rows)) == {None: 10, "N": 40, "P": 10}


def test_maximum_keeps_the_earliest(spark):
    ev = spark.createDataFrame([(1, 5, "x"), (2, 9, "y"), (3, 9, "z")], "n int, v int, c string")
    best = ev.agg(A.max_with_context(F.col("v"), F.col("n"), F.col("c")).alias("b")).first().b
    assert (best.amount, -best.before, best.c) == (9, 2, "y")


def test_craft_links_match_a_loop(spark):
    rnd, rows = random.Random(3), []
    t = 0
    for n in range(600):
        t += rnd.choice([0, 0, 1, 2, -1])
        rows.append(("a" if n % 2 else "b", n, t, rnd.choice("cns"), f"i{rnd.randrange(3)}", f"s{rnd.randrange(3)}"))
    ev = spark.createDataFrame(rows, "c string, n int, t long, k string, item string, skill string")
    got = {r.n: (r.capped, r.voter, r.voted_item) for r in A.craft_links(ev, "c", "n", "t", F.col("k") == "c", F.col("k") == "n", F.col("k") == "s").collect()}
    expected = {}
    for who in "ab":
        cap = last = wait = None
        for c, n, t, k, item, skill in rows:
            if c != who:
                continue
            out = (None, None, None)
            if k == "n":
                cap = t
            elif k == "s":
                if last and 0 <= t - last[1] <= 1:
                    out = (None, None, last[0])
                else:
                    wait = (skill, t)
            else:
                out = (cap is not None and 0 <= t - cap <= 1, wait[0] if wait and 0 <= t - wait[1] <= 1 else None, None)
                last, cap, wait = (item, t), None, None
            expected[n] = out
    assert got == expected


def test_depot_matches_a_loop(spark):
    rnd, rows = random.Random(4), []
    for n in range(500):
        kind = rnd.choice(["dep", "wd", "wd", "use"])
        rows.append((rnd.randrange(3), n, kind, rnd.randrange(9), None if rnd.random() < 0.2 else rnd.randrange(20)))
    ev = spark.createDataFrame(rows, "item int, n int, k string, q int, l int")
    is_ = lambda k: F.col("k") == k
    got = {r.n: r.estimate for r in A.depot_estimate(ev, ["item"], "n", F.when(is_("dep"), F.col("q")), F.when(is_("wd"), F.col("q")), F.col("l"), is_("use")).collect()}
    est, expected = {}, {}
    for item, n, kind, q, left in rows:
        if kind == "use":
            est[item] = left
        elif est.get(item) is not None:
            est[item] = est[item] + q if kind == "dep" else max(0, est[item] - q)
        expected[n] = est.get(item)
    assert got == expected


def test_nearest_host(spark):
    rows = [("f", 0, "Ring", None), ("f", 1, None, "Ring"), ("f", 2, "Ring", None), ("f", 3, None, "Ring"), ("f", 4, None, "Neck")]
    ev = spark.createDataFrame(rows, "p string, seq long, at string, of string")
    got = A.nearest_preceding_host(ev, ["p"], "seq", F.col("at").isNotNull(), F.col("at"), F.col("of")).orderBy("seq").collect()
    assert [r.host for r in got] == [None, 0, None, 2, None]


def test_merges(spark):
    a = spark.createDataFrame([("x", "n", None), ("y", None, 1)], "k string, name string, v int")
    b = spark.createDataFrame([("y", "m", 5, "u"), ("z", "o", 6, "w")], "k string, name string, v int, url string")
    got = {r.k: tuple(r)[1:] for r in M.two_source_merge(a, b, "k", ["name", "v"], ["url"], ("p", "q")).collect()}
    assert got == {"x": ("n", None, None, "p"), "y": ("m", 1, "u", "p+q"), "z": ("o", 6, "w", "q")}
    rows = spark.createDataFrame([("north ro",), ("ro",), ("east x",)], "key string")
    guides = spark.createDataFrame([("north",), ("ro",), ("east x one",), ("east x two",)], "g string")
    assert {r.key: r.guide for r in M.prefix_match(rows, guides, "key", "g").collect()} == {"north ro": "north", "ro": "ro", "east x": None}
    assert M.first_wins(spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "k int, o int, v string"), ["k"], ["o"]).first().v == "a"
