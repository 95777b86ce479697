"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lanternlog.plans.registry import QUERIES, SQL, load

load()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return round(v, 6) if isinstance(v, float) else list(v) if isinstance(v, tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expected = sorted((repr([shown(r[i]) for i in at]) for r in result.fetchall()))
    assert sorted(repr([shown(r[c]) for c in cols]) for r in df.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_event_queries_filter_by_parsed_type(spark, monkeypatch):
    """A line is shown by the query of the type that the grammar gives it, whatever its order's number is."""
    from lanternlog.plans import documents

    lines = [(1, 1, "You have completed achievement: Deed 5"), (2, 1, "You looted 2 Skin 3 from a rat's corpse and sold it for 4 gold and 3 copper."), (3, 1, "You looted a Blade 7 from a rat's corpse to create a Blade 7 +1"), (8, 1, "Someone says, 'You have completed achievement'")]
    rows = spark.createDataFrame([(o, n, 1, f"[Fri Jul 31 18:38:02 2026] {said}") for o, n, said in lines], "l_orderkey long, l_linenumber int, l_partkey long, line string")
    monkeypatch.setattr(documents, "parsed", lambda spark, sf_dir, *wanted: documents.parse_events(rows, "line", *wanted))
    shown = {name: [tuple(r) for r in QUERIES[name](spark, DATA).collect()] for name in ("e7_loot_sold", "e8_loot_merged", "e9_achievement", "e10_craft_error")}
    assert shown == {"e7_loot_sold": [(2, 1, "Skin 3", 2, 403, "a rat")], "e8_loot_merged": [(3, 1, "Blade 7", 1, "Blade 7 +1")], "e9_achievement": [(1, 1, "Deed 5")], "e10_craft_error": []}


def test_allocation_serves_whole_rows_in_order(spark):
    import random

    from lanternlog.operators.allocate import greedy_allocation

    rnd = random.Random(4)
    needs, stock = [], {(p, a): rnd.randrange(12) for p in range(5) for a in range(6)}
    for p in range(5):
        for r in range(40):
            open_ = rnd.random() < 0.8
            needs += [(p, r, rnd.randrange(3) * 0 + r // 3, open_, a, rnd.randrange(1, 4), stock[p, a]) for a in rnd.sample(range(6), rnd.randrange(1, 4))]
    left, want = dict(stock), {}
    for p, pr, r in sorted({(n[0], n[2], n[1]) for n in needs}):
        mine = [n for n in needs if n[:2] == (p, r)]
        want[p, r] = mine[0][3] and all(left[p, n[4]] >= n[5] for n in mine)
        for n in mine if want[p, r] else ():
            left[p, n[4]] -= n[5]
    rows = spark.createDataFrame(needs, "pool long, row long, priority long, open boolean, alias long, want long, have long")
    assert {(r.pool, r.row): r.served for r in greedy_allocation(rows).collect()} == want and any(want.values()) and not all(want.values())


def test_prefixes_match_as_plain_strings(spark):
    from lanternlog.operators.merge import prefix_match

    keys, guides = ["north", "no", "east hall", "west", "south", ""], ["northern ro", "east", "west", "western", "sou", "south gate", "eastern"]
    of = lambda name, x: spark.createDataFrame([(v,) for v in x], f"{name} string")
    got = {r.key: r.guide for r in prefix_match(of("key", keys), of("g", guides), "key", "g").collect()}
    for k in keys:
        near = [g for g in guides if k and (g.startswith(k) or k.startswith(g))]
        assert got[k] == (k if k in guides else near[0] if len(near) == 1 else None), k


@pytest.mark.parametrize("name", ["m5_child_replace", "m5_page_upsert"])
def test_new_page_under_a_stored_number(spark, tmp_path, name):
    """Parts whose numbers lie 1,000,000 apart: a new page gets the number of a stored one, which stays."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT CAST(k + d AS BIGINT) AS p_partkey, 'p' AS p_name, CAST(CASE d WHEN 0 THEN 10 ELSE 10 + 10 * k END AS INT) AS p_size FROM range(4) a(k), (VALUES (0), (1000000)) b(d)")
    con.execute("CREATE TABLE lineitem AS SELECT p_partkey AS l_partkey, 'A' AS l_returnflag FROM part")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())


def test_session_window_at_its_bounds(spark, tmp_path):
    """Gaps of 21600.9 s count as 21600 whole seconds and hold a session together, 21601 part it, and times may run back."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT n AS event_id, make_timestamp(CAST(s * 1000000 AS BIGINT)) AS ts, CAST(u AS BIGINT) AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{"k": 1}' AS props
      FROM (VALUES (1, 1, 0.0), (2, 1, 21600.9), (3, 1, 43201.0), (4, 2, 0.9), (5, 2, 21601.0), (6, 2, 43201.5), (7, 3, 50000.0), (8, 3, 10.0), (9, 3, 21610.0), (10, 3, 50000.0), (11, 3, 80000.0)) v(n, u, s)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    df = QUERIES["t2_session_window"](spark, str(tmp_path))
    expected = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['t2_session_window']})").fetchall())
    assert len(expected) == 7 and sorted(tuple(r) for r in df.collect()) == expected


def test_allocation_streams_a_pool_over_batches(spark):
    """One pool's rows come in several batches, and a task holds what is left of the stock only; missing numbers serve no one."""
    from lanternlog.operators import allocate

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        needs = spark.range(60).selectExpr("CAST(NULL AS LONG) AS pool", "id AS row", "60 - id AS priority", "true AS open", "id % 2 AS alias", "1L AS want", "CASE id % 2 WHEN 0 THEN 20L END AS have")
        out = allocate.greedy_allocation(needs)
        assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.row: r.served for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i % 2 == 0 and i >= 20 for i in range(60)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["d3_effect_line", "d4_item_pages", "d7_quests", "d12_whole_or_bundled", "d13_tooltips", "d14_result_rows"])
def test_texts_are_read_in_tasks_for_all_cores(spark, name):
    """A small file is one task; the texts composed from its rows are dealt to more."""
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= 4
