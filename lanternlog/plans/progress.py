"""Queries on progress: write policies, step and recipe joins, recent lists, searches and flags over the relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge as M
from ..operators import policies as P
from ..sources import snapshots as N
from ..sources.sinks import export_named
from .inputs import EVENTS_SQL, epoch_us, events, spread, table
from .registry import query
from .relations import STANDING_SQL, rollup, standings

# Roles: a customer's orders are changes of one quest in the order of their dates; finished ones are what is stored.
CHANGES_SQL = """ch AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, epoch_us(o_orderdate) AS us,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'untracked' WHEN '2-HIGH' THEN 'completed' ELSE 'active' END AS status FROM orders WHERE o_orderstatus <> 'F'),
  st AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)) AS us FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


def changes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored first times, and the changes that follow."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", epoch_us("o_orderdate").alias("us"))
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "untracked").when(p == "2-HIGH", "completed").otherwise("active")
    n = F.row_number().over(W.partitionBy("k").orderBy("o_orderdate", "o_orderkey"))
    return o.where("o_orderstatus = 'F'").groupBy("k").agg(F.min("us").alias("us")), o.where("o_orderstatus <> 'F'").select("k", n.alias("n"), status.alias("status"), "us")


@query(f"""WITH {CHANGES_SQL}, al AS (SELECT k, 0 AS n, 'active' AS status, us FROM st UNION ALL SELECT k, n, status, us FROM ch),
  cut AS (SELECT *, max(CASE WHEN status = 'untracked' THEN n END) OVER (PARTITION BY k) AS c FROM al)
  SELECT k, arg_max(status, n) AS status, arg_min(us, n) AS added_us, CASE WHEN arg_max(status, n) = 'completed' THEN arg_max(us, n) END AS completed_us FROM cut WHERE c IS NULL OR n > c GROUP BY 1""")
def m1_status_upsert(spark, sf_dir):
    st, ch = changes(spark, sf_dir)
    stored = st.select("k", F.lit("active").alias("status"), F.col("us").alias("added_at"), F.lit(None).cast("long").alias("completed_at"))
    return P.status_upsert(stored, ch.withColumnRenamed("us", "at"), ["k"]).withColumnsRenamed({"added_at": "added_us", "completed_at": "completed_us"})


@query(f"WITH {CHANGES_SQL} SELECT o_custkey AS k, o_orderkey AS step FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT k FROM ch WHERE status = 'untracked')")
def m1_untracked_children(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("step"))
    return P.without_untracked(steps, changes(spark, sf_dir)[1], ["k"])


@query("""WITH s AS (SELECT l_orderkey AS quest, l_partkey AS step, max(epoch_us(l_shipdate)) AS us FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
  t AS (SELECT l_orderkey AS quest, l_partkey AS step, count(*) AS flips, max(epoch_us(l_shipdate)) AS at_us FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
  SELECT quest, step, (us IS NOT NULL) <> (coalesce(flips, 0) % 2 = 1) AS done, CASE WHEN flips IS NULL THEN us WHEN (us IS NOT NULL) <> (flips % 2 = 1) THEN at_us END AS done_us FROM s FULL JOIN t USING (quest, step)""")
def m2_step_toggle(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quest"), F.col("l_partkey").alias("step"), "l_returnflag", epoch_us("l_shipdate").alias("at"))
    stored = li.where("l_returnflag = 'R'").groupBy("quest", "step").agg(F.lit(True).alias("done"), F.max("at").alias("done_at"))
    return P.toggle_steps(stored, li.where("l_returnflag <> 'R'").withColumn("n", F.col("at")), ["quest", "step"]).withColumnRenamed("done_at", "done_us")


@query("""SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(CASE WHEN o_orderpriority <> '5-LOW' THEN sha256(CAST(o_orderkey AS VARCHAR)) END, (o_orderdate, o_orderkey)) AS sha,
  arg_max(CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) END, (o_orderdate, o_orderkey)) AS imported_us, min(epoch_us(o_orderdate)) AS created_us FROM orders GROUP BY 1""")
def m7_export_status(spark, sf_dir):
    """The latest status of a file; its checksum and time of import outlive changes without one (characters keep paths alike, M8)."""
    us = epoch_us("o_orderdate")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"), us.alias("created_us"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("sha"), F.when(F.col("o_orderstatus") == "F", us).alias("imported_us"))
    return P.latest_upsert(o, ["k"], F.col("at"), ["status"], ["sha", "imported_us"], ["created_us"])


@query("""WITH e AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)) AS us FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1)
  SELECT c_custkey AS k, CASE WHEN us IS NOT NULL THEN 'completed' WHEN c_acctbal > 0 THEN 'active' END AS status, us AS completed_us, CASE WHEN us IS NOT NULL THEN 'achievement' WHEN c_acctbal > 0 THEN 'manual' END AS source FROM customer LEFT JOIN e ON k = c_custkey""")
def m9_achievement_override(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, "active").alias("status"), F.lit(None).cast("long").alias("completed_at"))
    won = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), epoch_us("o_orderdate").alias("at"))
    return P.override_status(rows, won, "k").withColumnRenamed("completed_at", "completed_us")


VARIANT = "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' +3') WHEN 2 THEN upper(p_name) ELSE concat(p_name, '*') END"


@query(f"""WITH v AS (SELECT p_partkey, {VARIANT} AS k, p_name AS normal FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY normal ORDER BY CASE WHEN k = normal THEN 0 ELSE 1 END, p_partkey) AS n FROM v)
  SELECT p_partkey, normal AS k FROM r WHERE k = normal OR n = 1""")
def d19_rekey(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(VARIANT).alias("k"))
    return P.rekey(rows, "k", X.normalize_name(F.col("k")), "p_partkey")


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL
  SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)""")
def k7_remove_owners(spark, sf_dir):
    """What is left of each table without its removed owners."""
    c, o = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey")), table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    left = P.without_owners({"customer": c, "orders": o}, c.where("c_acctbal < 0"), "k")
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in left.items()))


# Inventory roles: an order is a bag at a place given by its priority; its lines are the bag's rows.
PLACE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'SharedBank2-Slot4' WHEN '2-HIGH' THEN 'Bank7' WHEN '3-MEDIUM' THEN 'General1-Slot3' WHEN '4-NOT SPECIFIED' THEN 'Equipment' ELSE 'Personal-Depot' END"
SECTION_SQL = "CASE WHEN o_orderstatus = 'P' THEN 'worn' WHEN o_orderpriority = '1-URGENT' THEN 'shared' WHEN o_orderpriority = '2-HIGH' THEN 'bank' WHEN o_orderpriority = '3-MEDIUM' THEN 'bags' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'lists' ELSE 'depot' END"


@query(f"SELECT o_orderkey, {SECTION_SQL} AS section FROM orders")
def p12_root_section(spark, sf_dir):
    root = X.location_root(F.expr(PLACE_SQL))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.section(root, F.col("o_orderstatus") == "P").alias("section"))


@query("""SELECT o_orderkey AS host, CAST(cap AS BIGINT) AS capacity, used, greatest(CAST(cap AS BIGINT) - used, 0) AS free FROM (
  SELECT o_orderkey, CASE WHEN max(o_orderpriority) = '1-URGENT' THEN count(*) ELSE 4 END AS cap, CAST(sum(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) AS BIGINT) AS used FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""")
def a19_host_containers(spark, sf_dir):
    """Capacity of each bag, by its slots or else by its rows, and what is used and free."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("host"), F.when(F.col("o_orderpriority") != "1-URGENT", 4).alias("slots"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("host"), (F.col("l_returnflag") == "A").alias("is_empty"))
    return P.containers(li.join(o, "host"), ["host"])


# Dump roles: an order is a character's file, whose bag holds the order's lines; what tells a bag from an item with sockets varies.
DUMP_ROOT = "CASE o_orderkey % 4 WHEN 0 THEN 'General 1' WHEN 1 THEN 'Bank 7' WHEN 2 THEN 'SharedBank 2' ELSE 'Charm' END"
DUMP_SLOTS = "CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 8 END"
DUMP_SQL = f"""hosts AS (SELECT o_orderkey AS host, {DUMP_ROOT} AS root, {DUMP_SLOTS} AS slots, count(*) AS shown, CAST(sum(CASE WHEN l_returnflag <> 'A' THEN 1 ELSE 0 END) AS BIGINT) AS used, bool_or(l_linenumber BETWEEN 3 AND 6) AS places FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
bags AS (SELECT host, CASE root WHEN 'General 1' THEN 'bags' WHEN 'Bank 7' THEN 'bank' WHEN 'SharedBank 2' THEN 'shared' ELSE 'worn' END AS section, CAST(CASE WHEN slots > 0 THEN slots ELSE shown END AS BIGINT) AS capacity, used FROM hosts WHERE slots = 8 OR places)"""


def dumps(spark, sf_dir):
    """Lines of an inventory dump for each order: a header, the bag, its places, and a section of keys with a header of its own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(DUMP_ROOT).alias("root"), F.expr(DUMP_SLOTS).alias("slots"))
    row = lambda n, said: F.struct(F.lit(n).cast("long").alias("line_no"), F.expr(said).alias("line"))
    heads = o.select("o_orderkey", F.explode(F.array(row(0, r"'Location\tName\tID\tCount\tSlots'"), row(1, r"concat(root, '\tBag +', o_orderkey % 5, '\t', o_orderkey, '\t1\t', slots)"), row(100_000, r"'KeyRing\tName\tID'"), row(100_001, r"concat('KeyRing\tKey\t', o_orderkey)"), row(100_002, r"'KeyRing\tNo key\tnone'"))).alias("r"))
    name = "CASE l_returnflag WHEN 'A' THEN 'Empty' WHEN 'N' THEN 'Gem (Exaltation)' ELSE 'Old Ring +2' END"
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    inner = table(spark, sf_dir, "lineitem").withColumn("nth", nth).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.struct((F.col("nth") + 1).cast("long").alias("line_no"), F.expr(rf"concat(root, '-Slot', l_linenumber, '\t', {name}, '\t', l_partkey, '\t', l_linenumber, '\t0')").alias("line")).alias("r"))
    return heads.union(inner).select(F.col("o_orderkey").cast("string").alias("path"), "r.*")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) + 1 AS seq, CAST(1 AS BIGINT) AS parent_seq, l_linenumber AS sub_slot, CASE l_returnflag WHEN 'A' THEN 'empty' WHEN 'N' THEN 'gem' ELSE 'old ring' END AS name_norm, CAST(l_linenumber AS BIGINT) AS count, l_returnflag = 'A' AS is_empty, l_returnflag = 'N' AS is_exaltation,
  CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS upgrade_tier, o_orderkey % 4 = 3 AS is_equipped, o_orderkey % 3 = 2 OR bool_or(l_linenumber BETWEEN 3 AND 6) OVER (PARTITION BY l_orderkey) AS parent_is_container FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def s7_inventory_places(spark, sf_dir):
    """Places inside a host out of dump lines, with their flags and whether the host is a bag by the evidence."""
    items = N.inventory_rows(dumps(spark, sf_dir)).where("parent_seq IS NOT NULL")
    return items.select("path", "seq", "parent_seq", "sub_slot", "name_norm", "count", "is_empty", "is_exaltation", "upgrade_tier", "is_equipped", "parent_is_container")


@query(f"""SELECT concat({DUMP_ROOT}, '-Slot', l_linenumber) AS "Location", CASE l_returnflag WHEN 'A' THEN 'Empty' WHEN 'N' THEN 'Gem (Exaltation)' ELSE 'Old Ring +2' END AS "Item", CAST(l_linenumber AS BIGINT) AS "Count", l_partkey AS "ID", CASE o_orderkey % 4 WHEN 0 THEN 'bags' WHEN 1 THEN 'bank' WHEN 2 THEN 'shared' ELSE 'worn' END AS "Section",
  'Bag +' || (o_orderkey % 5) AS "In / on", CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS "Tier", CASE WHEN l_returnflag = 'N' THEN 'yes' ELSE 'no' END AS "Exaltation", CASE WHEN o_orderkey % 4 = 3 THEN 'yes' ELSE 'no' END AS "Worn", CASE WHEN l_returnflag = 'N' THEN 'yes' ELSE 'no' END AS "In item DB" FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def k10_inventory_view(spark, sf_dir):
    """The view of what stands inside hosts, with the host's name, under its labels."""
    inside = N.inventory_rows(dumps(spark, sf_dir)).where("parent_seq IS NOT NULL")
    shown = inside.withColumns({"section": X.section(F.col("root"), F.col("is_equipped")), "in_item_db": F.col("name_norm").isin("gem")})
    return export_named(shown, "inventory")


@query(f"WITH {DUMP_SQL} SELECT section, count(*) AS containers, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(sum(used) AS BIGINT) AS used, CAST(sum(greatest(capacity - used, 0)) AS BIGINT) AS free FROM bags GROUP BY 1")
def a19_section_space(spark, sf_dir):
    """Capacity, used and free places of all bags by section."""
    return N.section_space(N.containers(N.inventory_rows(dumps(spark, sf_dir))))


DEED = "CASE p_size % 8 WHEN 0 THEN concat('Level ', p_size) WHEN 1 THEN concat('reach level ', p_size, ' now') WHEN 2 THEN concat(p_brand, ' Traveler') WHEN 3 THEN concat('Hunter of ', p_name) WHEN 4 THEN concat(p_name, '’s Combat Proficiency, Level ', p_size) WHEN 5 THEN concat('Baking (', p_size, ')') WHEN 6 THEN concat('Explorer of ', p_name) ELSE p_name END"


@query("SELECT p_partkey, ['Level', 'Level', 'Traveler', 'Hunter', 'Proficiency', 'Tradeskill', 'Explorer', 'Other'][p_size % 8 + 1] AS kind FROM part")
def p13_achievement_kind(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.achievement_kind(F.expr(DEED)).alias("kind"))


UNLOCK = "CASE p_size % 3 WHEN 0 THEN concat('Primary  Class Unlock — Shadowknight', p_name) WHEN 1 THEN concat('Primary ', p_name) ELSE concat('Oak–', upper(p_name), '’s') END"


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'class unlock - shadow knight' || p_name WHEN 1 THEN 'primary ' || p_name ELSE 'oak-' || p_name || 's' END AS key, 'get ' || p_name || '''s rune' AS req, CASE WHEN p_size < 25 THEN 'Shadow Knight' ELSE p_name END AS class FROM part")
def f5_match_keys(spark, sf_dir):
    req, name = F.expr("concat(' Get  ', upper(p_name), '’s rune. ')"), F.expr("CASE WHEN p_size < 25 THEN ' ShadowKnight ' ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", X.match_key(F.expr(UNLOCK)).alias("key"), X.requirement_key(req).alias("req"), X.class_name(name).alias("class"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Jewelry Making' WHEN 1 THEN 'Baking' WHEN 2 THEN NULL ELSE p_name END AS skill FROM part")
def f8_skill_token(spark, sf_dir):
    token = F.expr("CASE p_size % 4 WHEN 0 THEN ' JewelCrafting' WHEN 1 THEN 'bAKING' WHEN 2 THEN '' ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", X.skill_from_token(token, ("Baking", "Brewing")).alias("skill"))


@query("SELECT p_partkey, 'https://example.org/' || replace(p_name, ' ', '_') || '_(%C3%A9%2F' || replace(p_brand, '#', '%23') || ')' AS url FROM part")
def f13_title_url(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.title_url(F.expr("concat(' ', p_name, ' (é/', p_brand, ') ')"), "https://example.org").alias("url"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'foe,hero' ELSE 'foe,player 2' END AS actors FROM orders")
def f24_rename_actor(spark, sf_dir):
    """The key `player` of a meter gets the character's name."""
    actor = F.when(F.col("o_orderstatus") == "F", "player").otherwise("player 2")
    named = F.transform_keys(F.create_map(actor, F.lit(1), F.lit("foe"), F.lit(2)), lambda k, v: F.when(k == "player", "hero").otherwise(k))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(F.map_keys(named)), ",").alias("actors"))


@query("SELECT p_partkey, to_json({'name': p_name, 'size': p_size, 'reqs': [p_brand, p_type]}) AS context FROM part")
def f27_struct_json(spark, sf_dir):
    context = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("reqs")))
    return table(spark, sf_dir, "part").select("p_partkey", context.alias("context"))


@query("SELECT event_id, CAST((epoch_us(ts) + 500000) // 1000000 AS VARCHAR) || '|' || event_type AS key FROM events")
def f28_fight_key(spark, sf_dir):
    """Start rounded to seconds and name: the same fight from two sources has one key."""
    start = F.expr("(us + 500000) div 1000000").cast("string")
    return table(spark, sf_dir, "events").select("event_id", "event_type", epoch_us("ts").alias("us")).select("event_id", F.concat_ws("|", start, "event_type").alias("key"))


EFFECT = "concat(CASE p_size % 6 WHEN 0 THEN 'Focus Effect: ' WHEN 5 THEN 'Skill: ' ELSE 'Effect : ' END, '[[', p_brand, ' IV|', p_name, ' IV]]', CASE p_size % 6 WHEN 1 THEN ' (Combat, Casting Time: Instant) at Level 46' WHEN 2 THEN ' (Must Equip. Casting Time: 3)' WHEN 3 THEN ' (Casting Time: 3.0)' ELSE ' at level 20' END)"


@query("SELECT p_partkey, ['focus', 'proc', 'worn', 'click', 'worn', NULL][p_size % 6 + 1] AS type, CASE WHEN p_size % 6 <> 5 THEN p_name || ' IV' END AS name, CASE WHEN p_size % 6 <> 5 THEN p_name END AS family, CASE WHEN p_size % 6 <> 5 THEN 4 END AS tier FROM part")
def d3_effect_line(spark, sf_dir):
    return spread(table(spark, sf_dir, "part")).select("p_partkey", X.effect_line(F.expr(EFFECT)).alias("e")).select("p_partkey", "e.*")


# Filters, flags and sorts.
@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def p4_in_list(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'old') OR lower(p_type) = 'brass' OR len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'idg'))) > 0")
def p7_any_case_search(spark, sf_dir):
    """Search in any case over a name, a kind by equality, and the elements of a list."""
    hit = F.lower("p_name").contains("old") | (F.lower("p_type") == "brass") | F.exists(F.split("p_name", " "), lambda x: F.lower(x).contains("idg"))
    return table(spark, sf_dir, "part").where(hit).select("p_partkey")


@query(f"WITH {STANDING_SQL} SELECT faction FROM roll FULL JOIN standing USING (faction) WHERE net <> 0 OR value <> 0")
def p9_moved_or_standing(spark, sf_dir):
    return rollup(spark, sf_dir).join(standings(spark, sf_dir), "faction", "full").where("net <> 0 OR value <> 0").select("faction")


@query("""WITH k AS (SELECT l_returnflag AS file, l_partkey FROM lineitem WHERE l_quantity > 30), f AS (SELECT unnest(['A', 'R', 'missing']) AS file)
  SELECT p_partkey, file, CASE WHEN file IN (SELECT file FROM k) THEN (file, p_partkey) IN (SELECT file, l_partkey FROM k) END AS known FROM part, f""")
def p11_known_or_unknown(spark, sf_dir):
    """Whether a part is in each of three files; null where no such file exists at all."""
    k = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_returnflag").alias("file"), F.col("l_partkey").alias("p_partkey")).distinct()
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*map(F.lit, ("A", "R", "missing")))).alias("file"))
    found = rows.join(k.withColumn("_hit", F.lit(True)), ["file", "p_partkey"], "left").join(k.select("file").distinct().withColumn("_any", F.lit(True)), "file", "left")
    return found.select("p_partkey", "file", F.when(F.col("_any"), F.coalesce("_hit", F.lit(False))).alias("known"))


@query("SELECT c_custkey, bool_or(o_orderkey IS NOT NULL) AS has_log, coalesce(bool_or(o_orderstatus = 'F'), false) AS has_dump, NOT (bool_or(o_orderkey IS NOT NULL)) AS needs_setup FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def p16_needs_setup(spark, sf_dir):
    """A character is ready with a log or a dump."""
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit(True).alias("has_log"), F.bool_or(F.col("o_orderstatus") == "F").alias("has_dump"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(have, "c_custkey", "left").fillna(False, ["has_log", "has_dump"])
    return c.withColumn("needs_setup", ~(F.col("has_log") | F.col("has_dump")))


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, CASE WHEN p_size <= 40 THEN p_size END AS p_size FROM part) ORDER BY p_size IS NULL DESC, p_partkey LIMIT 40")
def o2_null_flag_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("p_size")).orderBy(F.col("p_size").isNull().desc(), "p_partkey").limit(40)


@query("SELECT p_partkey FROM part ORDER BY coalesce(CASE WHEN p_size <= 40 THEN p_size END, -1) DESC, p_name, p_partkey LIMIT 60")
def o3_null_as_least_sort(spark, sf_dir):
    size = F.coalesce(F.when(F.col("p_size") <= 40, F.col("p_size")), F.lit(-1))
    return table(spark, sf_dir, "part").orderBy(size.desc(), "p_name", "p_partkey").limit(60).select("p_partkey")


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def o8_key_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT page_id, kind FROM (SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'item' WHEN contains(url, '/de/') THEN 'zone' ELSE 'other' END AS kind FROM pages) ORDER BY CASE kind WHEN 'zone' THEN 0 WHEN 'item' THEN 1 ELSE 2 END, page_id LIMIT 30")
def o11_kind_priority(spark, sf_dir):
    kind = F.when(F.col("url").contains("/en/"), "item").when(F.col("url").contains("/de/"), "zone").otherwise("other")
    first = F.array_position(F.array(F.lit("zone"), F.lit("item"), F.lit("other")), F.col("kind"))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind")).orderBy(first, "page_id").limit(30)


@query("WITH pins AS (SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_regionkey, n_nationkey FROM nation) SELECT c_custkey, coalesce(CASE WHEN r <= 2 THEN r END, 99) AS rank FROM customer JOIN pins ON n_nationkey = c_nationkey")
def w12_pin_rank(spark, sf_dir):
    """Place of a row's pin; rows without one come after all pins."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("long").alias("r"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(n.where("r <= 2"), "c_nationkey", "left")
    return c.select("c_custkey", F.coalesce("r", F.lit(99).cast("long")).alias("rank"))


# Joins and aggregates of steps, recipes and merges.
@query("SELECT o_orderkey, l_linenumber, l_partkey, coalesce(done, false) AS done FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_linenumber, l_partkey FROM lineitem) LEFT JOIN (SELECT DISTINCT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, true AS done FROM lineitem WHERE l_returnflag = 'R') ON a = o_orderkey AND b = l_linenumber AND c = l_partkey")
def j5_step_progress(spark, sf_dir):
    keys = ["o_orderkey", "l_linenumber", "l_partkey"]
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag")
    done = li.where("l_returnflag = 'R'").select(*keys).distinct().withColumn("done", F.lit(True))
    return li.select(*keys).distinct().join(done, keys, "left").fillna(False, ["done"])


@query("SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey")
def j8_progress_quests(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(c, "o_custkey").drop("o_custkey")


@query("""WITH cap AS (SELECT p_brand, max(p_size) AS cap FROM part WHERE p_type = 'SMALL' GROUP BY 1), v AS (SELECT l_partkey, l_returnflag AS skill, count(*) AS votes FROM lineitem GROUP BY 1, 2),
  best AS (SELECT l_partkey, skill FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, skill) AS n FROM v) WHERE n = 1)
  SELECT p_partkey, cap, skill FROM part LEFT JOIN cap USING (p_brand) LEFT JOIN best ON l_partkey = p_partkey""")
def j11_recipe_skill(spark, sf_dir):
    """Each recipe with its brand's cap and the skill that most lines vote for."""
    p = table(spark, sf_dir, "part")
    cap = p.where("p_type = 'SMALL'").groupBy("p_brand").agg(F.max("p_size").alias("cap"))
    votes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("skill")).agg(F.count("*").alias("votes"))
    best = M.top_per_group(votes, ["p_partkey"], [F.col("votes").desc(), F.col("skill")], 1).select("p_partkey", "skill")
    return p.select("p_partkey", "p_brand").join(cap, "p_brand", "left").join(best, "p_partkey", "left").select("p_partkey", "cap", "skill")


@query("""WITH made AS (SELECT lower(p_name) AS norm, arg_min(p_partkey, (p_size, p_partkey)) AS oldest FROM part WHERE p_size > 10 GROUP BY 1)
  SELECT p_partkey, oldest FROM part LEFT JOIN made ON norm = p_name""")
def j12_known_combines(spark, sf_dir):
    """Known recipes with the oldest combine of the same normalised name."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", X.normalize_name(F.concat(F.upper("p_name"), F.lit(" +2"))).alias("norm"))
    made = p.where("p_size > 10").groupBy("norm").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("oldest"))
    return p.join(made, "norm", "left").select("p_partkey", "oldest")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j25_exists_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi")
    return c.join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("SELECT l_partkey, count(*) AS merges, max(CAST(l_quantity AS BIGINT)) AS best, max(epoch_us(l_shipdate)) AS last_us FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def a21_merge_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey", F.col("l_quantity").cast("long").alias("q"), epoch_us("l_shipdate").alias("us"))
    return li.groupBy("l_partkey").agg(F.count("*").alias("merges"), F.max("q").alias("best"), F.max("us").alias("last_us"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey LIMIT 60")
def a21_recent_merges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").orderBy(F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(60).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT conv_id, list(role ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def a30_ordered_unique(spark, sf_dir):
    """Distinct values in the order in which they first occur, combined before the shuffle."""
    firsts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return firsts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r")).select("conv_id", F.col("r.role").alias("roles"))


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_type, event_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM ev) WHERE rn <= CASE event_type WHEN 'purchase' THEN 15 WHEN 'view' THEN 10 ELSE 5 END")
def a33_recent_lists(spark, sf_dir):
    """The latest lines of each kind: 15 of loot, 10 of zones, 5 of others."""
    most = F.when(F.col("event_type") == "purchase", 15).when(F.col("event_type") == "view", 10).otherwise(5)
    rows = M.top_per_group(events(spark, sf_dir).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id").desc()], 15)
    return rows.where(F.col("rank") <= most)


@query("""SELECT p_name AS title, CASE WHEN bool_or(p_type = 'SMALL') THEN 'quest' WHEN bool_or(p_size > 25) THEN 'item' ELSE 'guide' END AS kind FROM part WHERE p_type = 'SMALL' OR p_size > 25 OR p_type = 'BRASS' GROUP BY 1""")
def s20_worklist(spark, sf_dir):
    """Pages to fetch: a page of several kinds is a quest before it is an item or a guide."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_name", "title")
    return N.worklist(("quest", p.where("p_type = 'SMALL'")), ("item", p.where("p_size > 25")), ("guide", p.where("p_type = 'BRASS'")))


@query("""WITH s AS (SELECT c_name AS name, c_mktsegment AS server, 0 AS src FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT upper(c_name), c_mktsegment, 1 FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_name, lower(c_mktsegment), 2 FROM customer WHERE c_acctbal < 7000)
  SELECT arg_min(name, src) AS name, arg_min(server, src) AS server, list_sort(list(DISTINCT src)) AS has FROM s GROUP BY lower(name), lower(server)""")
def s16_candidates(spark, sf_dir):
    """Characters by settings, logs and exports in that order, with the sources that know each."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("server"), "c_acctbal")
    logs, exports = c.where("c_acctbal > 0").withColumn("name", F.upper("name")), c.where("c_acctbal < 7000").withColumn("server", F.lower("server"))
    return N.candidate_characters(c.where("c_acctbal > 5000"), logs, exports)


# Page roles: parts are stored quests; the batch gives parts of a kind new sizes, and takes over names under a new key.
PAGES_SQL = """st AS (SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS name, p_size AS size FROM part),
  pg AS (SELECT id, name, size + 100 AS size FROM st WHERE size > 30 UNION ALL SELECT id + 1000000, name, size FROM st WHERE size < 15)"""


def pages_batch(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stored pages and the batch, under keys that tell new pages from stored ones: a new page's number may be that of a stored one."""
    key = lambda new: F.struct(F.lit(new).alias("new"), F.col("p_partkey").alias("id")).alias("key")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("p_size").alias("size"))
    st = parts.select(key(False), "name", "size")
    return st, st.where("size > 30").withColumn("size", F.col("size") + 100).union(parts.where("size < 15").select(key(True), "name", "size"))


def page_id() -> Column:
    """The number that is shown for a page's key."""
    return F.when(F.col("key.new"), F.col("key.id") + 1000000).otherwise(F.col("key.id")).alias("id")


@query(f"WITH {PAGES_SQL} SELECT * FROM pg UNION ALL SELECT * FROM st WHERE size BETWEEN 15 AND 30")
def m5_page_upsert(spark, sf_dir):
    return P.upsert_pages(*pages_batch(spark, sf_dir), "key", "name").select(page_id(), "name", "size")


@query(f"WITH {PAGES_SQL} SELECT id, 'fresh' AS step FROM pg UNION ALL SELECT l_partkey, l_returnflag FROM lineitem JOIN st ON id = l_partkey WHERE size BETWEEN 15 AND 30")
def m5_child_replace(spark, sf_dir):
    st, pg = pages_batch(spark, sf_dir)
    steps = table(spark, sf_dir, "lineitem").select(F.struct(F.lit(False).alias("new"), F.col("l_partkey").alias("id")).alias("key"), F.col("l_returnflag").alias("step"))
    return P.replace_children(steps, pg.select("key", F.lit("fresh").alias("step")), st, pg, "key", "name").select(page_id(), "step")


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS seq, o_orderpriority = '2-HIGH' AS weapon FROM orders WHERE o_orderstatus <> 'P'),
  i AS (SELECT o_custkey AS k, o_orderkey AS item, o_orderpriority = '1-URGENT' AS needs FROM orders)
  SELECT item, count(seq) AS n, coalesce((list(seq ORDER BY seq) FILTER (WHERE seq IS NOT NULL))[1:12], []) AS first FROM i LEFT JOIN s ON i.k = s.k AND (weapon OR NOT needs) GROUP BY 1""")
def j16_socket_candidates(spark, sf_dir):
    """Open sockets that fit each item of a character: weapons only for one that needs a weapon."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    sockets = o.where("o_orderstatus <> 'P'").select("k", F.col("o_orderkey").alias("seq"), (F.col("o_orderpriority") == "2-HIGH").alias("is_weapon"))
    items = o.select("k", F.col("o_orderkey").alias("item"), (F.col("o_orderpriority") == "1-URGENT").alias("needs_weapon"))
    return P.socket_candidates(items, sockets, "k").select("item", "n", "first")


@query("""SELECT l_orderkey, count(p_partkey) AS matched, count(*) - count(p_partkey) AS unmatched, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS any_slot,
  concat_ws('; ', CASE WHEN count(*) > count(p_partkey) THEN (count(*) - count(p_partkey)) || ' worn without data' END, CASE WHEN bool_or(l_linestatus = 'O') THEN sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) || ' in any slot taken as worn' END, 'base stats only') AS caveats
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY 1""")
def a17_match_caveats(spark, sf_dir):
    """How far a snapshot's totals can be trusted, in numbers and words."""
    known = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("hit"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus").join(known, "l_partkey", "left")
    n = li.groupBy("l_orderkey").agg(F.count("hit").alias("matched"), F.count_if(F.expr("hit IS NULL")).alias("unmatched"), F.count_if(F.expr("l_linestatus = 'O'")).alias("any_slot"))
    told = lambda c, words: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(words)))
    return n.withColumn("caveats", F.concat_ws("; ", told("unmatched", " worn without data"), told("any_slot", " in any slot taken as worn"), F.lit("base stats only")))
