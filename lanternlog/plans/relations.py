"""Queries over the relational tables in the roles of loot, factions, inventory, quests, needs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity as A
from ..operators import allocate as L
from ..operators import merge as M
from ..sources.sinks import export_view
from .inputs import cents, epoch_us, table
from .registry import query

CENTS = "CAST(CAST({} AS DECIMAL(18,2)) * 100 AS BIGINT)"


def loot(spark, sf_dir) -> DataFrame:
    """Loot lines: lineitem with its part (the item) and supplier (the source)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("qty"), epoch_us("l_shipdate").alias("us"))
    part, supp = table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)


LOOT_SQL = "loot AS (SELECT l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, epoch_us(l_shipdate) AS us, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"


@query(f"WITH {LOOT_SQL} SELECT l_partkey, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, min(us) AS first_us, max(us) AS last_us, max(p_name) AS item FROM loot GROUP BY 1")
def a13_loot_by_item(spark, sf_dir):
    return loot(spark, sf_dir).groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("p_name").alias("item"))


@query(f"WITH {LOOT_SQL}, n AS (SELECT l_partkey, s_name, count(*) AS n FROM loot GROUP BY 1, 2) SELECT l_partkey, s_name AS source, n, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, s_name) AS rn FROM n) WHERE rn <= 5")
def w6_top5_sources(spark, sf_dir):
    n = loot(spark, sf_dir).groupBy("l_partkey", F.col("s_name").alias("source")).agg(F.count("*").alias("n"))
    return M.top_per_group(n, ["l_partkey"], [F.col("n").desc(), F.col("source")], 5)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ol') AND NOT starts_with(p_name, 'old')")
def p3_loot_search(spark, sf_dir):
    """Case-insensitive substring search without a prefix."""
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("ol") & ~F.col("p_name").startswith("old")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def j7_semi_items(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(li, "p_partkey", "left_semi").select("p_partkey", "p_name")


# Faction roles: an order moves the standing of its customer by its price in cents mod 401 less 200.
MOVES_SQL = f"moves AS (SELECT o_custkey AS faction, epoch_us(o_orderdate) AS us, o_orderkey, {CENTS.format('o_totalprice')} % 401 - 200 AS delta, o_orderstatus AS status FROM orders)"


def moves(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("faction"), epoch_us("o_orderdate").alias("us"), "o_orderkey", (cents("o_totalprice") % 401 - 200).alias("delta"), F.col("o_orderstatus").alias("status"))


ROLLUP_SQL = f"{MOVES_SQL}, roll AS (SELECT faction, CAST(sum(delta) AS BIGINT) AS net, count(*) AS n, CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS gained, CAST(sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS BIGINT) AS lost, min(us) AS first_us, max(us) AS last_us FROM moves GROUP BY 1)"


def rollup(spark, sf_dir) -> DataFrame:
    d = F.col("delta")
    return moves(spark, sf_dir).groupBy("faction").agg(F.sum(d).alias("net"), F.count("*").alias("n"), F.sum(F.when(d > 0, d).otherwise(0)).alias("gained"), F.sum(F.when(d < 0, -d).otherwise(0)).alias("lost"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query(f"WITH {ROLLUP_SQL} SELECT * FROM roll")
def a6_faction_rollup(spark, sf_dir):
    return rollup(spark, sf_dir)


CAPS_SQL = f"{ROLLUP_SQL}, caps AS (SELECT faction, count(*) AS caps, max(us) AS cap_us FROM moves WHERE status = 'F' GROUP BY 1)"


def caps(spark, sf_dir) -> DataFrame:
    return moves(spark, sf_dir).where("status = 'F'").groupBy("faction").agg(F.count("*").alias("caps"), F.max("us").alias("cap_us"))


@query(f"WITH {CAPS_SQL}, adj AS (SELECT faction, max(us) AS adj_us FROM moves WHERE status <> 'F' GROUP BY 1) SELECT faction, coalesce(cap_us >= adj_us, cap_us IS NOT NULL) AS capped FROM caps FULL JOIN adj USING (faction)")
def w8_last_word_cap(spark, sf_dir):
    """A cap holds only if nothing moved after it."""
    adj = moves(spark, sf_dir).where("status <> 'F'").groupBy("faction").agg(F.max("us").alias("adj_us"))
    return caps(spark, sf_dir).join(adj, "faction", "full").select("faction", F.coalesce(F.col("cap_us") >= F.col("adj_us"), F.col("cap_us").isNotNull()).alias("capped"))


STANDING_SQL = f"{CAPS_SQL}, standing AS (SELECT c_custkey AS faction, {CENTS.format('c_acctbal')} % 4001 - 2000 AS value FROM customer)"


def standings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("faction"), (cents("c_acctbal") % 4001 - 2000).alias("value"))


@query(f"WITH {STANDING_SQL} SELECT faction, net, caps, value, CAST(greatest(-2000, least(2000, coalesce(value, 0) + coalesce(net, 0))) AS BIGINT) AS estimate FROM roll FULL JOIN caps USING (faction) FULL JOIN standing USING (faction)")
def j9_faction_full_outer(spark, sf_dir):
    """Movement, caps and imported standings side by side, and the clamped estimate of now."""
    both = rollup(spark, sf_dir).join(caps(spark, sf_dir), "faction", "full").join(standings(spark, sf_dir), "faction", "full")
    return both.select("faction", "net", "caps", "value", X.clamp(F.coalesce("value", F.lit(0)) + F.coalesce("net", F.lit(0))).cast("long").alias("estimate"))


@query(f"WITH {MOVES_SQL}, mid AS (SELECT (min(us) + max(us)) // 2 AS us FROM moves) SELECT faction, CAST(sum(delta) AS BIGINT) AS net FROM moves WHERE us >= (SELECT us FROM mid) GROUP BY 1")
def j10_since_import(spark, sf_dir):
    m = moves(spark, sf_dir)
    at = m.agg(F.expr("(min(us) + max(us)) div 2").alias("mid"))
    return m.join(F.broadcast(at), F.col("us") >= F.col("mid")).groupBy("faction").agg(F.sum("delta").alias("net"))


BANDS_SQL = "CASE " + " ".join(f"WHEN value >= {f} THEN '{n}'" for f, n in X.STANDING_BANDS) + f" ELSE '{X.STANDING_BANDS[-1][1]}' END"


@query(f"WITH {STANDING_SQL} SELECT faction, value, {BANDS_SQL} AS label FROM standing")
def p15_standing_band(spark, sf_dir):
    return standings(spark, sf_dir).select("faction", "value", X.standing_label(F.col("value")).alias("label"))


@query(f"WITH {MOVES_SQL} SELECT o_orderkey, greatest(-100, least(100, delta)) AS clamped FROM moves")
def f18_est_clamp(spark, sf_dir):
    return moves(spark, sf_dir).select("o_orderkey", X.clamp(F.col("delta"), 100).alias("clamped"))


@query(f"WITH {STANDING_SQL} SELECT count(*) AS factions, CAST(sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN net < 0 THEN 1 ELSE 0 END) AS BIGINT) AS down, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM roll FULL JOIN standing USING (faction)")
def a27_faction_totals(spark, sf_dir):
    both = rollup(spark, sf_dir).join(standings(spark, sf_dir), "faction", "full")
    return both.agg(F.count("*").alias("factions"), F.count_if(F.expr("net > 0")).alias("up"), F.count_if(F.expr("net < 0")).alias("down"), F.count_if(F.expr("value IS NULL")).alias("unknown"))


# Inventory roles: a line item is a row of its order's snapshot; its part is the item.
@query("SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS on_hand FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' GROUP BY 1")
def a10_on_hand(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' AND l_linestatus = 'O'").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("on_hand"))


@query("""WITH craft AS (SELECT p_brand AS skill, p_partkey, p_size, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3)
  SELECT skill, count(*) AS recipes, CAST(sum(n) AS BIGINT) AS combines, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS known,
  (list(p_partkey ORDER BY p_size, p_partkey) FILTER (WHERE p_size <= 20))[1:25] AS craftable FROM craft GROUP BY 1""")
def a12_skill_rollup(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "part").select(F.col("p_brand").alias("skill"), "p_partkey", "p_size").join(n, "p_partkey", "left")
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("p_size") <= 20, F.struct("p_size", "p_partkey")))), lambda x: x.p_partkey), 1, 25)
    return c.groupBy("skill").agg(F.count("*").alias("recipes"), F.coalesce(F.sum("n"), F.lit(0)).alias("combines"), F.count_if(F.expr("n > 0")).alias("known"), F.when(F.size(first) > 0, first).alias("craftable"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_name IS NOT NULL AS in_item_db FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey")
def j1_inventory_items(spark, sf_dir):
    items = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(items, "l_partkey", "left").withColumn("in_item_db", F.col("p_name").isNotNull())


EFFECTS_SQL = "effects AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS effect, p_size AS tier FROM part)"


def effects(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("effect"), F.col("p_size").alias("tier"))


@query(f"WITH {EFFECTS_SQL} SELECT l_orderkey, l_linenumber, effect, tier FROM lineitem JOIN effects ON l_partkey = p_partkey")
def j2_item_effects(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return li.join(effects(spark, sf_dir), "p_partkey").select("l_orderkey", "l_linenumber", "effect", "tier")


@query(f"WITH {EFFECTS_SQL} SELECT l_orderkey, effect, tier, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, effect ORDER BY tier DESC NULLS LAST, l_linenumber) AS n FROM lineitem JOIN effects ON l_partkey = p_partkey) WHERE n = 1")
def a32_best_effect(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p_partkey"))
    return M.top_per_group(li.join(effects(spark, sf_dir), "p_partkey"), ["l_orderkey", "effect"], [F.col("tier").desc_nulls_last(), F.col("line")], 1).select("l_orderkey", "effect", "tier", "line")


@query("SELECT l_orderkey, CAST(sum(p_size) AS BIGINT) AS size_sum, max(p_size) AS haste, CAST(count(p_partkey) AS BIGINT) AS matched, CAST(sum(CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY 1")
def a16_gear_totals(spark, sf_dir):
    """Sums of a stat, the largest of one that doesn't add up, and how many rows are known items."""
    items = table(spark, sf_dir, "part").where("p_size > 5").select("p_partkey", "p_size")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    j = li.join(items, li.l_partkey == items.p_partkey, "left")
    return j.groupBy("l_orderkey").agg(F.sum("p_size").alias("size_sum"), F.max("p_size").alias("haste"), F.count("p_partkey").alias("matched"), F.count_if(F.expr("p_partkey IS NULL")).alias("unmatched"))


# Hierarchy roles: a conversation is a dump; user turns stand at a location, others name the latest such turn's location.
@query("""WITH c AS (SELECT conv_id, turn, role, length(coalesce(text, '')) % 3 AS loc FROM conversations), h AS (SELECT conv_id, turn, loc FROM c WHERE role = 'user')
  SELECT c.conv_id, c.turn, h.turn AS host FROM c ASOF LEFT JOIN h ON c.conv_id = h.conv_id AND c.loc = h.loc AND c.turn > h.turn WHERE c.role <> 'user'""")
def j13_nearest_preceding_host(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.char_length(F.coalesce("text", F.lit(""))) % 3).alias("loc"))
    user = F.col("role") == "user"
    out = A.nearest_preceding_host(c, ["conv_id"], "turn", user, F.col("loc"), F.when(~user, F.col("loc")))
    return out.where(~user).select("conv_id", "turn", "host")


@query("""SELECT l_orderkey, section, CAST(count(*) AS BIGINT) AS used, CAST(10 - count(*) AS BIGINT) AS free FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'shared' WHEN l_returnflag = 'A' THEN 'bank' WHEN l_linestatus = 'O' THEN 'worn' ELSE 'other' END AS section FROM lineitem) GROUP BY 1, 2""")
def a19_containers(spark, sf_dir):
    """Used and free places of each section of a snapshot."""
    return table(spark, sf_dir, "lineitem").withColumn("section", section()).groupBy("l_orderkey", "section").agg(F.count("*").alias("used"), (10 - F.count("*")).alias("free"))


def section():
    """Section of a row; order matters, as in a name that contains another."""
    flag = F.col("l_returnflag")
    return F.when(flag == "R", "shared").when(flag == "A", "bank").when(F.col("l_linestatus") == "O", "worn").otherwise("other")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'shared' WHEN l_returnflag = 'A' THEN 'bank' WHEN l_linestatus = 'O' THEN 'worn' ELSE 'other' END AS section FROM lineitem")
def p12_section(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", section().alias("section"))


@query("""SELECT l_partkey, count(*) AS copies, list_sort(list(DISTINCT CAST(l_quantity AS BIGINT) % 6)) AS tiers, max(CAST(l_quantity AS BIGINT) % 6) AS best, max(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) % 6 END) AS worn FROM lineitem GROUP BY 1""")
def a20_upgrade_ladder(spark, sf_dir):
    tier = F.col("l_quantity").cast("long") % 6
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("copies"), F.array_sort(F.collect_set(tier)).alias("tiers"), F.max(tier).alias("best"), F.max(F.when(F.col("l_returnflag") == "R", tier)).alias("worn"))


@query("""WITH sockets AS (SELECT o_orderkey, o_orderpriority AS kind FROM orders WHERE o_orderstatus = 'O'), kinds AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS kind FROM part),
  best AS (SELECT kind, count(*) AS n, (list(o_orderkey ORDER BY o_orderkey))[1:12] AS first FROM sockets GROUP BY 1) SELECT p_partkey, n AS candidates, first FROM kinds JOIN best USING (kind)""")
def j16_candidates(spark, sf_dir):
    """Places that fit an item, all counted and the first twelve kept: equal needs share one list, so nothing is multiplied."""
    kind = F.element_at(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))), F.col("p_size") % 5 + 1)
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("kind"), "o_orderkey")
    counted = open_.groupBy("kind").agg(F.count("*").alias("candidates"))
    first = M.top_per_group(open_, ["kind"], [F.col("o_orderkey")], 12).groupBy("kind").agg(F.array_sort(F.collect_list("o_orderkey")).alias("first"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind")).join(counted, "kind").join(first, "kind").drop("kind")


# Quest roles: a part is a quest for levels p_size - 5 to p_size + 5 (null for every tenth), its type words are classes.
QUEST_SQL = "quest AS (SELECT p_partkey AS quest, CASE WHEN p_partkey % 10 <> 0 THEN p_size - 5 END AS lo, CASE WHEN p_partkey % 10 <> 1 THEN p_size + 5 END AS hi, CASE WHEN p_partkey % 4 = 0 THEN [] WHEN p_partkey % 4 = 1 THEN ['All'] ELSE string_split(p_type, ' ') END AS classes, p_name, p_brand FROM part)"


def quests(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    classes = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("All"))).otherwise(F.split("p_type", " "))
    return table(spark, sf_dir, "part").select(k.alias("quest"), F.when(k % 10 != 0, F.col("p_size") - 5).alias("lo"), F.when(k % 10 != 1, F.col("p_size") + 5).alias("hi"), classes.alias("classes"), "p_name", "p_brand")


@query(f"WITH {QUEST_SQL} SELECT quest FROM quest WHERE (hi IS NULL OR hi >= 20) AND (lo IS NULL OR lo <= 30)")
def p5_level_overlap(spark, sf_dir):
    """Levels that overlap 20 to 30; a missing bound is open."""
    hi, lo = F.col("hi"), F.col("lo")
    return quests(spark, sf_dir).where((hi.isNull() | (hi >= 20)) & (lo.isNull() | (lo <= 30))).select("quest")


@query(f"WITH {QUEST_SQL} SELECT quest FROM quest WHERE len(classes) = 0 OR list_contains(classes, 'STEEL') OR list_contains(classes, 'All')")
def p6_array_contains(spark, sf_dir):
    c = F.col("classes")
    return quests(spark, sf_dir).where((F.size(c) == 0) | F.array_contains(c, "STEEL") | F.array_contains(c, "All")).select("quest")


@query(f"WITH {QUEST_SQL} SELECT quest FROM quest WHERE coalesce(lo, 25) - 3 <= 25 AND coalesce(hi, 25) + 3 >= 25")
def p8_level_window(spark, sf_dir):
    return quests(spark, sf_dir).where((F.coalesce("lo", F.lit(25)) - 3 <= 25) & (F.coalesce("hi", F.lit(25)) + 3 >= 25)).select("quest")


@query(f"WITH {QUEST_SQL} SELECT q.quest, o.o_orderstatus AS status FROM quest q LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1) o ON o.o_custkey = q.quest")
def j3_progress_left(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("quest")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    return quests(spark, sf_dir).select("quest").join(last, "quest", "left")


@query("SELECT n_name, count(*) AS lines, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1")
def j4_four_way(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("qty"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS steps, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS done FROM orders")
def j6_scalar_counts(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("steps"), F.count_if(F.expr("l_returnflag = 'R'")).alias("done"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").fillna(0, ["steps", "done"])


@query("SELECT l_orderkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a29_listagg(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("brands"))


@query("""WITH names AS (SELECT DISTINCT p_name AS key FROM part), guides AS (SELECT DISTINCT left(p_name, 3 + p_size % 4) AS guide FROM part),
  near AS (SELECT key, min(guide) AS guide, count(*) AS n FROM names JOIN guides ON starts_with(guide, key) OR starts_with(key, guide) GROUP BY 1)
  SELECT n.key, coalesce(g.guide, CASE WHEN x.n = 1 THEN x.guide END) AS guide FROM names n LEFT JOIN guides g ON g.guide = n.key LEFT JOIN near x ON x.key = n.key""")
def j17_prefix_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    guides = part.select(F.expr("left(p_name, 3 + p_size % 4)").alias("guide")).distinct()
    return M.prefix_match(part.select(F.col("p_name").alias("key")).distinct(), guides.withColumnRenamed("guide", "g"), "key", "g")


@query("""WITH brackets AS (SELECT DISTINCT n_regionkey AS region, n_nationkey % 5 * 10 AS floor, max(n_name) OVER (PARTITION BY n_regionkey, n_nationkey % 5) AS rating FROM nation), rows AS (SELECT p_partkey, p_partkey % 5 AS region, p_size AS level FROM part)
  SELECT r.p_partkey, b.rating FROM rows r ASOF LEFT JOIN brackets b ON r.region = b.region AND r.level >= b.floor""")
def j18_floor_rating(spark, sf_dir):
    """Rating of the greatest bracket at or below a level."""
    b = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region"), (F.col("n_nationkey") % 5 * 10).alias("floor")).agg(F.max("n_name").alias("rating"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("region"), F.col("p_size").alias("level"))
    return M.floor_lookup(rows, b, ["region"], "level", "floor", "rating").select("p_partkey", "rating")


# Needs: each part wants p_size of itself under two names, its own key and its next neighbour's; supply is what lines hold.
NEEDS_SQL = "need AS (SELECT p_partkey AS need, p_brand AS class, CAST(p_size AS BIGINT) AS want, unnest([p_partkey, p_partkey + 1]) AS alias, unnest([0, 1]) AS pos FROM part), supply AS (SELECT l_partkey AS alias, CAST(sum(l_quantity) AS BIGINT) % 60 AS have FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), best AS (SELECT need, class, want, arg_max(alias, (coalesce(have, 0), -pos)) AS alias, max(coalesce(have, 0)) AS have FROM need LEFT JOIN supply USING (alias) GROUP BY 1, 2, 3)"


def needs(spark, sf_dir) -> DataFrame:
    aliases = F.posexplode(F.array(F.col("p_partkey"), F.col("p_partkey") + 1)).alias("pos", "alias")
    need = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("need"), F.col("p_brand").alias("class"), F.col("p_size").cast("long").alias("want"), aliases)
    supply = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("alias")).agg((F.sum("l_quantity").cast("long") % 60).alias("have"))
    best = F.max(F.struct(F.coalesce("have", F.lit(0)).alias("have"), (-F.col("pos")).alias("pos"), "alias"))
    return need.join(supply, "alias", "left").groupBy("need", "class", "want").agg(best.alias("b")).select("need", "class", "want", F.col("b.alias").alias("alias"), F.col("b.have").alias("have"))


@query(f"WITH {NEEDS_SQL} SELECT need, alias, have FROM best")
def j19_best_alias(spark, sf_dir):
    """Supply under the best of a need's names, the first of equal ones."""
    return needs(spark, sf_dir).select("need", "alias", "have")


@query(f"WITH {NEEDS_SQL}, demand AS (SELECT alias, CAST(sum(want) AS BIGINT) AS wanted, count(*) AS needs, max(have) AS have FROM best GROUP BY 1) SELECT alias, wanted, needs, have, needs > 1 AS contended, greatest(wanted - have, 0) AS short FROM demand")
def a22_demand_supply(spark, sf_dir):
    d = needs(spark, sf_dir).groupBy("alias").agg(F.sum("want").alias("wanted"), F.count("*").alias("needs"), F.max("have").alias("have"))
    return d.select("alias", "wanted", "needs", "have", (F.col("needs") > 1).alias("contended"), F.greatest(F.col("wanted") - F.col("have"), F.lit(0)).alias("short"))


@query(f"WITH {NEEDS_SQL} SELECT class, count(*) AS total, CAST(sum(CASE WHEN have >= want THEN 1 ELSE 0 END) AS BIGINT) AS ready, 100 * CAST(sum(CASE WHEN have >= want THEN 1 ELSE 0 END) AS BIGINT) // count(*) AS pct FROM best GROUP BY ROLLUP (class)")
def a23_class_pct(spark, sf_dir):
    """Ready needs by class, with the grand total."""
    n = needs(spark, sf_dir).rollup("class").agg(F.count("*").alias("total"), F.count_if(F.expr("have >= want")).alias("ready"))
    return n.select("class", "total", "ready", F.expr("100 * ready div total").alias("pct"))


@query()
def w11_greedy_allocation(spark, sf_dir):
    """Each customer's orders, the dearest first, draw on one stock of the customer: an order is served only if all its lines are
    covered. The stock of a part is half of what the customer's orders want of it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pool"), F.row_number().over(W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("priority"), (F.col("o_orderstatus") != "F").alias("open"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("alias"), "l_quantity")
    want = lines.repartition("o_orderkey").groupBy("o_orderkey", "alias").agg(F.sum("l_quantity").cast("long").alias("want"))
    needs = o.join(want, "o_orderkey").select("pool", F.col("o_orderkey").alias("row"), "priority", "open", "alias", "want").repartition("pool")
    return L.greedy_allocation(needs.withColumn("have", F.expr("sum(want) OVER (PARTITION BY pool, alias) div 2")))


@query("SELECT l_partkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS r FROM lineitem GROUP BY 1")
def a18_copies_by_kind(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return p.select("l_partkey", *(F.coalesce(F.col(k), F.lit(0)).cast("long").alias(k.lower()) for k in "ANR"))


# Achievement roles: customers are definitions; finished orders of the export and of the log say which are earned.
EARNED_SQL = "log AS (SELECT o_custkey AS k, min(epoch_us(o_orderdate)) AS at_us FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), ex AS (SELECT DISTINCT o_custkey AS k, true AS done FROM orders WHERE o_orderpriority = '1-URGENT')"


def earned(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    log = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.min(epoch_us("o_orderdate")).alias("at_us"))
    return log, o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.lit(True).alias("done")).distinct()


@query(f"WITH {EARNED_SQL} SELECT k, at_us, CASE WHEN at_us IS NOT NULL AND done THEN 'both' WHEN at_us IS NOT NULL THEN 'log' ELSE 'export' END AS via FROM log FULL JOIN ex USING (k)")
def j22_full_via(spark, sf_dir):
    log, ex = earned(spark, sf_dir)
    return log.join(ex, "k", "full").select("k", "at_us", F.when(F.col("at_us").isNotNull() & F.col("done"), "both").when(F.col("at_us").isNotNull(), "log").otherwise("export").alias("via"))


@query(f"WITH {EARNED_SQL} SELECT c_custkey AS k, 'defined' AS origin FROM customer WHERE c_acctbal > 0 UNION ALL SELECT k, 'log' FROM log WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j20_union_precedence(spark, sf_dir):
    """Definitions first; the log adds what they lack."""
    log, _ = earned(spark, sf_dir)
    defs = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit("defined").alias("origin"))
    return M.fallback(defs, log.select("k", F.lit("log").alias("origin")), ["k"])


@query(f"WITH {EARNED_SQL} SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN false WHEN done THEN true WHEN at_us IS NOT NULL THEN true WHEN c_custkey % 2 = 0 THEN false END AS state FROM customer LEFT JOIN log ON log.k = c_custkey LEFT JOIN ex ON ex.k = c_custkey")
def t9_tristate_precedence(spark, sf_dir):
    """Manual override, then export, then log, then the definition; else unknown."""
    log, ex = earned(spark, sf_dir)
    k = F.col("k")
    both = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).join(log, "k", "left").join(ex, "k", "left")
    state = M.by_precedence(F.when(k % 11 == 0, False), F.col("done"), F.when(F.col("at_us").isNotNull(), True), F.when(k % 2 == 0, False))
    return both.select("k", state.alias("state"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) % 25 = n_nationkey")
def j21_derived_key(spark, sf_dir):
    """Join on a key that is read out of a text."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.regexp_extract("c_name", "([0-9]+)$", 1).cast("long") % 25).alias("key"))
    return c.join(n, "key").select("c_custkey", "n_name")


@query(f"WITH {EARNED_SQL} SELECT c_mktsegment AS category, count(*) AS total, CAST(count(log.k) AS BIGINT) AS earned FROM customer LEFT JOIN log ON log.k = c_custkey GROUP BY ROLLUP (c_mktsegment)")
def a24_category_rollup(spark, sf_dir):
    log, _ = earned(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("category")).join(log, "k", "left")
    return c.rollup("category").agg(F.count("*").alias("total"), F.count("at_us").alias("earned"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(SMALL|TINY)') THEN 'small' WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'metal' ELSE 'other' END AS category FROM part")
def p13_category(spark, sf_dir):
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(t.rlike("^(SMALL|TINY)"), "small").when(t.rlike("BRASS|COPPER"), "metal").otherwise("other").alias("category"))


# Merges and set operators.
@query("""WITH a AS (SELECT p_partkey AS k, CASE WHEN p_type <> 'SMALL' THEN p_name END AS name FROM part WHERE p_size > 15), b AS (SELECT p_partkey AS k, p_brand AS name, p_type AS url FROM part WHERE p_size < 35)
  SELECT k, coalesce(a.name, b.name) AS name, b.url, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'wiki+tools' WHEN a.k IS NOT NULL THEN 'wiki' ELSE 'tools' END AS origin FROM a FULL JOIN b USING (k)""")
def m4_two_source_merge(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    a = p.where("p_size > 15").select(k.alias("k"), F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("name"))
    b = p.where("p_size < 35").select(k.alias("k"), F.col("p_brand").alias("name"), F.col("p_type").alias("url"))
    return M.two_source_merge(a, b, "k", ["name"], ["url"], ("wiki", "tools"))


@query("SELECT p_partkey AS k, p_size AS cap FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 25 FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def m10_caps_fallback(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return M.fallback(p.where("p_size > 25").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("cap")), p.select(F.col("p_partkey").alias("k"), F.lit(25).alias("cap")), ["k"])


@query("SELECT o_orderkey, rev FROM (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS rev FROM orders) LEFT JOIN (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1000000 + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS old FROM orders WHERE o_orderstatus <> 'O') ON k = o_orderkey WHERE k IS NULL OR old IS DISTINCT FROM rev")
def j24_changed_rows(spark, sf_dir):
    """Rows that are new or whose revision differs from the known one."""
    all_ = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.floor(epoch_us("o_orderdate") / 1000000).cast("long").alias("rev"))
    known = all_.where("o_orderstatus <> 'O'").select("o_orderkey", (F.col("rev") + F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("rev"))
    return M.changed_rows(all_.select("o_orderkey", "rev"), known, "o_orderkey", "rev")


@query("SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def o9_set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.select("k").distinct().join(o.where("o_orderstatus = 'F'").select("k"), "k", "left_anti")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def o10_set_intersection(spark, sf_dir):
    f = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return f.intersect(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS size FROM part ORDER BY size DESC NULLS LAST, p_partkey LIMIT 50")
def o5_nulls_last_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") <= 40, F.col("p_size")).alias("size")).orderBy(F.col("size").desc_nulls_last(), "p_partkey").limit(50)


@query("SELECT o_orderkey AS k, 'stored' AS origin FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'live' FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O'")
def j23_anti_union(spark, sf_dir):
    """Stored rows, and the live ones that are not stored yet."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    stored, live = o.where("o_orderstatus <> 'O'"), o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return M.fallback(stored.select("k", F.lit("stored").alias("origin")), live.select("k", F.lit("live").alias("origin")), ["k"])


@query("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS \"When\", o_orderkey AS \"Order\", CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS \"Done\" FROM orders")
def k10_export_projection(spark, sf_dir):
    """The export view: labels as columns, times as text, flags as yes and no."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("done"))
    return export_view(o, {"ts": "When", "o_orderkey": "Order", "done": "Done"})


@query("""WITH l AS (SELECT p_name, s_name, l_quantity, l_shipdate, p_size > 25 AS known FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
  s AS (SELECT p_name, s_name, count(*) AS n FROM l GROUP BY 1, 2), top AS (SELECT p_name, s_name, n FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, s_name) AS r FROM s) WHERE r = 1)
  SELECT p_name AS "Item", count(*) AS "Drops", CAST(sum(l_quantity) AS BIGINT) AS "Quantity", any_value(top.s_name) AS "Most from", any_value(top.n) AS "Times", strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') AS "First", strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS "Last",
  CASE WHEN bool_or(known) THEN 'yes' ELSE 'no' END AS "In item DB" FROM l JOIN top USING (p_name) GROUP BY 1""")
def k10_loot_view(spark, sf_dir):
    """The loot view: drops of each item with the source that gave most; both counts come from one aggregate by item and source."""
    part, supp = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("item"), (F.col("p_size") > 25).alias("known")), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"))
    by_source = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey).groupBy("item", "s_name").agg(
        F.count("*").alias("n"), F.sum("q").alias("qty"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or("known").alias("known"))
    v = by_source.groupBy("item").agg(F.sum("n").alias("drops"), F.sum("qty").alias("qty"), F.min(F.struct((-F.col("n")).alias("n"), "s_name")).alias("top"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.bool_or("known").alias("known"))
    v = v.withColumn("top_source", F.col("top.s_name")).withColumn("top_n", -F.col("top.n"))
    return export_view(v, {"item": "Item", "drops": "Drops", "qty": "Quantity", "top_source": "Most from", "top_n": "Times", "first_ts": "First", "last_ts": "Last", "known": "In item DB"})


@query(f"WITH {STANDING_SQL} SELECT faction AS \"Faction\", value AS \"Standing (file)\", {BANDS_SQL} AS \"Band\", 2000 - value AS \"To max\", net AS \"Net (log)\", n AS \"Changes\", gained AS \"Gained\", lost AS \"Lost\", CASE WHEN caps IS NULL THEN 'no' ELSE 'yes' END AS \"Capped\" FROM roll FULL JOIN caps USING (faction) FULL JOIN standing USING (faction)")
def k10_factions_view(spark, sf_dir):
    both = rollup(spark, sf_dir).join(caps(spark, sf_dir), "faction", "full").join(standings(spark, sf_dir), "faction", "full")
    v = both.withColumn("label", X.standing_label(F.col("value"))).withColumn("to_max", 2000 - F.col("value")).withColumn("capped", F.col("caps").isNotNull())
    return export_view(v, {"faction": "Faction", "value": "Standing (file)", "label": "Band", "to_max": "To max", "net": "Net (log)", "n": "Changes", "gained": "Gained", "lost": "Lost", "capped": "Capped"})


@query("SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def x4_duplicate_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def w10_latest_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return o.groupBy("c_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")).join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY lower(s_name), s_suppkey) AS seq FROM supplier")
def o4_case_insensitive_rank(spark, sf_dir):
    """Place in a case-insensitive order of a small dimension."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.row_number().over(W.orderBy(F.lower("s_name"), "s_suppkey")).cast("long").alias("seq"))
