"""Queries over texts and pages, and the scalar functions over names, coins, levels and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages, wiki
from ..functions import text as X
from ..sources.log import FIELDS, keep_members, parse_events
from .inputs import cents, spread, table
from .registry import query


@query("SELECT doc_id, CAST(t.pos AS BIGINT) AS pos, t.line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)) t")
def d17_br_split(spark, sf_dir):
    """Lines of each document, trimmed, without empty ones."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.split_br_lines(F.col("text")))).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("line"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, max(length(line)) AS longest FROM l GROUP BY 1")
def d5_sections(spark, sf_dir):
    """Line sections of each document with their sizes."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return l.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.max(F.char_length("line").cast("long")).alias("longest"))


LINKED = "concat('a [[', p_name, '|', p_type, ']] b [[File:', p_name, '.png]] [[ ', p_brand, ' ]][[', p_name, '#part|]] [[open [[', CASE WHEN p_size > 25 THEN p_type ELSE p_name END, ']] [[a[b]] [[', p_brand)"


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN [p_name, p_brand, p_name || '#part', p_type] ELSE [p_name, p_brand, p_name || '#part'] END AS links FROM part")
def d15_links(spark, sf_dir):
    """Link targets of each page in order, once each and with their parts, without those in a namespace or unclosed."""
    return parts(spark, sf_dir).select("p_partkey", X.extract_links(F.expr(LINKED)).alias("links"))


MARKED = "concat('<!-- a > b --> ', '[[', p_name, '|]] [[', p_brand, '| <b>', p_type, '</b> ]]&nbsp;', chr(39), chr(39), chr(39), 'x', chr(39), chr(39), chr(39), ' {{era|', p_size, '}} i <3 you <br/>[[', p_name, '#part]] [[open')"


@query("SELECT p_partkey, p_name || ' ' || p_type || ' x i <3 you ' || p_name || '#part [[open' AS said FROM part")
def f12_strip_markup(spark, sf_dir):
    """Plain text of marked-up text."""
    return parts(spark, sf_dir).select("p_partkey", X.strip_markup(F.expr(MARKED)).alias("said"))


ITEM = """concat('Lead {{', CASE WHEN p_type = 'SMALL' THEN 'Page' ELSE 'Itempage' END, '|itemname=[[', p_brand, '|', p_name, ']]|lucy_img_id=img', p_size, '.png|notes=of [[A|b]] {{c|d=e}}|statsblock=MAGIC ITEM  NO DROP<br>Slot: HEAD<br>',
  CASE WHEN p_size > 25 THEN concat('AC: ', p_size, ' STR: +', p_size + 1, ' SV FIRE: -', p_size, '<br>') ELSE 'Haste: +36%<br>' END, 'WT: 2.5 Size: MEDIUM<br>Effect: ', p_name, ' IV (Combat)<br>Odd line|relatedquests=[[', p_type, ']]|focus_effect=', p_name, ' II}} end')"""


@query("""SELECT p_partkey, p_name AS name, p_size AS icon, 'of [[A|b]] {{c|d=e}}' AS notes, [p_type] AS quests, 'MAGIC ITEM,NO DROP' AS flags, 'HEAD' AS slot, CASE WHEN p_size > 25 THEN p_size END AS ac, CASE WHEN p_size > 25 THEN p_size + 1 END AS str, CASE WHEN p_size > 25 THEN -p_size END AS fire,
  CASE WHEN p_size <= 25 THEN 36 END AS haste, 'MEDIUM' AS size, 'proc ' || p_name || ' 4,focus ' || p_name || ' 2' AS effects, 'Odd line' AS misc FROM part WHERE p_type <> 'SMALL'""")
def d4_item_pages(spark, sf_dir):
    """Items out of pages that embed the item template, with their stats block and effects; other pages go."""
    items = wiki.item_pages(parts(spark, sf_dir).select("p_partkey", F.expr(ITEM).alias("text")), "text")
    told = F.transform("effects", lambda e: F.concat_ws(" ", e.type, e.family, e.tier))
    return items.select("p_partkey", "name", "icon", "notes", "quests", F.array_join("stats.flags", ",").alias("flags"), "stats.slot", "stats.ac", F.col("stats.stats")["STR"].alias("str"), F.col("stats.resists")["FIRE"].alias("fire"), "stats.haste", "stats.size", F.array_join(told, ",").alias("effects"), F.array_join("stats.misc", ",").alias("misc"))


TABLED = "concat('lead\\n{| class=x\\n! Name !! style=w | Size\\n|-\\n| ', p_name, ' || ', p_size, '\\n|-\\n| [[', p_type, '|t=u]]\\n| ', p_brand, CASE WHEN p_size > 25 THEN '\\n|}\\n{|\\n| a=b| last\\n|}' ELSE '' END)"


@query("""SELECT p_partkey, CAST(0 AS BIGINT) AS nth, 'Name,Size' AS headers, p_name || ',' || p_size || ';[[' || p_type || '|t=u]],' || p_brand AS rows FROM part
  UNION ALL SELECT p_partkey, 1, '', 'last' FROM part WHERE p_size > 25""")
def d6_wikitables(spark, sf_dir):
    """Headers and rows of each table of a page."""
    t = parts(spark, sf_dir).select("p_partkey", F.posexplode(wiki.wikitables(F.expr(TABLED))).alias("nth", "t"))
    rows = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";")
    return t.select("p_partkey", F.col("nth").cast("long").alias("nth"), F.array_join("t.headers", ",").alias("headers"), rows.alias("rows"))


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS lines, len(regexp_extract_all(html, '<li>')) AS drops FROM pages")
def d13_html_items(spark, sf_dir):
    """Title, lines and list entries of an item page."""
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), n("<p>").alias("lines"), n("<li>").alias("drops"))


#: The same page under addresses of every kind, and the kind that each has.
ADDRESSES = (("/items/{}", "item"), ("/items/a/{}/", "item"), ("/items/gear/", "index"), ("/items/", None), ("/zones/{}?x=/items/a/", "zone"), ("/bis-gear", "bis"), ("/best/{}", None), ("/worn-effects/#{}", "category"), ("/item/{}", None), ("/", None))


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {i} THEN {repr(k) if k else 'NULL'}" for i, (_, k) in enumerate(ADDRESSES)) + " END AS kind FROM pages")
def p14_url_class(spark, sf_dir):
    """Kind of each page, its own path put under every form of address."""
    path = "CASE page_id % 10 " + " ".join(f"WHEN {i} THEN replace('{a}', '{{}}', 'p' || page_id)" for i, (a, _) in enumerate(ADDRESSES)) + " END"
    url = F.concat(F.regexp_extract("url", "^[^:]+://[^/?#]+", 0), F.expr(path))
    return table(spark, sf_dir, "pages").select("page_id", X.classify_url(url).alias("kind"))


NAME = "'  ' || p_name || '`s  Ring' || CASE WHEN p_partkey % 3 = 0 THEN ' +' || (p_partkey % 7) WHEN p_partkey % 3 = 1 THEN ' (Exaltation)' ELSE '*' END"


def parts(spark, sf_dir):
    """Parts whose texts are composed and read, in tasks enough for all cores."""
    return spread(table(spark, sf_dir, "part"))


@query(f"SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({NAME}), ' \\(Exaltation\\)$', ''), '\\s*\\+[0-9]+$', ''), '[''’`]', '', 'g'), '\\*+$', ''), '\\s+', ' ', 'g'))) AS norm FROM part")
def f1_normalize_name(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", X.normalize_name(F.expr(NAME)).alias("norm"))


ZONE = "n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' - Group 2 (Hard)' WHEN n_nationkey % 3 = 1 THEN ' 4 (Easy)' ELSE '' END"


@query(f"SELECT n_nationkey, trim(regexp_replace({ZONE}, '\\s+(- Group\\s+)?[0-9]+\\s+\\([A-Za-z]+\\)$', '')) AS base FROM nation")
def f2_zone_base(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.zone_base(F.expr(ZONE)).alias("base"))


@query("SELECT n_nationkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim('The ' || n_name || ' *')), '\\s*\\*$', ''), '[''’`]', '', 'g'), '^the ', '')) AS key, starts_with(lower('An Area of ' || n_name), 'an area ') AS pseudo FROM nation")
def f4_zone_key(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.zone_key(F.concat(F.lit("The "), "n_name", F.lit(" *"))).alias("key"), X.is_pseudo_zone(F.concat(F.lit("An Area of "), "n_name")).alias("pseudo"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' #' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def f6_slug(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", X.slug(F.concat("p_type", F.lit(" #"), "p_name", F.lit("!"))).alias("slug"))


@query("SELECT p_partkey, p_brand AS family, CASE WHEN p_size % 11 < 10 THEN p_size % 11 + 1 END AS tier FROM part")
def f7_roman_tier(spark, sf_dir):
    """Family and tier of an effect name that ends in a Roman numeral."""
    numeral = F.element_at(F.array(*map(F.lit, (*X.ROMAN, ""))), F.col("p_size") % 11 + 1)
    name = F.trim(F.concat("p_brand", F.lit(" "), numeral))
    return parts(spark, sf_dir).select("p_partkey", X.effect_family(name).alias("family"), X.effect_tier(name).alias("tier"))


#: Texts that tell levels a and b, and what each tells.
LEVELS = (("{a}-{b}", "a", "b"), ("Level {a} to {b} (raid)", "a", "b"), ("{a}", "a", "a"), ("from {a} + ({b})", "a", None), ("any", None, None), ("Level {a}, {b}", "a", "a"), ("{a} -{b}", "a", "b"))


@query("SELECT p_partkey, " + ", ".join(f"CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {x[k].replace('a', 'p_size').replace('b', 'p_size + 5') if x[k] else 'NULL'}" for i, x in enumerate(LEVELS)) + f" END AS {name}" for k, name in ((1, "lo"), (2, "hi"))) + " FROM part")
def f10_level_range(spark, sf_dir):
    """Levels out of texts that hold them anywhere, or don't."""
    said = lambda t: "'" + t.replace("{a}", "' || p_size || '").replace("{b}", "' || (p_size + 5) || '") + "'"
    s = F.expr("CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {said(t)}" for i, (t, *_) in enumerate(LEVELS)) + " END")
    lo, hi = X.parse_level(s)
    return parts(spark, sf_dir).select("p_partkey", lo.alias("lo"), hi.alias("hi"))


COPPER = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT)"


@query(f"SELECT p_partkey, {COPPER} % 1000 AS copper FROM part")
def f14_coin_to_copper(spark, sf_dir):
    c = cents("p_retailprice") % 1000
    said = F.concat(F.floor(c / 100).cast("string"), F.lit(" gold, "), (F.floor(c / 10) % 10).cast("string"), F.lit(" silver and "), (c % 10).cast("string"), F.lit(" copper"))
    return parts(spark, sf_dir).select("p_partkey", X.coin_to_copper(said).alias("copper"))


@query(f"""SELECT p_partkey, CASE WHEN c = 0 THEN '0c' ELSE array_to_string(list_filter([CASE WHEN c // 1000 > 0 THEN c // 1000 || 'p' END, CASE WHEN c // 100 % 10 > 0 THEN c // 100 % 10 || 'g' END, CASE WHEN c // 10 % 10 > 0 THEN c // 10 % 10 || 's' END, CASE WHEN c % 10 > 0 THEN c % 10 || 'c' END], lambda x: x IS NOT NULL)[1:2], ' ') END AS shown
  FROM (SELECT p_partkey, {COPPER} AS c FROM part)""")
def f15_copper_to_text(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", X.copper_text(cents("p_retailprice")).alias("shown"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events")
def f20_log_timestamp(spark, sf_dir):
    """Times written as log lines and read back."""
    line = F.concat(F.lit("[Fri "), F.date_format(F.col("ts").cast("timestamp_ntz"), "MMM dd HH:mm:ss yyyy"), F.lit("] You have slain a rat!"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(X.log_timestamp(line)).alias("t"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def f21_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("SELECT event_id, CAST(coalesce(TRY_CAST(props->>'$.k' AS BIGINT), -1) AS BIGINT) AS k FROM events")
def f22_json_fallback(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


# Lines built from line items, parsed back by the log grammar.
STAMP = "'[Fri Jul 31 18:38:02 2026] '"
KINDS = (
    ("aa_gain", "'You have gained an ability point!  You now have ' || l_partkey || ' ability points.'"),
    ("aa_spend", "'You have improved Skill ' || l_partkey || ' at a cost of ' || l_linenumber || ' ability points.'"),
    ("depot_deposit", "'You have deposited ' || l_linenumber || ' Ore ' || l_partkey || ' to your personal depot.'"),
    ("upgrade", "'You have successfully merged two items together to create a new item: Ring ' || l_partkey || ' +' || l_linenumber || '.'"),
    ("xp", "'You gain party experience (with a bonus)! (' || l_linenumber || '.5%)'"),
    ("damage_taken", "'You have taken ' || l_partkey || ' damage from Swarm by a rat.'"),
    ("loot", "'You looted ' || l_linenumber || ' Skin ' || l_partkey || ' from a rat''s corpse and sold it for ' || l_linenumber || ' gold and 3 copper.'"),
    ("loot", "'You looted a Blade ' || l_partkey || ' from a rat''s corpse to create a Blade ' || l_partkey || ' +1'"),
    ("achievement", "'You have completed achievement: Deed ' || l_partkey"),
    ("craft_error", "'The result of this combine would produce an unusable item.'"),
    ("depot_withdraw", "'You have taken ' || l_linenumber || ' Ore ' || l_partkey || ' from your personal depot.'"),
    ("depot_consume", "'Consumed ' || l_linenumber || ' x Flask ' || l_partkey || ' (leaving ' || l_orderkey || ') from your personal depot.'"),
    ("faction", "'Your faction standing with Folk ' || l_partkey || ' has been adjusted by -' || l_linenumber || '.'"),
    ("faction_capped", "'Your faction standing with Folk ' || l_partkey || ' could not possibly get any better.'"),
    ("craft", "'You have fashioned the items together to create something new: Tonic ' || l_partkey || '.'"),
    ("craft", "'You lacked the skills to fashion Rolls ' || l_partkey || '.'"),
    ("craft_capped", "'You can no longer advance your skill from making this item.'"),
    ("coin", "'--You have looted ' || l_linenumber || ' gold and 3 silver from a dummy.--'"),
    ("heal", "'Someone healed you for ' || l_partkey || ' hit points by Minor Healing.'"),
    ("loot", "'You looted ' || l_linenumber || ' Silk ' || l_partkey || ' from a spider''s corpse and stored it in your tradeskill depot.'"),
    ("damage", "'You slash a dummy for ' || l_partkey || ' points of damage. (Critical)'"),
    ("miss", "'Bob tries to slash a rat ' || l_partkey || ', but misses!'"),
    ("damage", "'A rat is burned by ' || CASE WHEN l_returnflag = 'R' THEN 'Bob' ELSE 'Stranger' END || chr(39) || 's thorns for ' || l_linenumber || ' points of non-melee damage.'"),
    (None, "'Someone says, ''You have completed achievement'''"),
)
LINE = f"{STAMP} || CASE l_orderkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN {said}" for i, (_, said) in enumerate(KINDS)) + " END"


def parsed(spark, sf_dir, types=None, fields=None):
    return parse_events(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr(LINE).alias("line")), "line", types, fields)


@query(f"SELECT l_orderkey, l_linenumber, CASE l_orderkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(KINDS) if k) + " END AS type FROM lineitem")
def p1_gate_chain(spark, sf_dir):
    """Type of each line by the gates and patterns of the grammar."""
    return parsed(spark, sf_dir, fields=[]).select("l_orderkey", "l_linenumber", "type")


#: What tells lines of one type apart.
LOOT = {6: "copper IS NOT NULL", 7: "merged_into IS NOT NULL", 14: "ok", 15: "NOT ok", 19: "copper IS NULL AND merged_into IS NULL", 20: "dmg_type = 'melee'"}


def _event(name: str, kind: int, sql: str, columns: list[str]) -> None:
    """The lines that the grammar takes for an event, whatever they were built from."""

    def run(spark, sf_dir):
        kinds, told = [KINDS[kind][0]], [f for f in FIELDS if f in columns or f in LOOT.get(kind, "")]
        return parsed(spark, sf_dir, kinds, told).where(F.col("type").isin(kinds)).where(LOOT.get(kind, "true")).select("l_orderkey", "l_linenumber", *columns)

    run.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber, {sql} FROM lineitem WHERE l_orderkey % {len(KINDS)} = {kind}")(run)


_event("e1_aa_gain", 0, "1 AS points, CAST(l_partkey AS INT) AS balance_after", ["points", "balance_after"])
_event("e2_aa_spend", 1, "'Skill ' || l_partkey AS ability, l_linenumber AS points", ["ability", "points"])
_event("e3_depot", 2, "'Ore ' || l_partkey AS item, CAST(l_linenumber AS BIGINT) AS qty", ["item", "qty"])
_event("e3_depot_withdraw", 10, "'Ore ' || l_partkey AS item, CAST(l_linenumber AS BIGINT) AS qty", ["item", "qty"])
_event("e4_upgrade", 3, "'Ring ' || l_partkey || ' +' || l_linenumber AS item, 'Ring ' || l_partkey AS base, l_linenumber AS tier", ["item", "base", "tier"])
_event("e5_xp_bonus", 4, "l_linenumber + 0.5::DOUBLE AS pct, true AS bonus", ["pct", "bonus"])
_event("e6_dot_taken", 5, "l_partkey AS amount, 'Swarm' AS spell, 'a rat' AS source, 'dot' AS dmg_type", ["amount", "spell", "source", "dmg_type"])
_event("e7_loot_sold", 6, "'Skin ' || l_partkey AS item, CAST(l_linenumber AS BIGINT) AS qty, CAST(l_linenumber * 100 + 3 AS BIGINT) AS copper, 'a rat' AS source", ["item", "qty", "copper", "source"])
_event("e8_loot_merged", 7, "'Blade ' || l_partkey AS item, CAST(1 AS BIGINT) AS qty, 'Blade ' || l_partkey || ' +1' AS merged_into", ["item", "qty", "merged_into"])
_event("e9_achievement", 8, "'Deed ' || l_partkey AS name", ["name"])
_event("e10_craft_error", 9, "'unusable_result' AS reason", ["reason"])
_event("e11_melee_damage", 20, "l_partkey AS amount, 'a dummy' AS target, 'slash' AS verb, 'player' AS attacker", ["amount", "target", "verb", "attacker"])
_event("e12_depot_consume", 11, "'Flask ' || l_partkey AS item, CAST(l_linenumber AS BIGINT) AS qty, l_orderkey AS left_qty", ["item", "qty", "left_qty"])
_event("e12_faction", 12, "'Folk ' || l_partkey AS faction, CAST(-l_linenumber AS BIGINT) AS delta", ["faction", "delta"])
_event("e12_faction_capped", 13, "'Folk ' || l_partkey AS faction, 'better' AS direction", ["faction", "direction"])
_event("e12_craft_made", 14, "'Tonic ' || l_partkey AS item", ["item"])
_event("e12_craft_failed", 15, "'Rolls ' || l_partkey AS item", ["item"])
_event("e12_craft_capped", 16, "'craft_capped' AS type", ["type"])
_event("e14_coin", 17, "CAST(l_linenumber * 100 + 30 AS BIGINT) AS copper, 'a dummy' AS source", ["copper", "source"])
_event("e14_heal", 18, "l_partkey AS amount, 'Minor Healing' AS spell, 'Someone' AS source", ["amount", "spell", "source"])
_event("e14_stored_loot", 19, "'Silk ' || l_partkey AS item, CAST(l_linenumber AS BIGINT) AS qty, 'a spider' AS source", ["item", "qty", "source"])


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % {len(KINDS)} = 21 THEN 'miss' ELSE 'damage' END AS type, 'Bob' AS attacker FROM lineitem WHERE l_orderkey % {len(KINDS)} = 21 OR (l_orderkey % {len(KINDS)} = 22 AND l_returnflag = 'R')")
def e13_group_gate(spark, sf_dir):
    """Misses and damage shields of others, for members of the group only."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(LINE).alias("line"))
    events = keep_members(parse_events(lines, fields=["attacker", "ally"]), spark.createDataFrame([("Bob",), ("Ann",)], "name string"))
    return events.where("ally AND type IS NOT NULL").select("l_orderkey", "l_linenumber", "type", "attacker")


SECTIONED = "'intro ' || lang || chr(10) || ' == ' || source || ' ==' || chr(10) || coalesce(text, '') || chr(10) || '=[[a|Top]]=' || chr(10) || 'x = y' || chr(10) || '== Two ===' || chr(10) || ' ' || chr(10) || '====' || chr(10) || '== ==' || chr(10) || ' ' || chr(10) || '=== Notes ===' || chr(10) || 'end'"
_LEVELS = " ".join(f"WHEN regexp_matches(said, '^={{{k}}}.+={{{k}}}$') THEN {k}" for k in range(6, 0, -1))


@query(rf"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split({SECTIONED}, chr(10)) AS x FROM documents)),
  h AS (SELECT *, CASE {_LEVELS} END AS lv FROM (SELECT *, trim(line) AS said FROM l)),
  s AS (SELECT *, CAST(sum(CASE WHEN lv IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS section FROM h)
  SELECT doc_id, section, coalesce(max(lv), 0) AS level, max(CASE WHEN lv IS NULL THEN '' WHEN contains(said, '[[a|') THEN 'Top' ELSE trim(substr(said, lv + 1, length(said) - 2 * lv)) END) AS title, CAST(sum(CASE WHEN lv IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS lines FROM s
  GROUP BY 1, 2 HAVING title <> '' OR bool_or(lv IS NULL AND said <> '')""")
def d5_heading_sections(spark, sf_dir):
    """Sections by heading with their level, title and lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.sections(F.expr(SECTIONED))).alias("s"))
    return d.select("doc_id", F.col("s.section").alias("section"), F.col("s.level").cast("long").alias("level"), F.col("s.title").alias("title"), F.size("s.lines").cast("long").alias("lines"))


# Pages composed from columns by Spark; the SQL tells what each shape must give.
DEEDS = """concat('lead\\n|}\\n{| class=t\\n! <span title="Expand or collapse Group ', p_brand, '">\\n|-\\n|\\n', IF(p_size % 2 = 0, '{|\\n! title="Expand or collapse Inner"\\n|-\\n|\\n', ''),
  '{| id=x\\n! title="Expand or collapse ', IF(p_size % 5 = 0, 'Race Unlock — ', ''), p_name, '"\\n<div>', p_size, ' Points</div>\\n|-\\n|\\n\\'\\'\\'Do ', p_type, '\\'\\'\\'\\n\\'\\'\\'Requirements\\'\\'\\'\\n<ul><li>☐ Get [[', p_brand, '|it]]</li>',
  CASE p_size % 3 WHEN 0 THEN '<li>Walk</li>' WHEN 1 THEN '</ul>\\'\\'\\'Notes\\'\\'\\'<ul><li>Slow</li>' ELSE '<li>needs an unlock token</li>' END, '</ul>\\n|}\\n', IF(p_size % 2 = 0, '|}\\n', ''), '{|\\n! title="Expand or collapse None"\\n|}\\n|}\\n== Template ==\\n{|\\n! title="Expand or collapse Copy"\\n1 Point\\n|}')"""


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Race Unlock — ' ELSE '' END || p_name AS name, 'Group ' || p_brand AS grp, CASE WHEN p_size % 2 = 0 THEN 'Inner' ELSE 'Group ' || p_brand END AS sub, p_size AS points, 'Do ' || p_type AS said,
  CASE WHEN p_size % 3 = 0 THEN 'Get it<' || p_brand || ',Walk' ELSE 'Get it<' || p_brand END AS reqs, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'Slow' ELSE 'needs an unlock token' END AS notes, CASE WHEN p_size % 5 = 0 THEN p_name END AS unlocks FROM part""")
def d11_achievements(spark, sf_dir):
    """Achievements in tables of one or two levels, with their groups, requirements, notes and what they unlock."""
    rows = pages.achievements(parts(spark, sf_dir).select("p_partkey", F.expr(DEEDS).alias("text")), "text")
    reqs = F.array_join(F.transform("reqs", lambda r: F.concat_ws("<", r.text, r.link)), ",")
    return rows.select("p_partkey", "name", F.col("group").alias("grp"), "sub", "points", F.col("desc").alias("said"), reqs.alias("reqs"), F.array_join("notes", ",").alias("notes"), F.col("unlock.name").alias("unlocks"))


QUESTED = """concat('{{Era}}\\n<!-- * not this -->\\n', IF(p_size % 4 = 0, '', concat('{| class="questTopTable"\\n! \\'\\'\\' Start Zone: \\'\\'\\'\\n| [[', p_type, '|Old ', p_type, ']]\\n|-\\n! Giver:\\n| [[', p_brand, ']]\\n|-\\n! Minimum Level:\\n| Level ', p_size, IF(p_size % 2 = 0, '+', ''), '\\n|-\\n! Classes\\n| ', IF(p_size % 3 = 0, 'All', 'Bard, Monk/Bard and none'), '\\n|}\\n')),
  '== Rewards ==\\n* [[Prize]]\\n== Checklist ==\\n', IF(p_size % 5 = 0, '', concat('* Ask [[', p_brand, ']]\\n=== Part ', p_size, ' ===\\n# Find the [[', p_name, '|thing]]\\n')), '*\\n== Walkthrough ==\\nOne goes to the old place of ', p_name, '\\nshort\\n: a long line that someone speaks to you\\nHe says, \\'and this is what he says to you\\'\\n')"""


@query("""SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'Old ' || p_type END AS start_zone, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS giver, CASE WHEN p_size % 4 <> 0 THEN p_size END AS level_min, CASE WHEN p_size % 4 <> 0 AND p_size % 2 <> 0 THEN p_size END AS level_max,
  CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 3 = 0 THEN 'All' ELSE 'Bard,Monk' END AS classes, CASE WHEN p_size % 5 = 0 THEN 'One goes to the old place of ' || p_name ELSE 'Ask ' || p_brand || ';Part ' || p_size || ' — Find the thing' END AS steps,
  'Prize' || CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 4 = 0 THEN ',' || p_brand || ',' || p_name ELSE ',' || p_name END AS mentions FROM part""")
def d7_quests(spark, sf_dir):
    """Quest pages with and without a top table, with steps or, where there are none, prose."""
    q = pages.quests(parts(spark, sf_dir).select("p_partkey", F.expr(QUESTED).alias("text")), "text")
    return q.select("p_partkey", "start_zone", "giver", "level_min", "level_max", F.array_join("classes", ",").alias("classes"), F.array_join("steps", ";").alias("steps"), F.array_join("mentions", ",").alias("mentions"))


TESTED = """concat('== Tests ==\\n=== [[', p_type, ']] Tests ===\\n', IF(p_size % 2 = 0, concat('\\'\\'\\'Quest Giver:\\'\\'\\' [[', p_brand, '|x]]\\n'), ''), '{| class=q\\n|-\\n! Reward || Quest\\n|-\\n| ', IF(p_size % 3 = 0, concat('{{:', p_name, '}}'), concat('[[', p_name, ']]')), '\\n| \\'\\'\\'Test\\'\\'\\' of ', p_partkey, '\\n| word\\n| <li>[[Rune]]</li>\\n| <ul><li>\\'\\'\\'{{SkyNoDrop|[[Gem (', p_size, ')|Gem]]}}\\'\\'\\' (', p_size, '-SL)</li>\\n<li>[[Leaf]]</li></ul>\\n|-\\n| few\\n| cells\\n|}\\n== After ==\\n=== [[Bard]] Tests ===\\n{|\\n|-\\n| [[a]]\\n| b\\n| c\\n| [[d]]\\n| [[e]]\\n|}')"""


@query("""SELECT p_partkey, p_type AS cls, CASE WHEN p_size % 2 = 0 THEN p_brand END AS giver, 'test-of-' || p_partkey AS key, p_name AS reward, 'Rune' AS runes, 'Gem (' || p_size || ')<' || p_size || '-SL!,Leaf' AS items FROM part""")
def d12_class_tests(spark, sf_dir):
    """Class tests out of the section of their name, with what each needs, from where, and whether it can be traded."""
    rows = pages.class_tests(parts(spark, sf_dir).select("p_partkey", F.expr(TESTED).alias("text")), "text", "Tests")
    needs = lambda c: F.array_join(F.transform(c, lambda n: F.concat(F.concat_ws("<", n["name"], n.src), F.when(n.no_drop, "!").otherwise(""))), ",")
    return rows.select("p_partkey", "cls", "giver", "key", "reward", needs("runes").alias("runes"), needs("items").alias("items"))


@query("SELECT p_partkey, CASE WHEN (SELECT count(*) >= 60 AND count(*) = count(DISTINCT p_partkey) FROM part) THEN 'synced' ELSE 'bundled' END AS origin FROM part")
def d12_whole_or_bundled(spark, sf_dir):
    """The synced tests, as all of them are whole; the bundled ones otherwise."""
    rows = pages.class_tests(parts(spark, sf_dir).select("p_partkey", F.expr(TESTED).alias("text")), "text", "Tests").withColumn("origin", F.lit("synced"))
    classes = tuple(r[0] for r in table(spark, sf_dir, "part").where("p_type IS NOT NULL").select("p_type").distinct().collect())  # part types are the known classes
    return pages.whole_tests(rows, rows.withColumn("origin", F.lit("bundled")), classes).select("p_partkey", "origin")


CARD = """concat('<main><nav><ul><li>Home</li></ul></nav><h1>', p_name, '</h1><aside class="x tooltip-card"><p class="tooltip-title"><img src=a>', p_brand, '</p><p class="tooltip-flags">', IF(p_size % 2 = 0, 'MAGIC ITEM · NO DROP', ''), '</p><ul class="tooltip-lines"><li>Slot: <b>HEAD</b></li><li>Skill: Blunt Atk Delay: ', p_size, '</li>',
  CASE p_size % 3 WHEN 0 THEN concat('<li>AC: ', p_size, '</li>') WHEN 1 THEN concat('<li>STR: +', p_size, ' HP: 5 SV FIRE: -2</li>') ELSE concat('<li>Effect: ', p_name, ' IV (Combat, Casting Time: Instant) at Level 9</li>') END, '<li>Drops From: ', p_type, ': a rat, the &lt;lord&gt;</li><li>Odd</li></ul></aside><section id="all-results"><br><table>', IF(p_size % 4 = 0, '', concat('<tr><td>', p_name, ' – <i>of</i> ', p_type, '</td></tr>')), '<tr><td>', p_brand, '<ul><li>in</li></ul></td></tr></table></section><li>after</li></main>')"""


@query("""SELECT p_partkey, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'MAGIC ITEM,NO DROP' ELSE '' END AS flags, p_size % 2 = 0 AS no_drop, 'HEAD' AS slot, 'Blunt' AS skill, p_size AS delay, CASE WHEN p_size % 3 = 0 THEN p_size END AS ac, CASE WHEN p_size % 3 = 1 THEN p_size END AS str, CASE WHEN p_size % 3 = 1 THEN 5 END AS hp, CASE WHEN p_size % 3 = 1 THEN -2 END AS fire,
  CASE WHEN p_size % 3 = 2 THEN 'proc ' || p_name || ' 4' ELSE '' END AS effects, p_type || '<a rat,' || p_type || '<the <lord>' AS drops, 4 AS attributes FROM part""")
def d13_tooltips(spark, sf_dir):
    """Items out of the tooltip cards of HTML pages."""
    t = pages.tooltips(parts(spark, sf_dir).select("p_partkey", F.expr(CARD).alias("html")), "html")
    told = F.array_join(F.transform("effects", lambda e: F.concat_ws(" ", e.type, e.family, e.tier)), ",")
    return t.select("p_partkey", "name", F.array_join("flags", ",").alias("flags"), "no_drop", "slot", "skill", "delay", "ac", F.col("stats")["STR"].alias("str"), "hp", F.col("resists")["FIRE"].alias("fire"), told.alias("effects"), F.array_join(F.transform("drops", lambda d: F.concat_ws("<", d.zone, d.mob)), ",").alias("drops"), "attributes")


@query("""SELECT p_partkey, 0 AS pos, p_name AS name, 'of ' || p_type AS description FROM part WHERE p_size % 4 <> 0
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END, p_brand || 'in', NULL FROM part""")
def d14_result_rows(spark, sf_dir):
    """Rows of the result lists of HTML pages, the outermost only."""
    return pages.result_rows(parts(spark, sf_dir).select("p_partkey", F.expr(CARD).alias("html")), "html").select("p_partkey", "pos", "name", "description")


CAPPED = "concat('lead\\n===Strength (STR)===\\n*Max (hard-cap): ', p_size, '\\n', IF(p_size % 2 = 0, concat('*Soft-cap: ', p_size + 1, '\\n'), ''), '== Notes ==\\nSoft-cap: 9\\n')"


@query("SELECT p_partkey, 'str' AS stat, p_size AS cap FROM part UNION ALL SELECT p_partkey, 'str_soft', p_size + 1 FROM part WHERE p_size % 2 = 0")
def d9_stat_caps(spark, sf_dir):
    """Hard and soft caps of the stats that a page's headings name."""
    s = parts(spark, sf_dir).select("p_partkey", F.explode(X.sections(F.expr(CAPPED))).alias("s")).select("p_partkey", "s.title", "s.lines")
    return pages.stat_caps(s)


GUIDED = "concat('{|\\n! [[Zone]] !! Lvl Range !! 5 !! Note\\n|-\\n| [[', p_name, '|Old ', p_name, ']] || ', p_size, IF(p_size % 2 = 0, concat(' - ', p_size + 9), ''), ' || ', CASE p_size % 3 WHEN 0 THEN '[[File:GoldCircle.png|20px]]' WHEN 1 THEN '[[file:Odd.png]]' ELSE '' END, ' || {{#vardefine:zem|', p_size, '}}\\n|}\\n{|\\n! Name\\n|-\\n| x\\n|}')"


@query("SELECT p_partkey, 'Old ' || p_name AS zone, p_size AS level_min, CASE WHEN p_size % 2 = 0 THEN p_size + 9 ELSE p_size END AS level_max, p_size AS zem, CASE p_size % 3 WHEN 0 THEN 'inefficient' WHEN 1 THEN 'Odd' END AS rating FROM part")
def d8_zone_ratings(spark, sf_dir):
    """Zones of guide tables with their levels and what their icons mean."""
    t = parts(spark, sf_dir).select("p_partkey", F.explode(wiki.wikitables(F.expr(GUIDED))).alias("t")).select("p_partkey", "t.headers", "t.rows")
    return pages.zone_ratings(t).select("p_partkey", "zone", "level_min", "level_max", "zem", F.col("ratings")["5"].alias("rating"))
