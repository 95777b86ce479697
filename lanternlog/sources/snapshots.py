"""Export files as sources: inventory dumps, faction, recipe and achievement exports, sitemaps and character lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_name, section, skill_from_token, tolerant_fields
from ..operators.activity import nearest_preceding_host


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, modified, size, sha256, text) of files; text is decoded by its byte-order mark, UTF-8 without one. Bytes that
    aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").load(path)
    c = F.col("content")
    mark = F.hex(F.substring(c, 1, 2))
    body = F.when(F.hex(F.substring(c, 1, 3)) == "EFBBBF", F.substring(c, F.lit(4), F.length(c))).otherwise(c)
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode(c, "UTF-16")).otherwise(F.make_valid_utf8(body.cast("string")))
    return files.select("path", F.element_at(F.split("path", r"[\\/]"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2(c, 256).alias("sha256"), text.alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of the files' texts."""
    split = F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n"))
    return files.select("path", split).select("path", F.col("pos").cast("long").alias("line_no"), F.col("col").alias("line"))


#: What stands after owner and server in an export's name, by kind; recipes may name a skill.
NAME_ENDS = (("inventory", "Inventory"), ("achievements", "Achievements"), ("faction", "(?:[A-Za-z]+-)?Factions?"), ("recipes", "(?:[A-Za-z ]+-)?Recipes"))


def file_kind(name: Column, text: Column) -> Column:
    """Kind of an export by its name, else by its first lines that aren't empty: an inventory's header; a group over an achievement's
    status; a header that speaks of factions, standings or recipes; and without a header, numbers first and third for factions, a
    number first for recipes. Null for anything else."""
    by_name = F.lit(None).cast("string")
    for kind, end in reversed(NAME_ENDS):
        by_name = F.when(name.rlike(rf"(?i)^\w+_\w+-{end}\.txt$"), kind).otherwise(by_name)
    said = F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x) != "")
    head, second = F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(said, F.lit(2)), F.lit(""))
    fields = F.filter(F.transform(F.split(F.trim(head), r"\t|\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")
    number = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)).rlike(r"^-?[0-9]+$"), F.lit(False))
    by_text = (
        F.when(head.startswith("Location\t"), "inventory")
        .when(head.rlike(r"^[^\t:]+: [^\t]+$") & second.rlike(r"^[CIci](\t|$)"), "achievements")
        .when(F.lower(head).rlike("faction|standing"), "faction")
        .when(F.lower(head).contains("recipe"), "recipes")
        .when(number(1) & number(3), "faction")
        .when(number(1) & (F.size(fields) >= 2), "recipes")
    )
    return F.coalesce(by_name, by_text)


def file_skill(name: Column, skills: tuple[str, ...] = ()) -> Column:
    """Skill that a recipe export's name gives; null for other files and where none is named."""
    return skill_from_token(F.regexp_extract(name, r"(?i)^\w+_\w+-([A-Za-z ]+)-Recipes\.txt$", 1), skills)


# The places of an inventory whose items are worn.
WORN_ROOTS = (
    "Any Slot", "Charm", "Ear", "Head", "Face", "Neck", "Shoulders", "Arms", "Back", "Wrist", "Range", "Hands",
    "Primary", "Secondary", "Fingers", "Chest", "Legs", "Feet", "Waist", "Ammo", "Held",
)
#: Slots of an item that are sockets, and numbers that only a bag's places have.
SOCKETS, BAG_PLACES = (0, 10), ((3, 6), (11, 1 << 30))


def not_dumps(rows: DataFrame) -> DataFrame:
    """Paths of files (path, line_no, line) whose first line isn't an inventory's header; inventory_rows leaves them out."""
    return rows.where("line_no = 0").where(~F.col("line").startswith("Location\t")).select("path")


def inventory_rows(rows: DataFrame) -> DataFrame:
    """Items of dump lines (path, line_no, line), one a row: path, seq (the line), location, root, parent_location, parent_seq, sub_slot,
    name, name_norm, item_id, count, slots, is_empty, is_exaltation, upgrade_tier, is_equipped, parent_is_container and host_name.

    A line has five fields, or three in a section of keys; headers inside the file and lines with other numbers are skipped. A
    place inside another names it: the nearest line before with that location is its host, as paired places repeat. A host is a
    bag if it has slots other than those of sockets, or a child whose number no socket has; else its children are sockets.
    A file's lines meet once, in one shuffle."""
    at = lambda k: F.trim(F.try_element_at("_f", F.lit(k)))
    number = lambda k: at(k).try_cast("long")
    wrong = lambda k: (F.coalesce(at(k), F.lit("")) != "") & number(k).isNull()
    of = lambda pattern, k=1: F.nullif(F.regexp_extract("location", pattern, k), F.lit(""))
    other = F.when((F.col("line_no") == 0) & ~F.col("line").startswith("Location\t"), True)
    read = rows.select("path", "line_no", F.split("line", "\t").alias("_f"), other.alias("_other"))
    kept = read.withColumn("_other", F.max("_other").over(W.partitionBy("path"))).where("_other IS NULL AND line_no > 0").where(number(3).isNotNull() & ~wrong(4) & ~wrong(5))
    items = kept.select("path", F.col("line_no").alias("seq"), at(1).alias("location"), at(2).alias("name"), number(3).alias("item_id"), F.coalesce(number(4), F.lit(1)).alias("count"), F.coalesce(number(5), F.lit(0)).alias("slots"))
    items = items.withColumn("parent_location", of(r"^(.*)-(?:Slot|Depot)[0-9]+$"))
    hosted = nearest_preceding_host(items, ["path"], "seq", F.lit(True), F.col("location"), F.col("parent_location"), ("slots", "name")).withColumnRenamed("host", "parent_seq")
    hosted = hosted.withColumn("sub_slot", of(r"-Slot([0-9]+)$").cast("int"))
    place = reduce(lambda x, y: x | y, (F.col("sub_slot").between(a, b) for a, b in BAG_PLACES))
    told = F.max(F.coalesce(place, F.lit(False))).over(W.partitionBy("path", "parent_seq"))
    bags = hosted.withColumn("parent_is_container", F.when(F.col("parent_seq").isNotNull(), ~F.col("host_slots").isin(*SOCKETS) | told))
    return bags.drop("host_slots").withColumns({
        "root": F.regexp_replace("location", r"(-(Slot|Depot)[0-9]+)+$", ""),
        "name_norm": normalize_name(F.col("name")),
        "is_empty": F.col("name") == "Empty",
        "is_exaltation": F.col("name").endswith(" (Exaltation)"),
        "upgrade_tier": F.coalesce(F.nullif(F.regexp_extract("name", r"\s\+([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0)),
    }).withColumn("is_equipped", F.col("root").isin(*WORN_ROOTS))


def containers(items: DataFrame) -> DataFrame:
    """(path, seq, location, root, name, section, capacity, used, free, nested) of the bags among inventory_rows: a bag without a
    number of slots holds as many places as it shows; an empty place is no bag. An item stands as itself and as its bag's."""
    itself = F.when(~F.col("is_empty"), F.struct(F.col("seq").alias("seq"), F.lit(True).alias("itself")))
    inside = F.when(F.col("parent_is_container"), F.struct(F.col("parent_seq").alias("seq"), F.lit(False).alias("itself")))
    roles = items.withColumn("nested", F.col("parent_location").isNotNull()).withColumn("_role", F.explode(F.filter(F.array(itself, inside), lambda r: r.isNotNull())))
    shown = ["location", "root", "name", "slots", "is_equipped", "nested"]
    bags = roles.groupBy("path", F.col("_role.seq").alias("seq")).agg(
        F.first(F.when(F.col("_role.itself"), F.struct(*shown)), ignorenulls=True).alias("_bag"),
        F.count_if(~F.col("_role.itself")).alias("_shown"),
        F.count_if(~F.col("_role.itself") & ~F.col("is_empty")).alias("used"),
    ).where("_bag IS NOT NULL AND _shown > 0").select("path", "seq", "_bag.*", "_shown", "used")
    both = bags.withColumn("capacity", F.when(F.col("slots") > 0, F.col("slots")).otherwise(F.col("_shown")))
    free = F.greatest(F.lit(0), F.col("capacity") - F.col("used"))
    return both.select("path", "seq", "location", "root", "name", section(F.col("root"), F.col("is_equipped")).alias("section"), "capacity", "used", free.alias("free"), "nested")


def section_space(bags: DataFrame, *keys: str) -> DataFrame:
    """(keys, section, containers, capacity, used, free) of containers summed up by section."""
    return bags.groupBy(*keys, "section").agg(F.count("*").alias("containers"), *(F.sum(c).alias(c) for c in ("capacity", "used", "free")))


def faction_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid (path, faction_id, name, value, to_max), skipped lines) of a faction export, with or without a header."""
    f = tolerant_fields(F.col("line"))
    number = lambda k: F.expr(f"try_cast(try_element_at(_f, {k}) as long)")
    parsed = rows.where("trim(line) <> ''").withColumn("_f", f).withColumns({"faction_id": number(1), "value": number(3), "to_max": number(4), "name": F.try_element_at("_f", F.lit(2))})
    good = F.col("faction_id").isNotNull() & F.col("value").isNotNull()
    return parsed.where(good).select("path", "faction_id", "name", "value", "to_max"), parsed.where(~good & ~F.lower("line").startswith("id")).select("path", "line_no", "line")


def recipe_rows(rows: DataFrame) -> DataFrame:
    """(path, recipe_id, name) of a recipe export."""
    parsed = rows.withColumn("_f", F.split("line", r"\t|\s{2,}| (?=\D)", 2))
    return parsed.select("path", F.expr("try_cast(trim(_f[0]) as long)").alias("recipe_id"), F.trim(F.try_element_at("_f", F.lit(2))).alias("name")).where("recipe_id IS NOT NULL AND name <> ''")


def achievement_rows(rows: DataFrame) -> DataFrame:
    """(path, category, name, complete, reqs array<struct<text, complete, progress>>) of an achievement export.

    A category line stands over its achievements and an achievement over its requirements, so parents are the last such
    line before."""
    f = F.split("line", "\t")
    is_category = F.size(f) == 1
    is_name = (F.size(f) == 2) & F.col("line").rlike("^[CIci]\t")
    is_req = (F.size(f) >= 3) & F.col("line").rlike("^[CIci]\t\t")
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    done = F.upper(F.substring("line", 1, 1)) == "C"
    marked = rows.where("trim(line) <> ''").withColumns({
        "category": F.last(F.when(is_category, F.trim("line")), ignorenulls=True).over(w),
        "parent": F.last(F.when(is_name, F.struct(F.col("line_no").alias("at"), F.trim(f[1]).alias("name"), done.alias("complete"))), ignorenulls=True).over(w),
        "req": F.when(is_req, F.struct("line_no", F.trim(f[2]).alias("text"), done.alias("complete"), F.trim(F.try_element_at(f, F.lit(4))).alias("progress"))),
    })
    named = marked.where((is_name | is_req) & F.col("parent").isNotNull())
    reqs = F.transform(F.array_sort(F.collect_list("req")), lambda r: r.dropFields("line_no"))
    return named.groupBy("path", "category", "parent").agg(reqs.alias("reqs")).select("path", "category", F.col("parent.name").alias("name"), F.col("parent.complete").alias("complete"), "reqs")


def sitemap_urls(xml: Column) -> Column:
    """array<struct<loc, lastmod>> of a sitemap, whatever its namespace prefix."""
    entries = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?url>(.*?)</(?:\w+:)?url>"), F.lit(1))
    field = lambda e, n: F.regexp_extract(e, rf"(?s)<(?:\w+:)?{n}>\s*(.*?)\s*</", 1)
    return F.transform(entries, lambda e: F.struct(field(e, "loc").alias("loc"), F.nullif(field(e, "lastmod"), F.lit("")).alias("lastmod")))


def log_owner(name: Column) -> Column:
    """struct<name, server> of a log or export file name."""
    pattern = r"(?i)^(\w+?)_(\w+)(?:-[A-Za-z -]+)?\.txt$"
    return F.when(name.rlike(pattern), F.struct(F.regexp_extract(name, pattern, 1).alias("name"), F.lower(F.regexp_extract(name, pattern, 2)).alias("server")))


def unseen_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose path and content hash are not among those seen."""
    return files.join(seen.select("path", "sha256"), ["path", "sha256"], "left_anti")


def ini_characters(rows: DataFrame) -> DataFrame:
    """(path, name, server) of the `[Characters]` section of settings files (path, line_no, line): values `name, server` with a name."""
    head = F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit(""))
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn("_section", F.last(head, ignorenulls=True).over(w)).where("_section = 'Characters' AND line RLIKE '^[^;#=:]+[=:]'")
    fields = F.transform(F.split(F.regexp_replace("line", r"^[^=:]+[=:]", ""), ","), lambda x: F.trim(x))
    return inside.withColumn("_f", fields).where("size(_f) >= 2 AND _f[0] <> ''").select("path", F.col("_f")[0].alias("name"), F.col("_f")[1].alias("server"))


def candidate_characters(*sources: DataFrame) -> DataFrame:
    """(name, server, has) of every character that a source (name, server) knows, the best source first: the spelling is that of
    the first source that has it, and `has` lists the places of all that do."""
    rows = [s.select("name", "server", F.lit(n).alias("_at")) for n, s in enumerate(sources)]
    keys = [F.lower("name").alias("_name"), F.lower("server").alias("_server")]
    out = reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(F.min(F.struct("_at", "name", "server")).alias("_first"), F.array_sort(F.collect_set("_at")).alias("has"))
    return out.select("_first.name", "_first.server", "has")


def worklist(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """(title, kind) of pages to fetch, each once and under the first kind that names it."""
    rows = [df.select("title", F.lit(n).alias("_at"), F.lit(kind).alias("kind")) for n, (kind, df) in enumerate(kinds)]
    return reduce(DataFrame.unionByName, rows).groupBy("title").agg(F.min_by("kind", "_at").alias("kind"))


def synced_or_bundled(synced: DataFrame, bundled: DataFrame, valid: Column) -> DataFrame:
    """The valid synced rows, or all bundled ones where no synced row is valid."""
    good = synced.where(valid)
    return bundled if good.isEmpty() else good


def due_files(files: DataFrame, seen: DataFrame, now: Column, settle: str = "2 seconds") -> DataFrame:
    """Files to import: untouched for a while, and new or with another time or size and another content than those seen (path,
    modified, size, sha256)."""
    known = seen.select("path", F.col("modified").alias("_modified"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    both = files.where(F.col("modified") <= now - F.expr(f"interval {settle}")).join(known, "path", "left")
    touched = ~(F.col("modified").eqNullSafe(F.col("_modified")) & F.col("size").eqNullSafe(F.col("_size")))
    return both.where(touched & ~F.col("sha256").eqNullSafe(F.col("_sha"))).drop("_modified", "_size", "_sha")
