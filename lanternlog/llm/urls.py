"""URL filter by a path-template tree.

Per host, paths grow into a tree of templates: a segment stays as it is where it holds a good share of its parent's URLs
and becomes a wildcard where it varies. From the leaves up, sibling branches of one shape are merged with the one of them
that has most labels if what stands below them is spread alike (a chi-square test of the two) and their labelled shares
don't differ by more than chance; a branch without labels so comes to share the labels of one like it. This is repeated
until nothing merges. A template is rejected when the smoothed purity of its labelled URLs is low. Explicit rules for hosts and path
prefixes come first and also supply the labels of the query below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

#: (host, path, verdict): a rule fits its host and all subdomains where the URL's path starts with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A segment is constant from this share of its parent's URLs and this many of them on.
LEAST_SHARE, LEAST_COUNT = 0.05, 2
#: Branches merge where they lie within so many standard errors of what both together have.
ALIKE = 1.96
#: Presumed share of good URLs and how many labels it counts as; purity below which a template is rejected, and the share of
#: its URLs that must be labelled bad.
PRIOR, PRIOR_LABELS, LEAST_PURITY, LEAST_BAD = 0.9, 2.0, 0.5, 0.2
#: Bytes up to which a table is broadcast, counted on its rows; beyond it the join is shuffled with salted keys.
MOST_BROADCAST, SALTS = 8 << 20, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for a null or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones are longer and win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _fits(small: DataFrame) -> bool:
    """Whether a settled table may be broadcast: its rows as JSON and 64 bytes for each."""
    return (small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64)).first()[0] or 0) <= MOST_BROADCAST


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that is always shuffled. Spark would broadcast a settled table by the size of its compressed files: 610,740
    hosts in files of under 10 MB were 111 MB of rows in the driver."""
    return left.join(right.hint("merge"), on, how)


def _join_small(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join; a hot key of the large side is spread over salts where the small side is too large to broadcast."""
    if _fits(small):
        return big.join(F.broadcast(small), on, "left")
    salted = small.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return _join(big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int")), salted, [*on, "_salt"], "left").drop("_salt")


def _wild(segment: Column) -> Column:
    """The wildcard of a segment keeps its extension."""
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def grow_templates(paths: DataFrame) -> DataFrame:
    """Adds `template` to a table (host, path, n, ...) of distinct paths: constant segments, wildcards with their extension, and a
    path's last slash.

    Each round decides the next segment of the paths that still have one and share their template so far with others; a path
    that is alone is finished at once, as all its segments are constant or none is. So rounds end with the deepest template
    that different paths share. Paths meet the constant segments of each shared template, 1 / LEAST_SHARE at most, and never
    a table of all segments, which grows with the paths."""
    keep = [*paths.columns, "template"]
    slash = F.when(F.col("path").endswith("/"), "/").otherwise("")
    growing = settle(paths.withColumns({"template": F.lit(""), "_seg": F.filter(F.split("path", "/"), lambda s: s != "")}))
    done, d = [], 0
    while not growing.isEmpty():
        cur = growing.withColumn("_s", F.get("_seg", F.lit(d)))
        further = cur.where("_s IS NOT NULL")
        shared = settle(further.groupBy("host", "template").agg(F.sum("n").alias("_all"), F.count("*").alias("_paths")).where("_paths > 1").drop("_paths"))
        often = further.groupBy("host", "template", "_s").agg(F.sum("n").alias("_n")).where(F.col("_n") >= LEAST_COUNT)
        constant = _join_small(often, shared, ["host", "template"]).where(F.col("_n") >= LEAST_SHARE * F.col("_all"))
        every = shared.select("host", "template", F.lit(None).cast("string").alias("_s")).union(constant.select("host", "template", "_s"))
        told = settle(every.groupBy("host", "template").agg(F.collect_list("_s").alias("_constant")))
        alone = F.col("_constant").isNull()
        fixed = F.when(alone, F.col("n") >= LEAST_COUNT).otherwise(F.array_contains("_constant", F.col("_s")))
        left = F.expr(f"slice(_seg, {d + 2}, greatest(size(_seg) - {d + 1}, 0))")
        rest = F.array_join(F.transform(left, lambda s: F.concat(F.lit("/"), F.when(fixed, s).otherwise(_wild(s)))), "")
        step = F.when(F.col("_s").isNull(), "").otherwise(F.concat(F.lit("/"), F.when(fixed, F.col("_s")).otherwise(_wild(F.col("_s"))), F.when(alone, rest).otherwise("")))
        ends = F.col("_s").isNull() | alone
        grown = settle(_join_small(cur, told, ["host", "template"]).withColumn("template", F.concat("template", step)).withColumn("_ends", ends).drop("_s", "_constant"))
        done.append(grown.where("_ends").withColumn("template", F.concat("template", slash)).select(*keep))
        growing, d = grown.where("NOT _ends").drop("_ends"), d + 1
    if not done:
        return growing.select(*keep)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _shape(segment: Column) -> Column:
    """Letters as a, digits as 0, runs as one."""
    return F.regexp_replace(F.regexp_replace(segment, r"\p{L}+", "a"), r"[0-9]+", "0")


def _merge_level(nodes: DataFrame, i: int) -> DataFrame:
    """Nodes (host, template, parts, n, bad, good) with `merged`: whether part i becomes a wildcard."""
    seg = F.get("parts", F.lit(i))
    at = nodes.withColumns({"_seg": seg, "_up": F.slice("parts", 1, i), "_rest": F.expr(f"slice(parts, {i + 2}, greatest(size(parts) - {i + 1}, 0))"), "_shape": _shape(seg)})
    constant = at.where("_seg <> '' AND NOT startswith(_seg, '*')")
    up, own = ["host", "_up", "_shape"], ["host", "_up", "_shape", "_seg"]
    labelled = F.col("good") + F.col("bad")
    cells = constant.groupBy(*own, "_rest").agg(F.sum("n").alias("_o"))
    branches = constant.groupBy(*own).agg(F.sum("n").alias("_n"), F.sum("bad").alias("_bad"), F.sum(labelled).alias("_labelled"), F.count_distinct("_rest").alias("_kinds"))
    led = branches.groupBy(*up).agg(F.max(F.struct("_labelled", "_n", "_seg", "_bad", "_kinds")).alias("_lead"))
    lead_cells = _join(cells, led.select(*up, F.col("_lead._seg").alias("_seg")), own).select(*up, "_rest", F.col("_o").alias("_lead_o"))
    # Chi-square of a branch and its leader; only the cells that the branch has add to the sum, others are in what is taken off.
    both = _join(cells, lead_cells, [*up, "_rest"], "left").groupBy(*own).agg(F.sum(F.col("_o") * F.col("_o") / (F.col("_o") + F.coalesce("_lead_o", F.lit(0)))).alias("_q"), F.count("_lead_o").alias("_common"))
    joined = _join(_join(branches, led, up).where(F.col("_seg") != F.col("_lead._seg")), both, own)
    whole, free = F.col("_n") + F.col("_lead._n"), F.col("_kinds") + F.col("_lead._kinds") - F.col("_common") - 1
    chi = (F.col("_q") * whole / F.col("_n") - F.col("_n")) / (1 - F.col("_n") / whole)
    most = free * F.pow(1 - 2 / (9 * free) + ALIKE * F.sqrt(2 / (9 * free)), F.lit(3.0))  # Wilson and Hilferty's approximation
    n_labelled = F.col("_labelled") + F.col("_lead._labelled")
    share = (F.col("_bad") + F.col("_lead._bad") + PRIOR_LABELS * (1 - PRIOR)) / (n_labelled + PRIOR_LABELS)
    apart = F.abs(F.col("_bad") - F.col("_labelled") * share) >= ALIKE * F.sqrt(F.col("_labelled") * share * (1 - share))
    alike = joined.where((free == 0) | (chi <= most)).where((F.col("_labelled") == 0) | ~apart)
    alike = settle(alike.select(*up, F.explode(F.array("_seg", "_lead._seg")).alias("_seg")).distinct().withColumn("merged", F.lit(True)))
    return _join(at, alike, own, "left").withColumn("merged", F.coalesce("merged", F.lit(False)))


def merge_branches(nodes: DataFrame) -> DataFrame:
    """(host, template, node) of templates (host, template, n, bad, good): the template after like branches have merged.

    Levels go from the deepest up, again until nothing merges; each works on sums of templates, never on rows of a group."""
    out = settle(nodes.withColumn("parts", F.split("template", "/")))
    changed = True
    while changed:
        changed = False
        segments = out.select("host", "parts", F.posexplode("parts").alias("i", "seg")).where("i > 0 AND seg <> '' AND NOT startswith(seg, '*')")
        siblings = segments.groupBy("i", "host", F.expr("slice(parts, 1, i)"), _shape(F.col("seg"))).agg(F.count_distinct("seg").alias("k")).where("k > 1")
        for i in sorted((r.i for r in siblings.select("i").distinct().collect()), reverse=True):  # a number for each level of the tree
            told = settle(_merge_level(out, i).drop("_up", "_rest", "_shape"))
            if told.where("merged").isEmpty():
                continue
            changed = True
            parts = F.when(F.col("merged"), F.transform("parts", lambda x, k: F.when(k == i, _wild(x)).otherwise(x))).otherwise(F.col("parts"))
            out = settle(told.withColumn("parts", parts).drop("_seg", "merged"))
    return out.select("host", "template", F.array_join("parts", "/").alias("node"))


def judge_templates(urls: DataFrame, label: str = "label") -> DataFrame:
    """(host, path, template, purity, template_verdict) of every distinct host and path of a table with these columns and a
    label: `block`, `allow` or null. An empty path has the empty template. `template` is the merged one, whose purity decides."""
    is_bad, is_good = F.count_if(F.col(label) == "block"), F.count_if(F.col(label) == "allow")
    paths = settle(urls.groupBy("host", "path").agg(F.count("*").alias("n"), is_bad.alias("bad"), is_good.alias("good")))
    grown = settle(grow_templates(paths))
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    nodes = settle(grown.groupBy("host", "template").agg(*sums))
    merged = settle(merge_branches(nodes))
    purity = (F.col("good") + PRIOR * PRIOR_LABELS) / (F.col("good") + F.col("bad") + PRIOR_LABELS)
    rejected = (purity < LEAST_PURITY) & (F.col("bad") >= LEAST_BAD * F.col("n"))
    verdicts = _join(nodes, merged, ["host", "template"]).groupBy("host", "node").agg(*sums).select("host", "node", purity.alias("purity"), F.when(rejected, "block").otherwise("allow").alias("template_verdict"))
    per_template = settle(_join(merged, verdicts, ["host", "node"]).select("host", "template", "node", "purity", "template_verdict"))
    return _join_small(grown.select("host", "path", "template"), per_template, ["host", "template"]).drop("template").withColumnRenamed("node", "template")


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule, template, purity and verdict to every row.

    Verdicts of rules label the template tree. A null URL, or one without `://`, has empty host and path, belongs to the
    empty template and is allowed; repeated rows count as often as they occur; an empty table stays empty."""
    host, path = host_and_path(F.col(url))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    added = ("host", "path", "rule", "template", "purity", "template_verdict", "verdict", "_label")  # replaced if the pages have them
    rows = pages.drop(*(c for c in added if c != url)).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_label": verdict})
    judged = judge_templates(rows.select("host", "path", F.col("_label").alias("label")))
    # Distinct keys on one side; a hot host's rows differ in their paths, and AQE splits a path that is hot itself.
    return _join(rows, judged, ["host", "path"], "left").withColumn("verdict", F.coalesce("_label", "template_verdict", F.lit("allow"))).drop("_label", "template_verdict")


def op5_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
