"""Near-duplicate groups by banded MinHash with odd sketches.

1. Each text gives its set of hashed shingles, band keys of MinHash samples, and an odd sketch. Rows with equal sets are one
   node, numbered apart from the rows' own keys, so repeated or missing keys lose no link.
2. In each bucket (equal band key) all nodes are paired with the bucket's least node. The XOR of two odd sketches tells
   pairs that can't be similar; the others are confirmed on full sets, and confirmed links give components.
3. Nodes of one component need no more pairs. Where a bucket still holds several components, its nodes are dealt into
   blocks, the larger component's against the others', and meet block by block inside tasks: first with their sketches only,
   then those that the sketches leave a partner with their full sets, on which links are confirmed. Components that a link
   joins are one from then on, so a block's rows give fewer links than there are rows, however many pairs are similar.

No bucket is capped, and no more than a link for each row leaves a comparison. The comparisons inside a bucket's blocks still
grow with the square of the nodes that pivots didn't join; they are popcounts inside tasks, and blocks spread over tasks. A
pair of similarity 0.75 shares none of the 48 bands of 5 samples with probability 2e-6; a sketch refuses a similar pair only
beyond 5 standard deviations of its error, and one of small sets also only beyond a proven bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table
from .graph import components
from .pieces import blocks
from .shingles import bands, fingerprint, may_reach, odd_sketch, shingle_sets, signature, similar

#: Rows of a block and hashes of their sets, of which two meet in a task; rows of a block whose sketches are compared at once.
BLOCK, BLOCK_HASHES, AT_ONCE = 1024, 1 << 19, 16
#: Pairs of one pivot that meet it in the same group.
STAR = 2000
#: Nodes up to which those with candidates are broadcast to pick their texts from the table; beyond it they are shuffled.
MOST_BROADCAST = 500_000


def row_hash(key: Column, text: Column) -> Column:
    """Tells rows of a table apart by key and text."""
    return F.xxhash64(key.cast("long"), text)


def text_sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, row, n_shingles, set_a, set_b, bands, sketch) of each row; a text without words has size 0 and nothing else."""

    @F.pandas_udf("n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for part in blocks(texts, 500_000):
            rows += [(len(s), *fingerprint(s), bands(signature(s)), odd_sketch(s)) if len(s) else (0, None, None, None, None) for s in shingle_sets(part)]
        n, set_a, set_b, keys, sketches = zip(*rows, strict=True) if rows else ((),) * 5
        whole = lambda x: pd.array(x, dtype="Int64")  # noqa: E731  # a float column with nulls would round 64-bit hashes
        return pd.DataFrame({"n_shingles": n, "set_a": whole(set_a), "set_b": whole(set_b), "bands": keys, "sketch": sketches})

    return docs.select(F.col(key).cast("long").alias("id"), row_hash(F.col(key), F.col(text)).alias("row"), sketched(F.col(text)).alias("_s")).select("id", "row", "_s.*")


def _bits(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def may_be_similar(percent: int):
    """Whether two sketches of sets of known sizes leave a similarity of percent possible."""

    @F.pandas_udf("boolean")
    def told(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        bits = np.bitwise_count(_bits(a) ^ _bits(b)).sum(axis=1)
        return pd.Series(may_reach(bits, n.to_numpy(), m.to_numpy(), percent))

    return told


def full_sets(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, set) of wanted nodes (node, row, set_a, set_b): the sorted hashes of the row's shingles as 64-bit words.

    The row's fingerprint is checked, so another row with an equal hash gives nothing; rows that repeat one count once."""
    n = wanted.count()
    texts = docs.select(row_hash(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text")).join(F.broadcast(wanted) if n <= MOST_BROADCAST else wanted, "row").select("node", "set_a", "set_b", "text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in blocks(batch["text"], 500_000):
                own = batch.iloc[at : at + len(part)]
                at += len(part)
                sets = shingle_sets(part)
                ok = [fingerprint(s) == (a, b) for s, a, b in zip(sets, own["set_a"], own["set_b"], strict=True)]
                yield pd.DataFrame({"node": own["node"][ok], "set": [s.tobytes() for s, fits in zip(sets, ok, strict=True) if fits]})

    sets = settle(texts.mapInPandas(hashed, "node long, set binary"))
    return sets if sets.count() <= n else settle(sets.dropDuplicates(["node"]))


def confirm_stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar, where few different a have many b.

    A pivot's pairs are dealt into groups of about STAR rows, each with one copy of the pivot's set before the others', so that
    no key is hot and a task holds a batch of sets at a time."""
    cut = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("groups"))
    at = lambda k: sets.select(F.col("node").alias(k), "set")
    pivots = cut.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).join(at("a"), "a").select("a", "group", F.lit(-1).cast("long").alias("b"), "set")
    others = pairs.join(cut, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"), "b").join(at("b"), "b").select("a", "group", "b", "set")
    met = pivots.union(others).repartition("a", "group").sortWithinPartitions("a", "group", "b")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, s in zip(batch["a"], batch["b"], batch["set"], strict=True):
                if b < 0:
                    own = np.frombuffer(s, np.uint64)
                elif similar(own, np.frombuffer(s, np.uint64), percent):
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"])

    return settle(met.select("a", "b", "set").mapInPandas(checked, "a long, b long"))


def join_components(g: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between similar rows of different components, at most one for each two components: rows (node, component, n,
    sketch, set). What a link joins is one component for the rest of the block."""
    nodes, n, bits = g["node"].to_numpy(), g["n"].to_numpy(), _bits(g["sketch"])
    label = np.unique(g["component"].to_numpy(), return_inverse=True)[1]
    sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
    later = np.arange(len(g))
    links = []
    for at in range(0, len(g), AT_ONCE):
        if (label == label[0]).all():
            break
        own = slice(at, at + AT_ONCE)
        ok = (label[own, None] != label) & (later[own, None] < later) & (np.minimum(n[own, None], n) * 100 >= np.maximum(n[own, None], n) * percent)
        x, y = np.nonzero(ok)
        if not len(x):
            continue
        near = may_reach(np.bitwise_count(bits[at + x] ^ bits[y]).sum(axis=1), n[at + x], n[y], percent)
        for i, j in zip((at + x[near]).tolist(), y[near].tolist(), strict=True):
            if label[i] != label[j] and similar(sets[i], sets[j], percent):
                label[label == label[j]] = label[i]
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def possible(g: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows (node, component, n, sketch) of a group have a row of another component that sketches leave similar."""
    n, bits, component = g["n"].to_numpy(), _bits(g["sketch"]), g["component"].to_numpy()
    found, later = np.zeros(len(g), bool), np.arange(len(g))
    for at in range(0, len(g), AT_ONCE):
        own = slice(at, at + AT_ONCE)
        x, y = np.nonzero((component[own, None] != component) & (later[own, None] < later) & (np.minimum(n[own, None], n) * 100 >= np.maximum(n[own, None], n) * percent))
        if len(x):
            near = may_reach(np.bitwise_count(bits[at + x] ^ bits[y]).sum(axis=1), n[at + x], n[y], percent)
            found[at + x[near]] = found[y[near]] = True
    return found


GROUP = ["key", "kind", "i", "j"]


def by_group(rows: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """work(rows of a group) of every group; a group meets in one task, and only one is held at a time."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            new = (batch[GROUP] != batch[GROUP].shift()).any(axis=1).to_numpy()
            starts = np.append(np.flatnonzero(new), len(batch))
            for s, e in zip(starts[:-2], starts[1:-1], strict=True):
                yield work(batch.iloc[s:e])
            rest = batch.iloc[starts[-2] :]  # the last of a batch waits for the next
        if rest is not None:
            yield work(rest)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).select(*GROUP, *columns).mapInPandas(runs, schema)


def deal(rows: DataFrame) -> DataFrame:
    """(key, kind, i, j, node, component): the groups in which nodes (key, node, component, n) of a bucket meet.

    Blocks of a bucket's largest component meet those of its other nodes, and these meet each other; a block has about BLOCK
    rows with BLOCK_HASHES hashes."""
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("count"), F.sum("n").alias("hashes"))
    by_bucket = sizes.groupBy("key").agg(F.max(F.struct("count", "hashes", "component")).alias("top"), F.sum("count").alias("count"), F.sum("hashes").alias("hashes"))
    cut = lambda n, h: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(h / BLOCK_HASHES)).cast("int")
    plan = by_bucket.select("key", F.col("top.component").alias("top"), cut(F.col("top.count"), F.col("top.hashes")).alias("n_top"), cut(F.col("count") - F.col("top.count"), F.col("hashes") - F.col("top.hashes")).alias("n_rest"))
    dealt = rows.select("key", "node", "component").join(plan, "key").withColumn("is_top", F.col("component") == F.col("top"))
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("n_top")).otherwise(F.col("n_rest"))).cast("int")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    # (0, block of the top component, block of the rest), where the rest's block also meets itself, and (1, lower, higher block of the rest).
    groups = F.when(F.col("is_top"), F.transform(each(F.col("n_rest")), lambda j: group(0, F.col("mine"), j))).otherwise(
        F.concat(
            F.transform(each(F.col("n_top")), lambda i: group(0, i, F.col("mine"))),
            F.transform(F.filter(each(F.col("n_rest")), lambda j: j != F.col("mine")), lambda j: group(1, F.least(F.col("mine"), j), F.greatest(F.col("mine"), j))),
        )
    )
    return dealt.withColumn("mine", mine).select("key", "node", "component", F.explode(groups).alias("g")).select("key", "g.*", "node", "component")


def block_candidates(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of `deal` that sketches leave a partner in their group; nodes: (node, n, sketch)."""
    told = lambda g: g.loc[possible(g, percent), [*GROUP, "node", "component"]]
    with_sketch = deal(rows).join(nodes.select("node", "n", "sketch"), "node")
    return settle(by_group(with_sketch, ["node", "component", "n", "sketch"], told, "key long, kind int, i int, j int, node long, component long"))


def block_links(candidates: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a group's candidates which have similar sets; sets: (node, set)."""
    told = lambda g: pd.DataFrame(join_components(g, percent), columns=["a", "b"], dtype=np.int64)
    whole = candidates.join(nodes.select("node", "n", "sketch"), "node").join(sets, "node")
    return settle(by_group(whole, ["node", "component", "n", "sketch", "set"], told, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept, first, row) of every row: the groups linked by 100 x intersection >= percent x union.

    A text that is null, empty or without words has no shingles and is linked with nothing. Rows with equal sets are always
    linked. component_id is the smallest key in reach, or null if no row of the group has one; kept tells the rows that bear
    it, and first those equal to one chosen row of the group (that with the smallest key), which row_hash finds again. Rows that
    repeat a key with other texts are rows of their own. An empty table gives an empty result."""
    ship(docs.sparkSession)
    rows = settle(text_sketches(docs, key, text))
    full = rows.where("n_shingles > 0")
    least = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    numbered = full.groupBy("set_a", "set_b").agg(F.min(least).alias("least"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"), F.max("n_shingles").alias("n"))
    nodes = settle(numbered.withColumn("node", F.monotonically_increasing_id()))  # written once, so numbers stay
    entries = nodes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    members = settle(entries.join(shared, "key"))
    sketch = lambda k, n, s: nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("sketch").alias(s))
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct().join(sketch("a", "n_a", "s_a"), "a").join(sketch("b", "n_b", "s_b"), "b")
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    pairs = settle(stars.where(sized).where(may_be_similar(percent)("s_a", "n_a", "s_b", "n_b")).select("a", "b"))
    wanted = lambda ids: settle(nodes.join(ids.distinct(), "node", "left_semi").select("node", F.col("least.row").alias("row"), "set_a", "set_b"))
    met = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = full_sets(wanted(met), docs, key, text)
    links = confirm_stars(pairs, sets, percent)
    labelled = members.select("key", "node").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo <> _hi").select("key")
    left = settle(labelled.join(mixed, "key", "left_semi").join(nodes.select("node", "n"), "node"))
    candidates = block_candidates(left, nodes, percent)
    more_sets = full_sets(wanted(candidates.select("node").join(met, "node", "left_anti")), docs, key, text)
    final = components(links.union(block_links(candidates, nodes, sets.union(more_sets), percent)))
    owned = nodes.select("set_a", "set_b", "node", "least").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    owned = settle(owned)
    chosen = owned.groupBy("component").agg(F.min("least").alias("chosen"))
    own = owned.join(chosen, "component").select("set_a", "set_b", "chosen")
    out = rows.select("id", "row", "n_shingles", "set_a", "set_b").join(own, ["set_a", "set_b"], "left")
    in_group = F.col("n_shingles") > 0
    component = F.when(in_group, F.col("chosen.id")).otherwise(F.col("id"))
    first = F.when(in_group, F.col("row") == F.col("chosen.row")).otherwise(True)
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), first.alias("first"), "row").withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op3_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, group and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))
