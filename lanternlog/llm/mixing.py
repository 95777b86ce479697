"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents fall into at most `blocks` hash blocks, so a block's place in its source's permutation is its
number. A source's target gives whole passes over all its blocks and one partial pass, which walks the permuted blocks and
takes each that still fits. The drawn blocks of all sources are then split among the output shards: at every node of a
binary tree the left half's blocks are drawn without replacement from the node's quotas, a multivariate hypergeometric
draw, until each shard has an exact quota of each source; consecutive disjoint runs of the permuted draws fill the quotas,
and rows are shuffled inside their shard.

Only tables with a row for each source and block (at most `blocks` for a source) leave the rows' own partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, table, word_count

#: Weights of the sources in code-point order, repeating, and the share of all sizes that the mix has.
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2.0
BLOCKS = 2048
SHARDS = 16
SEED = 7
#: Block rows up to which the plan of blocks is broadcast; beyond it the rows are joined by a shuffle.
MOST_BROADCAST = 200_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, repeats: float = MOST_REPEATS) -> DataFrame:
    """Targets of a table (source, source_size): share of all sizes by weight, stopped at repeats times a source's size.

    Filling by weight until a source is full is the same as giving each source min(repeats x size, level x weight); the
    level follows from running sums over the sources in the order in which they fill up. Sources are sorted by code point,
    null last; if all sources together can't hold the share, each is full."""
    by_code = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    fill = W.orderBy("full_at", "rank")
    every = W.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_code) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    most = F.col("source_size") * F.lit(float(repeats))
    sums = (
        ranked.withColumn("full_at", most / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum(most).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("filled")) / F.col("open_weight"))
    )
    # The level holds at the first source that it does not fill.
    level = F.coalesce(F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank"))).over(every), F.lit(float("inf")))
    return sums.select("source", "source_size", "rank", F.least(most, level * F.col("weight")).alias("target"))


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources); shard totals differ by one at most."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    # Shards before the remainder hold one block more, so the left half's total is exact.
    take = left * (total // shards) + min(left, total % shards)
    drawn, rest, missing = np.zeros_like(counts), total, take
    for i, n in enumerate(counts.tolist()):  # one hypergeometric margin after the other
        rest -= n
        drawn[i] = int(rng.hypergeometric(n, rest, missing)) if missing and n else 0
        missing -= int(drawn[i])
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(counts - drawn, shards - left, rng)])


def draw_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of each block of one source: whole passes for all, one more for those that fit in the rest of the target, and
    for the smallest of the others if the mix then comes nearer to the target."""
    pdf = pdf.sort_values("block")
    size, target = float(pdf["words"].sum()), float(pdf["target"].iloc[0])
    passes = int(target // size) if size else 0
    rest, copies = target - passes * size, []
    for words in pdf["words"]:
        extra = 0 < words <= rest
        rest -= words if extra else 0
        copies.append(passes + extra)
    left = [(words, i) for i, (words, c) in enumerate(zip(pdf["words"], copies, strict=True)) if words > 0 and c == passes]
    if left and rest > 0 and min(left)[0] < 2 * rest:
        copies[min(left)[1]] += 1
    return pdf[["rank", "block"]].assign(copies=copies)


def plan_mix(docs: DataFrame, source: str, size: str, block: str, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, rank, target) of each source, and (rank, block, copy, shard) of each drawn block."""
    spark = docs.sparkSession
    blocks = settle(docs.groupBy(F.col(source).alias("source"), F.col(block).alias("block")).agg(F.sum(size).cast("long").alias("words")))
    targets = settle(source_targets(blocks.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))))
    planned = blocks.join(targets, blocks["source"].eqNullSafe(targets["source"])).select("rank", "block", "words", "target")
    drawn = settle(planned.groupBy("rank").applyInPandas(draw_blocks, "rank int, block int, copies int").where("copies > 0").select("rank", "block", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")))
    # A number for each source goes to the driver: how many blocks it gives.
    counts = drawn.groupBy("rank").count().orderBy("rank").collect()
    quotas = split_quotas(np.array([r[1] for r in counts], np.int64), shards, np.random.Generator(np.random.PCG64(seed)))
    ends = [(int(r[0]), s, int(e)) for i, r in enumerate(counts) for s, e in enumerate(np.cumsum(quotas[:, i]))]
    until = spark.createDataFrame(ends, "rank int, shard int, until long").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("until", "shard"))).alias("ends"))
    at = F.row_number().over(W.partitionBy("rank").orderBy("copy", "block"))
    placed = drawn.withColumn("at", at).join(until, "rank").withColumn("shard", F.filter("ends", lambda e: e.until >= F.col("at"))[0].shard)
    return targets, placed.select("rank", "block", "copy", "shard")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(docs with their size, target and drawn copies, the mix): the columns that are added begin with `_`.

    The first has every row with _size (words), _source_size, _target and _copies, an array of structs (copy, shard), null
    where nothing is drawn. The second has a row for each drawn copy with its _shard and _order, by which a shard is
    sorted; a row comes twice at most. Blocks follow from the key and the length of the text, so reruns agree; a null text
    has no words and is never drawn; a null source is a source of its own, last in code-point order; rows with equal keys
    and lengths share a block; an empty table gives an empty mix."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.octet_length(text)), F.lit(BLOCKS)).cast("int")
    sized = docs.withColumns({"_size": word_count(F.col(text)), "_block": block})
    targets, drawn = plan_mix(sized, source, "_size", "_block", shards, seed)
    ranked = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("rank").alias("_rank"), F.col("target").alias("_target"))
    copies = drawn.groupBy(F.col("rank").alias("_rank"), F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("_copies"))
    rows = sized.join(_small(ranked), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.join(_small(settle(copies)), ["_rank", "_block"], "left")
    mixed = rows.where(F.col("_size") > 0).withColumn("_copies", F.explode("_copies")).withColumn("_shard", F.col("_copies.shard"))
    return rows, mixed.withColumn("_order", F.xxhash64(F.lit(seed + 1), F.col(key), F.col("_copies.copy"), F.col("_rank")))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix in its shards' seeded order: a partition holds a slice of a shard's order."""
    return mixed.repartition("_shard", F.shiftrightunsigned("_order", 58)).sortWithinPartitions("_shard", "_order")


def op6_split_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it, repeats counted."""
    rows, _ = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    copies = F.coalesce(F.size("_copies"), F.lit(0))
    return rows.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.when(copies > 0, copies).otherwise(0)).cast("long").alias("taken"),
        F.col("_copies.shard").alias("shards"),
    )
