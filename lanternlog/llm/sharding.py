"""Sharding by a keyed Feistel permutation of global row numbers.

Rows get gapless numbers in the order of their keys; a balanced Feistel network permutes the smallest even-bit domain
that holds them, and walks a value on along its cycle until it falls below the row count. The result is a permutation of
0..n-1, so any worker can compute where row i goes (and, by the inverse, which row stands in a slot) without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, ship, table

#: 64-bit odd constants that mix a round's half and its key (fixed values of a public mixing function).
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, ROUNDS, dtype=np.uint64)


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _mix(half: np.ndarray, key: np.uint64) -> np.ndarray:
    x = half + key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, keys: np.ndarray, bits: int, back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Places of row numbers below n under the permutation (back: the row numbers of places)."""
    keys, bits = _round_keys(seed), _half_bits(n)
    out = _network(rows.astype(np.uint64), keys, bits, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _network(out[far], keys, bits, back)
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Adds gapless numbers from 0 in the order of the columns, and counts the rows; equal rows are interchangeable.

    Range partitions are sorted and written once, then each adds the row count of those before it; only one count for
    each partition is gathered in a single place."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = settle(
        df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = {r[0]: r[1] for r in sorted_rows.groupBy("_part").count().collect()}  # a number for each partition
    before, start = 0, []
    for p in sorted(counts):
        start.append((p, before))
        before += counts[p]
    starts = spark.createDataFrame(start, "_part int, _start long")
    return sorted_rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), before


def feistel_shards(df: DataFrame, order: list[str], shards: int, seed: int = 20240601) -> DataFrame:
    """Adds row_number, place, shard and slot to df.

    place is a seeded permutation of the row numbers; shard = place mod shards and slot = place div shards, so shard
    sizes differ by one row at most, slots are gapless, and row i's shard and slot follow from (i, rows, seed) alone.
    Nulls sort first; rows equal in every ordering column are interchangeable; an empty table gives an empty result."""
    ship(df.sparkSession)
    numbered, n = number_rows(df, order)

    @F.pandas_udf(T.LongType())
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return numbered.withColumn("place", place("row_number")).withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}"))


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and slot, under the law `rows`."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
    )
    return feistel_shards(docs, ["doc_id", "text_crc32", "size"], 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
