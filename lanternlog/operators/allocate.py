"""Allocation of shared supply in priority order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def greedy_allocation(needs: DataFrame) -> DataFrame:
    """(pool, row, priority, served) for needs (pool, row, priority, open, alias, want, have).

    Inside a pool the open rows are served in the order of priority, then row. Needs of the same alias share its stock, `have`; a
    row is served only if the stock that is left covers all its needs, which it then takes whole, and else takes nothing. Each
    step depends on those before it, so a pool (one character's needs) is served by one task, whose rows come in that order: the
    task holds what is left of the pool at hand, and no pool's rows. Pools are independent."""
    stock = needs.withColumn("have", F.max("have").over(W.partitionBy("pool", "alias")))
    need = F.when(F.col("alias").isNotNull(), F.struct("alias", F.coalesce("want", F.lit(0)).alias("want"), "have"))
    rows = stock.groupBy("pool", "priority", "row").agg(F.first("open").alias("open"), F.collect_list(need).alias("needs"))
    dealt = rows.repartition("pool").sortWithinPartitions("pool", "priority", "row")
    return dealt.mapInArrow(serve, "pool long, row long, priority long, served boolean")


def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Serves rows that come by pool, priority and row; a pool may go on in the next batch."""
    pool, left = None, {}
    for batch in batches:
        flat = batch["needs"].flatten()
        needs = zip(*(flat.field(k).to_pylist() for k in ("alias", "want", "have")), strict=True)
        out = []
        for at, is_open, n in zip(batch["pool"].to_pylist(), batch["open"].to_pylist(), pc.list_value_length(batch["needs"]).to_pylist(), strict=True):
            if at != pool:
                pool, left = at, {}
            asked = {}
            for _ in range(n):
                alias, want, have = next(needs)
                left.setdefault(alias, have)
                asked[alias] = asked.get(alias, 0) + want
            served = bool(is_open) and all(left[a] is not None and left[a] >= w for a, w in asked.items())
            if served:
                for a, w in asked.items():
                    left[a] -= w
            out.append(served)
        yield pa.RecordBatch.from_arrays([*(batch[k].cast(pa.int64()) for k in ("pool", "row", "priority")), pa.array(out, pa.bool_())], ["pool", "row", "priority", "served"])
