"""Stream windows and replays over several micro-batches."""

import os

from lanternlog.streaming import windows as S
from pyspark.sql import functions as F

HOUR = 3600


def stream_of(spark, folder, batches):
    """A stream that reads one file of (k, t) a batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "k long, t long").coalesce(1).write.parquet(f"{folder}/raw{n}")
        part = next(f for f in os.listdir(f"{folder}/raw{n}") if f.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.replace(f"{folder}/raw{n}/{part}", f"{folder}/in/{n}.parquet")
        os.utime(f"{folder}/in/{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    files = spark.readStream.schema("k long, t long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return files.withColumn("at", F.timestamp_seconds("t"))


def test_late_rows_are_dropped(spark, tmp_path):
    """A watermark that one batch has raised drops rows two batches later."""
    stream = stream_of(spark, tmp_path, [[(1, HOUR), (2, HOUR + 5), (3, 10 * HOUR)], [(5, 10 * HOUR + 1)], [(4, HOUR + 9), (6, 9 * HOUR + 60)]])
    rows = S.available_rows(S.window_counts(stream, "at", "1 hour", "1 hour", []), "update")
    got = {r.start: r.n for r in rows.groupBy("start").agg(F.max("n").alias("n")).collect()}
    assert got == {HOUR: 2, 10 * HOUR: 2, 9 * HOUR: 1}


def test_replays_across_batches(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[(1, 100), (2, 200), (1, 100)], [(2, 200), (3, 300), (1, 100)], [(3, 300)]])
    rows = S.available_rows(S.drop_replays(stream, ["k", "t"], "at", "1 hour"), "append")
    assert sorted((r.k, r.t) for r in rows.collect()) == [(1, 100), (2, 200), (3, 300)]
