"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch that a Python worker gets at once; a longer row comes alone.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20
#: Root of the repository; Python workers need it on their path to unpickle functions by reference.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package also when the driver was started elsewhere, and bounds their batches by rows
    and bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share. Where it is unset one is made, but only for a local
    master, whose executors are threads of the driver; on a cluster that would be one machine's own disk."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it from there, so that lost executors recompute nothing before
    it. Unlike an eager checkpoint(), which runs its plan once to count the rows and again to write them, it runs it once."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
