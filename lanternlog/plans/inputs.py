"""The driver's tables in the roles of an activity log: who, which line, when, what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reach

#: Gap that parts sessions in the queries over `events`, whose users act every few hours.
GAP = 21600
#: Event types by role.
ROLE = {"view": "zone", "click": "damage", "purchase": "loot", "signup": "skill", "error": "death"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as shuffles have, for work on small rows that takes long: a file of few row groups gives few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def cents(money: str) -> Column:
    return (F.col(money).cast("decimal(18,2)") * 100).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id (the line number), t (seconds), event_type, cents, k (the bucket in props)."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.floor(epoch_us("ts") / 1000000).cast("long").alias("t"),
        "event_type",
        cents("value").alias("cents"),
        F.from_json("props", "k int").getField("k").cast("long").alias("k"),
    )


#: The same for DuckDB.
EVENTS_SQL = """ev AS (
  SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, event_type,
    CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, CAST(props->>'$.k' AS BIGINT) AS k
  FROM events)"""
SESSIONS_SQL = (
    EVENTS_SQL
    + """,
gapped AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM ev),
sess AS (
  SELECT *, CAST(sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS session,
    CASE WHEN gap > 0 AND gap <= 21600 THEN gap ELSE 0 END AS active
  FROM gapped)"""
)
