"""Streaming queries: the event log as a file stream, run over what it holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ingest as I
from ..streaming import links
from ..streaming import windows as S
from ..streaming.commits import CommittedTables
from ..streaming.sessions import apply_once, run_available, stream_folder
from .activity import COUNTERS_SQL, CRAFT_SQL
from .documents import KINDS, LINE
from .inputs import EVENTS_SQL, GAP, epoch_us, events, table
from .registry import query


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    folder = sf_dir.rstrip("/")
    files = spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]")
    return files.select("user_id", "event_id", F.floor(epoch_us("ts") / 1000000).cast("long").alias("t"))


@query(f"WITH {COUNTERS_SQL} SELECT user_id, session, started_at, last_ts, seconds, events FROM counted")
def t1_stateful_stream(spark, sf_dir):
    """Sessions by keyed state over a stream, equal to those of the batch."""
    return run_available(event_stream(spark, sf_dir), GAP)


@query(f"WITH {EVENTS_SQL} SELECT t // 86400 * 86400 AS start, count(*) AS n FROM ev GROUP BY 1")
def t4_tumbling_windows(spark, sf_dir):
    """Events of each day by a watermarked stream."""
    at = event_stream(spark, sf_dir).withColumn("at", F.timestamp_seconds("t"))
    return S.available_rows(S.window_counts(at, "at", "1 day", "2 hours", []), "update").groupBy("start").agg(F.max("n").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT (t // 21600 - b) * 21600 AS start, count(*) AS n FROM ev, range(4) r(b) GROUP BY 1")
def t4_sliding_windows(spark, sf_dir):
    """Events of each day that begins every six hours, by a watermarked stream."""
    at = event_stream(spark, sf_dir).withColumn("at", F.timestamp_seconds("t"))
    return S.available_rows(S.window_counts(at, "at", "1 day", "2 hours", [], "6 hours"), "update").groupBy("start").agg(F.max("n").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT user_id, event_id, t FROM ev")
def t11_drop_replays(spark, sf_dir):
    """A stream that is fed twice keeps one row of each event."""
    twice = event_stream(spark, sf_dir).union(event_stream(spark, sf_dir)).withColumn("at", F.timestamp_seconds("t"))
    return S.available_rows(S.drop_replays(twice, ["user_id", "event_id"], "at", "1 day"), "append").select("user_id", "event_id", "t")


_TYPES = f"CASE l_orderkey % {len(KINDS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(KINDS) if k) + " END"


@query(f"""SELECT type, n FROM (SELECT {_TYPES} AS type, count(*) AS n FROM lineitem GROUP BY 1) WHERE type IS NOT NULL
  UNION ALL SELECT '(bytes)', CAST(sum(strlen({LINE}) + 1) AS BIGINT) FROM lineitem""")
def s3_live_tail(spark, sf_dir):
    """Landed logs followed by the stream that commits events and places: the types found, and the bytes read."""
    folder = stream_folder(spark)
    table(spark, sf_dir, "lineitem").select(F.expr(LINE)).write.text(f"{folder}/logs")
    tables = CommittedTables(spark, f"{folder}/tables")
    I.ingest(spark, f"{folder}/logs", tables, f"{folder}/checkpoint").awaitTermination()
    found = I.events(tables).groupBy("type").agg(F.count("*").alias("n"))
    return found.union(I.places(tables).agg(F.lit("(bytes)").alias("type"), F.sum("next").alias("n")))


@query(f"WITH {CRAFT_SQL} SELECT user_id, event_id, capped, voter, voted_item FROM linked WHERE craft OR skillup")
def t5_links_across_batches(spark, sf_dir):
    """The links of j15 out of a stream in three runs: each goes on from the state that the one before it left open."""
    kind = F.expr("CASE event_type WHEN 'click' THEN 'craft' WHEN 'view' THEN 'notice' WHEN 'signup' THEN 'skill' END")
    rows = events(spark, sf_dir).select("user_id", "event_id", "t", kind.alias("kind"), (F.col("k") % 7).alias("item"), (F.col("k") % 3).alias("skill")).where("kind IS NOT NULL")
    low, high = rows.agg(F.min("event_id"), F.max("event_id")).first()
    folder, step = stream_folder(spark), ((high or 0) - (low or 0)) // 3 + 1
    for n in range(3):
        rows.where(F.expr(f"(event_id - {low or 0}) div {step} = {n}")).write.mode("append").parquet(f"{folder}/events")
        stream = links.live_craft_links(spark.readStream.schema(links.EVENTS).parquet(f"{folder}/events"), 7200)
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        writer.foreachBatch(apply_once(f"{folder}/rows")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(links.LINKED).parquet(f"{folder}/rows").drop("batch")
