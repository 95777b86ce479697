"""Logs into a table of events: live batches, resets and revisions, each one commit.

The stream commits every batch's events together with each log's place. A log that starts afresh cuts what was derived from
it. When the grammar learns to read a type better, its revision rises; only such types are then read again, up to the places
that the stream has reached, and replace what was known of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import FIELDS, parse_events
from ..sources.tail import landed, tail
from .commits import CommittedTables

EVENTS = "path string, offset long, ts timestamp, type string, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items())
PLACES = "path string, next long"
Parse = Callable[[DataFrame], DataFrame]


def events_of(lines: DataFrame, parse: Parse = parse_events) -> DataFrame:
    """The events of log rows, under the path and the byte of their line."""
    return parse(lines.where("line IS NOT NULL").select("path", "offset", "line")).where("type IS NOT NULL").drop("line")


def apply_batch(tables: CommittedTables, batch: DataFrame, name: str, parse: Parse = parse_events) -> int | None:
    """One micro-batch as one commit: events, places, and cuts for logs that began afresh. What is collected is a path for each
    such log."""
    batch.persist()
    by_path = batch.groupBy("path").agg(F.max("next").alias("next"), F.bool_or("reset").alias("reset")).persist()  # a row for each log
    try:
        afresh = sorted(r.path for r in by_path.where("reset").select("path").collect())
        return tables.commit(name, {"events": events_of(batch, parse), "places": by_path.select("path", "next")}, {"path": afresh})
    finally:
        by_path.unpersist()
        batch.unpersist()


def ingest(spark: SparkSession, logs: str, tables: CommittedTables, checkpoint: str, parse: Parse = parse_events, trigger: dict | None = None):
    """Starts the stream that follows the logs of a folder; by default it ends when it has read what stands there now."""
    writer = tail(spark, logs).writeStream.option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda batch, n: apply_batch(tables, batch, f"{checkpoint} {n}", parse)).trigger(**(trigger or {"availableNow": True})).start()


def places(tables: CommittedTables) -> DataFrame:
    """(path, next): the byte up to which each log has been read."""
    return tables.read("places", PLACES).groupBy("path").agg(F.max("next").alias("next"))


def events(tables: CommittedTables, schema: str = EVENTS) -> DataFrame:
    return tables.read("events", schema)


def backfill(spark: SparkSession, logs: str, tables: CommittedTables, revisions: dict[str, tuple[int, list[str] | None]], parse: Parse = parse_events) -> list[str]:
    """Reads the types whose revision has risen again, up to the stream's places, and replaces what was known of them.

    revisions: {type: (revision, needles)}; only lines that hold one of the needles are parsed, all of them where a pending
    type has None. Types that were never revised stand at 0. Rows, cuts and the new revisions are one commit, so a pass that
    dies is simply made again, and a second pass does nothing. Returns the types."""
    known = tables.notes("revisions")
    pending = {t: r for t, r in revisions.items() if r[0] > known.get(t, 0)}
    if not pending:
        return []
    below = {r.path: r.next for r in places(tables).collect()}  # a number for each log
    note = {"revisions": {t: r for t, (r, _) in pending.items()}}
    name = "revisions " + ", ".join(f"{t} {r}" for t, (r, _) in sorted(pending.items()))
    if not below:
        tables.commit(name, {}, notes=note)
        return sorted(pending)
    lines = landed(spark, logs, below)
    if all(needles is not None for _, needles in pending.values()):
        gate = F.lit(False)
        for needle in sorted({n for _, needles in pending.values() for n in needles}):
            gate = gate | F.col("line").contains(needle)
        lines = lines.where(gate)
    again = events_of(lines, parse).where(F.col("type").isin(sorted(pending)))
    tables.commit(name, {"events": again}, {"type": sorted(pending)}, note)
    return sorted(pending)
