"""Live sessions: state kept by character, batches applied once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, session long, started_at long, last_ts long, seconds long, events long"
STATE = "session long, started_at long, last_ts long, seconds long, events long"


def live_sessions(events: DataFrame, gap: int = 1800) -> DataFrame:
    """The current row of each session that a micro-batch touches, from a stream (user_id, event_id, t).

    Order inside a batch is that of event_id; the clock compares with the event before it even if time runs backwards. The
    state is the open session, so a restart goes on where the checkpoint ends. Use it in update mode and keep the last row
    of each (user_id, session)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, started, last, seconds, n = state.get if state.exists else (-1, 0, None, 0, 0)
        touched: dict[int, tuple] = {}
        for t in pd.concat(list(batches)).sort_values("event_id")["t"].tolist():
            since = None if last is None else t - last
            if since is None or since > gap:
                session, started, seconds, n = session + 1, t, 0, 0
            elif since > 0:
                seconds += since
            last, n = t, n + 1
            touched[session] = (key[0], session, started, last, seconds, n)
        state.update((session, started, last, seconds, n))
        yield pd.DataFrame(list(touched.values()), columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return events.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def apply_once(path: str):
    """A foreachBatch function that writes each batch under its number, so that a batch that is replayed replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return write


def stream_folder(spark) -> str:
    """A new folder for a stream's checkpoint and output, under the session's shared checkpoint folder; only a local master may
    lack one."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4()}"


def run_available(events: DataFrame, gap: int) -> DataFrame:
    """Runs the live query over what a stream holds now, and returns the last state of each session."""
    spark = events.sparkSession
    folder = stream_folder(spark)
    live_sessions(events, gap).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(apply_once(f"{folder}/rows")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{OUTPUT}, batch string").parquet(f"{folder}/rows")
    last = rows.groupBy("user_id", "session").agg(F.max(F.struct("events", "started_at", "last_ts", "seconds")).alias("r"))
    return last.select("user_id", "session", "r.started_at", "r.last_ts", "r.seconds", "r.events")
