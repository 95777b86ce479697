"""Links of crafts, cap notices and skill-ups over a stream: what one batch leaves open, the next one closes."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..workers import reach

#: Event rows: character, the line's order, seconds, what it is (craft, notice or skill), its item or skill.
EVENTS = "user_id long, event_id long, t long, kind string, item long, skill long"
LINKED = "user_id long, event_id long, capped boolean, voter long, voted_item long"
LINKED_ROW = Row(*(c.split()[0] for c in LINKED.split(", ")))
#: What is open for a character: its last craft, a notice that no craft has used, a skill-up that waits for its craft.
OPEN = "user_id long, craft_item long, craft_t long, notice_t long, wait_skill long, wait_t long"


def keep_state_in_files(spark: SparkSession) -> None:
    """State of several values needs the store that keeps it in files rather than in the JVM's heap."""
    reach(spark).conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_order(batches: Iterator[pd.DataFrame], order: str = "event_id") -> pd.DataFrame:
    """One character's rows of a micro-batch by line. The source bounds what a batch holds."""
    frames = list(batches)
    return pd.concat(frames).sort_values(order, kind="stable") if frames else pd.DataFrame({order: []})


def lines_in_order(rows: Iterator[Row]) -> list[tuple]:
    """(event_id, t, kind, item, skill) of one character's rows of a micro-batch by line. The source bounds what a batch holds."""
    held = list(rows)
    if not held:
        return []
    names = held[0].__fields__
    return sorted(map(itemgetter(*map(names.index, ("event_id", "t", "kind", "item", "skill"))), held), key=itemgetter(0))


class CraftLinks(StatefulProcessor):
    """Rows and not frames come and go: a character brings few of them in a batch, and a frame takes longer to make than they do.
    Three values for each character, each kept by itself: a flush between a notice and its craft changes nothing."""

    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.craft = handle.getValueState("craft", "item long, t long")
        self.notice = handle.getValueState("notice", "t long")
        self.waiting = handle.getValueState("waiting", "skill long, t long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Goes on from what a stored table says is open."""
        r = initialState
        for state, value in ((self.craft, (r.craft_item, r.craft_t)), (self.notice, (r.notice_t,)), (self.waiting, (r.wait_skill, r.wait_t))):
            if value[-1] is not None:
                state.update(value)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = craft, notice, waiting = self.craft.get(), self.notice.get(), self.waiting.get()
        near = lambda at, t: at is not None and 0 <= t - at[-1] <= self.within
        out = []
        for line, t, kind, item, skill in lines_in_order(rows):
            if kind == "notice":
                notice = (t,)
            elif kind == "craft":
                out.append((key[0], line, near(notice, t), waiting[0] if near(waiting, t) else None, None))
                craft, notice, waiting = (item, t), None, None
            elif near(craft, t):
                out.append((key[0], line, None, None, craft[0]))
            else:
                waiting = (skill, t)
                out.append((key[0], line, None, None, None))
        for state, old, value in zip((self.craft, self.notice, self.waiting), found, (craft, notice, waiting), strict=True):
            if value is not None and value != old:
                state.update(value)
            elif value is None and old is not None:
                state.clear()
        yield from (LINKED_ROW(*r) for r in out)

    def close(self) -> None:
        pass


def live_craft_links(events: DataFrame, within: int = 1, opened: DataFrame | None = None) -> DataFrame:
    """LINKED rows of a stream of EVENTS, for every craft and skill-up as it comes; the rule is that of operators.craft_links.

    opened has the state to begin with (OPEN), for a stream that takes over from a stored history; it is read by the first batch."""
    keep_state_in_files(events.sparkSession)
    seeds = None if opened is None else opened.groupBy("user_id")
    return events.groupBy("user_id").transformWithState(CraftLinks(within), LINKED, "append", "none", seeds)
