"""Fights over a stream: meters kept by key, closed by a death, by the log's clock, or by a timer when the log falls silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.fights import IDLE, LEAST_SECONDS
from .links import in_order, keep_state_in_files

FIGHTS = "character long, fight long, name long, start long, last long, seconds long, damage long, healing long, tanking long, dps double, meters array<struct<meter:string,actor:long,total:long,hits:long>>"
_COLUMNS = [c.split()[0] for c in FIGHTS.split(", ")[:10]] + ["meters"]


class FightTracker(StatefulProcessor):
    """An open fight is a value, its enemies and its meters are maps; the clock outlives fights."""

    def __init__(self, idle: int, silent: int):
        self.idle, self.silent = idle, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "t long")
        self.fight = handle.getValueState("fight", "first long, name long, start long, last long")
        self.enemies = handle.getMapState("enemies", "enemy long", "last long")
        self.meters = handle.getMapState("meters", "meter string, actor long", "total long, hits long")

    def _close(self, key, fight, meters: dict) -> tuple:
        first, name, start, last = fight
        total = lambda kind: sum(t for (m, _), (t, _) in meters.items() if m == kind)
        seconds = last - start
        rate = float(int(total("damage") / max(seconds, LEAST_SECONDS) * 10 + 0.5)) / 10
        rows = [{"meter": m, "actor": a, "total": t, "hits": n} for (m, a), (t, n) in sorted(meters.items())]
        return (key[0], first, name, start, last, seconds, total("damage"), total("heal"), total("tanking"), rate, rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.clock.get()
        clock = known[0] if known else None
        fight = self.fight.get()
        enemies = {k[0]: v[0] for k, v in self.enemies.iterator()} if fight else {}
        meters = {tuple(k): tuple(v) for k, v in self.meters.iterator()} if fight else {}
        out = []
        events = in_order(rows, "line")
        for line, t, kind, actor, enemy, amount in events[["line", "t", "kind", "actor", "enemy", "amount"]].itertuples(index=False):
            clock = t if clock is None else max(clock, t)
            if fight:
                enemies = {e: at for e, at in enemies.items() if clock - at <= self.idle}
                if not enemies:
                    out.append(self._close(key, fight, meters))
                    fight, meters = None, {}
            if kind in ("damage", "tanking") or (kind == "kill" and enemy in enemies):
                fight = (*(fight[:3] if fight else (int(line), int(enemy), int(clock))), int(clock))
                enemies[enemy] = clock
            elif kind == "heal" and fight:
                fight = (*fight[:3], int(clock))
            else:
                continue
            if kind == "kill":
                del enemies[enemy]
                if not enemies:
                    out.append(self._close(key, fight, meters))
                    fight, meters = None, {}
            else:
                at = (kind, int(enemy if kind == "tanking" else actor))
                total, hits = meters.get(at, (0, 0))
                meters[at] = total + int(amount), hits + 1
        self._keep(clock, fight, enemies, meters)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if fight:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.silent)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    def _keep(self, clock, fight, enemies: dict, meters: dict) -> None:
        if clock is not None:
            self.clock.update((int(clock),))
        self.enemies.clear()
        self.meters.clear()
        if not fight:
            self.fight.clear()
            return
        self.fight.update(fight)
        for e, at in enemies.items():
            self.enemies.updateValue((int(e),), (int(at),))
        for (meter, actor), value in meters.items():
            self.meters.updateValue((meter, actor), value)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The log has been silent: what is open ends with what was seen of it."""
        fight = self.fight.get()
        if fight:
            row = self._close(key, fight, {tuple(k): tuple(v) for k, v in self.meters.iterator()})
            self._keep(None, None, {}, {})
            yield pd.DataFrame([row], columns=_COLUMNS)

    def close(self) -> None:
        pass


def live_fights(events: DataFrame, idle: int = IDLE, silent: int = IDLE) -> DataFrame:
    """A row for each fight that ends, with its meters, from a stream (character, line, t, kind, actor, enemy, amount).

    The rule is that of operators.fights; a fight that is open when nothing comes for `silent` seconds of wall-clock time ends
    then, so a later line of a silent log begins another."""
    keep_state_in_files(events.sparkSession)
    return events.groupBy("character").transformWithStateInPandas(FightTracker(idle, silent), FIGHTS, "append", "processingTime")
