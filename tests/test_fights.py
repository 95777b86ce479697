"""Fights, craft links and rosters against machines that read line by line, in batches, streams and restarts."""

import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lanternlog.operators import activity as A
from lanternlog.operators import fights as B
from lanternlog.operators import roster as R
from lanternlog.streaming import fights as L
from lanternlog.streaming import links as K
from lanternlog.streaming.sessions import apply_once

COMBAT = "character long, line long, t long, kind string, actor long, enemy long, amount long"


def combat(seed, n, characters=4):
    rnd, t, rows = random.Random(seed), {}, []
    for line in range(n):
        c = rnd.randrange(characters)
        t[c] = t.get(c, 1000) + rnd.choice([0, 1, 2, 5, 9, -3, 11, 40])
        kind = rnd.choice(["damage", "damage", "tanking", "heal", "kill"])
        rows.append((c, line, t[c], kind, rnd.randrange(3), rnd.randrange(3) if kind != "heal" else None, rnd.randrange(20)))
    return rows


def plain_fights(rows, idle):
    """A machine that reads line by line: what is open, and what each fight has seen."""
    out, state = [], {}

    def end(c, s):
        if s["fight"]:
            f = s["fight"]
            total = lambda k: sum(a for m, _, a in f["rows"] if m == k)
            meters = {}
            for m, who, a in f["rows"]:
                if m != "kill":
                    x = meters.setdefault((m, who), [0, 0])
                    x[0], x[1] = x[0] + a, x[1] + 1
            out.append((c, f["first"], f["name"], f["start"], f["last"], total("damage"), total("heal"), total("tanking"), tuple(sorted((*k, *v) for k, v in meters.items()))))
        s["fight"] = None

    for c, line, t, kind, actor, enemy, amount in rows:
        s = state.setdefault(c, {"clock": t, "open": {}, "fight": None})
        s["clock"] = max(s["clock"], t)
        s["open"] = {e: at for e, at in s["open"].items() if s["clock"] - at <= idle}
        if not s["open"]:
            end(c, s)
        if kind in ("damage", "tanking"):
            s["fight"] = s["fight"] or {"first": line, "name": enemy, "start": s["clock"], "rows": []}
            s["open"][enemy] = s["clock"]
        elif kind == "kill" and enemy not in s["open"] or kind == "heal" and not s["fight"]:
            continue
        s["fight"]["rows"].append((kind, enemy if kind == "tanking" else actor, amount))
        s["fight"]["last"] = s["clock"]
        if kind == "kill":
            del s["open"][enemy]
            if not s["open"]:
                end(c, s)
    for c, s in state.items():
        end(c, s)
    return sorted(out)


@pytest.mark.parametrize("idle", [0, 6, 30])
def test_fights_against_a_machine(spark, idle):
    rows = combat(idle, 900)
    df = spark.createDataFrame(rows, COMBAT).repartition(3)
    meters = {}
    for r in B.fight_meters(df, idle).collect():
        meters.setdefault((r.character, r.fight), []).append((r.meter, r.actor, r.total, r.hits))
    got = sorted((r.character, r.fight, r.name, r.start, r["last"], r.damage, r.healing, r.tanking, tuple(sorted(meters[r.character, r.fight]))) for r in B.fight_rows(df, idle).collect())
    assert got == plain_fights(rows, idle) and len(got) > 20
    assert B.fight_rows(df.where("false"), idle).count() == 0


def run_out(query, rows, seconds=60):
    """Runs a stream that never ends by itself, as its timers may fire, until it has read so many rows and made one more batch."""
    until = time.time() + seconds
    while time.time() < until and query.isActive:
        seen = query.recentProgress
        if sum(p["numInputRows"] for p in seen) >= rows and seen[-1]["numInputRows"] == 0:
            break
        time.sleep(0.1)
    query.stop()
    assert query.exception() is None and time.time() < until


def stream_in_parts(spark, folder, rows, schema, parts, start, timers=False):
    """Runs a stream over the rows' parts, each a new run under the same checkpoint: a restart between any two."""
    os.makedirs(f"{folder}/in")
    got = []
    for n, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{folder}/raw{n}")
        name = next(f for f in os.listdir(f"{folder}/raw{n}") if f.endswith(".parquet"))
        os.replace(f"{folder}/raw{n}/{name}", f"{folder}/in/{n}.parquet")
        stream = start(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(apply_once(f"{folder}/rows"))
        if timers:
            run_out(writer.trigger(processingTime="200 milliseconds").start(), len(part))
        else:
            writer.trigger(availableNow=True).start().awaitTermination()
    if os.path.exists(f"{folder}/rows"):
        got = spark.read.parquet(f"{folder}/rows").collect()
    return got


def test_live_fights_equal_the_batch(spark, tmp_path):
    idle, rows = 6, combat(3, 300, 2)
    late = [(c, 10_000 + c, 10**6, "heal", 0, None, 1) for c in (0, 1)]  # much later, so that all fights are over
    cuts = [range(100), range(100, 170), range(170, 300), range(300, 302)]
    got = stream_in_parts(spark, tmp_path, rows + late, COMBAT, cuts, lambda s: L.live_fights(s, idle, 3600), timers=True)
    shown = sorted((r.character, r.fight, r.name, r.start, r["last"], r.damage, r.healing, r.tanking, tuple(sorted(tuple(m) for m in r.meters))) for r in got)
    assert shown == plain_fights(rows, idle)
    rate = {(r.character, r.fight): r.dps for r in B.fight_rows(spark.createDataFrame(rows, COMBAT), idle).collect()}
    assert {(r.character, r.fight): r.dps for r in got} == rate


def test_a_silent_log_ends_its_fight(spark, tmp_path):
    """The second run brings lines of another character only; the first one's fight ends by the timer."""
    rows = [(1, 0, 100, "damage", 0, 5, 7), (1, 1, 101, "tanking", 0, 5, 3), (2, 2, 101, "heal", 0, None, 1), (2, 3, 101, "heal", 0, None, 1)]

    def start(s):
        time.sleep(1.2)
        return L.live_fights(s, 30, 1)

    got = stream_in_parts(spark, tmp_path, rows, COMBAT, [range(2), range(2, 3), range(3, 4)], start, timers=True)
    assert [(r.character, r.fight, r.name, r.start, r["last"], r.damage, r.tanking) for r in got] == [(1, 0, 5, 100, 101, 7, 3)]


def craft_rows(seed, n):
    rnd, t, rows = random.Random(seed), {}, []
    for line in range(n):
        u = rnd.randrange(3)
        t[u] = t.get(u, 0) + rnd.choice([0, 0, 1, 1, 2, -1])
        rows.append((u, line, t[u], rnd.choice(["craft", "notice", "skill"]), rnd.randrange(9), rnd.randrange(5)))
    return rows


def batch_links(spark, rows, within=1):
    df = spark.createDataFrame(rows, K.EVENTS)
    is_ = lambda k: F.col("kind") == k
    linked = A.craft_links(df, "user_id", "event_id", "t", is_("craft"), is_("notice"), is_("skill"), within)
    return sorted(tuple(r) for r in linked.where("kind <> 'notice'").select("user_id", "event_id", "capped", "voter", "voted_item").collect())


def shown(rows):
    return sorted((r.user_id, r.event_id, r.capped, r.voter, r.voted_item) for r in rows)


def test_links_across_batches_equal_the_batch(spark, tmp_path):
    rows = craft_rows(4, 240)
    cuts = [range(80), range(80, 81), range(81, 240)]
    got = stream_in_parts(spark, tmp_path, rows, K.EVENTS, cuts, K.live_craft_links)
    assert shown(got) == batch_links(spark, rows) and any(r.capped for r in got) and any(r.voter is not None for r in got)


class Value:
    """A state's value that counts its calls."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_links_take_rows_and_write_only_what_changed():
    """No frame is made for a character, and a state that a batch leaves as it was isn't written again."""
    row, tracker, kept = Row("user_id", "event_id", "t", "kind", "item", "skill"), K.CraftLinks(5), {}
    tracker.init(type("Handle", (), {"getValueState": lambda self, name, schema: kept.setdefault(name, Value())})())
    got = list(tracker.handleInputRows((1,), iter([row(1, 3, 11, "craft", 4, 0), row(1, 2, 10, "skill", 0, 6), row(1, 4, 12, "notice", 0, 0)]), None))
    assert [tuple(r) for r in got] == [(1, 2, None, None, None), (1, 3, False, 6, None)] and got[0].event_id == 2
    assert {n: (v.value, v.calls) for n, v in kept.items()} == {"craft": ((4, 11), ["get", "update"]), "notice": ((12,), ["get", "update"]), "waiting": (None, ["get"])}
    assert [tuple(r) for r in tracker.handleInputRows((1,), iter([row(1, 5, 13, "skill", 0, 8)]), None)] == [(1, 5, None, None, 4)]
    assert [len(v.calls) for v in kept.values()] == [3, 3, 2]  # one more get each


def test_links_go_on_from_stored_state(spark, tmp_path):
    """A stream that takes over: what a history left open decides its first lines."""
    opened = spark.createDataFrame([(1, 7, 100, None, None, None), (2, None, None, 100, 4, 100), (3, 1, 1, 1, 1, 1)], K.OPEN)
    rows = [(1, 10, 101, "skill", 0, 3), (2, 11, 101, "craft", 5, 0), (3, 12, 101, "craft", 6, 0), (1, 13, 103, "skill", 0, 2), (4, 14, 100, "skill", 0, 1)]
    got = stream_in_parts(spark, tmp_path, rows, K.EVENTS, [range(5)], lambda s: K.live_craft_links(s, 1, opened))
    assert shown(got) == [(1, 10, None, None, 7), (1, 13, None, None, None), (2, 11, True, 4, None), (3, 12, False, None, None), (4, 14, None, None, None)]


def test_roster_against_a_machine(spark):
    rnd = random.Random(8)
    kinds = ["group_invite", "group_joined", "group_member_seen", "group_member_left", "group_disbanded", "act", "act", "act", "own"]
    rows = [(rnd.randrange(3), i, (k := rnd.choice(kinds)), rnd.choice("abcd") if k not in ("group_joined", "group_disbanded") else None) for i in range(900)]
    state, want = {}, {}
    for c, i, k, n in rows:
        members, asked = state.setdefault(c, [set(), None])
        if k == "group_invite":
            state[c][1] = n
        elif k == "group_joined":
            members |= {asked} - {None}
            state[c][1] = None
        elif k == "group_member_seen":
            members.add(n)
        elif k == "group_member_left":
            members.discard(n)
        elif k == "group_disbanded":
            state[c] = [set(), None]
        else:
            want[i] = k if k == "own" or n in members else None
    df = spark.createDataFrame(rows, "character long, line long, type string, name string").repartition(3)
    intervals = R.roster_intervals(df.where("type LIKE 'group%'"))
    acts = df.where("type IN ('act', 'own')").withColumnRenamed("name", "attacker")
    got = R.keep_while_in(acts, intervals, F.col("type") == "act")
    assert {r.line: r.type for r in got.collect()} == want and None in want.values() and "act" in want.values()
    spans = sorted((r.character, r.name, r.since, r.until or 10**9) for r in intervals.collect())
    assert all(a[:2] != b[:2] or a[3] <= b[2] for a, b in zip(spans, spans[1:], strict=False))
