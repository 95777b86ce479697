"""Who is in a group when: roster events become validity intervals, and others' events count where an interval holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _is(*kinds: str) -> Column:
    return F.col("type").isin(*kinds)


def roster_intervals(events: DataFrame) -> DataFrame:
    """(character, name, since, until) by line out of roster events (character, line, type, name); until is null while it holds.

    group_invite names who is asked; group_joined takes in the last one asked since the last join or disbanding, if any.
    group_member_seen takes in its name, group_member_left lets it go, group_disbanded lets all go. Taking in who is in already
    changes nothing."""
    lines = W.partitionBy("character").orderBy("line")
    before = lines.rowsBetween(W.unboundedPreceding, -1)
    settled = F.coalesce(F.sum(F.when(_is("group_joined", "group_disbanded"), 1).otherwise(0)).over(before), F.lit(0))
    asked = F.last(F.when(_is("group_invite"), F.col("name")), ignorenulls=True).over(W.partitionBy("character", "_turn").orderBy("line"))
    cleared = F.min(F.when(_is("group_disbanded"), F.col("line"))).over(lines.rowsBetween(1, W.unboundedFollowing))
    marked = events.select("character", "line", "type", "name").withColumn("_turn", settled).withColumn("_asked", asked).withColumn("_cleared", cleared)
    who = F.when(_is("group_joined"), F.col("_asked")).when(_is("group_member_seen", "group_member_left"), F.col("name"))
    moves = marked.withColumn("_who", who).where(F.col("_who").isNotNull())
    person = W.partitionBy("character", "_who").orderBy("line")
    left = F.min(F.when(_is("group_member_left"), F.col("line"))).over(person.rowsBetween(1, W.unboundedFollowing))
    taken = moves.withColumn("_left", left).where(~_is("group_member_left")).withColumn("_until", F.least("_left", "_cleared"))
    still_in = F.lag("line").over(person).isNotNull() & F.coalesce(F.lag("_until").over(person) > F.col("line"), F.lit(True))
    begun = taken.withColumn("_in", still_in).where("NOT _in")
    return begun.select("character", F.col("_who").alias("name"), F.col("line").alias("since"), F.col("_until").alias("until"))


def keep_while_in(events: DataFrame, intervals: DataFrame, other: Column) -> DataFrame:
    """Events (character, line, attacker, ...) with type null where they are another's (`other`) who isn't in at that line.

    Intervals of one person don't overlap, so the latest that began before a line decides: events and intervals meet in one
    window by character and person instead of a join over ranges."""
    keyed = events.withColumn("_other", F.coalesce(other, F.lit(False)))
    asked = keyed.where("_other")
    rows = asked.select("character", F.col("attacker").alias("name"), "line").distinct().withColumns({"since": F.lit(None).cast("long"), "until": F.lit(None).cast("long")})
    starts = intervals.select("character", "name", F.col("since").alias("line"), "since", "until")
    person = W.partitionBy("character", "name").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("since").isNotNull(), F.struct("since", "until")), ignorenulls=True).over(person)
    held = rows.union(starts.select(rows.columns)).withColumn("_at", latest).where("since IS NULL")
    inside = F.col("_at").isNotNull() & F.coalesce(F.col("line") < F.col("_at.until"), F.lit(True))
    known = held.where(inside).select("character", F.col("name").alias("attacker"), "line", F.lit(True).alias("_in"))
    joined = keyed.join(known, ["character", "attacker", "line"], "left")
    return joined.withColumn("type", F.when(~F.col("_other") | F.col("_in"), F.col("type"))).select(events.columns)
