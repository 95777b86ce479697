"""Order-sensitive operators over an activity log: sessions, clocks, as-of values, links and running balances.

Order is that of the log's lines, not of its timestamps, so clocks may run backwards: only gaps above 0 and up to the limit
add time, and only larger ones part sessions. A character's lines are one window partition; characters are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP = 1800


def gap_sessions(events: DataFrame, character: str, order: str, seconds: Column, gap: int = GAP) -> DataFrame:
    """Adds gap (seconds since the line before, null for the first), session (from 0) and active (seconds that count)."""
    w = W.partitionBy(character).orderBy(order)
    since = seconds - F.lag(seconds).over(w)
    return (
        events.withColumn("gap", since)
        .withColumn("session", F.sum(F.when(F.col("gap") > gap, 1).otherwise(0)).over(w).cast("long"))
        .withColumn("active", F.when((F.col("gap") > 0) & (F.col("gap") <= gap), F.col("gap")).otherwise(0))
    )


def as_of_last(events: DataFrame, keys: list[str], order: str, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds the last non-null value at or before each row (before it, if not inclusive)."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def zone_clock(events: DataFrame, character: str, order: str, seconds: Column, zone: Column, ticks: Column, gap: int = GAP) -> DataFrame:
    """Rows that tick, with zone_before (where the time since the last tick was spent) and spent seconds.

    zone is null except on zone lines. The time up to a zone line belongs to the old zone; before the first it belongs to
    none."""
    w = W.partitionBy(character).orderBy(order)
    ticking = as_of_last(events.where(ticks), [character], order, zone, "zone_before", inclusive=False)
    since = seconds - F.lag(seconds).over(w)
    return ticking.withColumn("spent", F.when((since > 0) & (since <= gap), since).otherwise(0))


def max_with_context(amount: Column, order: Column, *context: Column) -> Column:
    """Aggregate: the struct (amount, first, context...) of the largest amount; of equal ones the earliest."""
    return F.max(F.struct(amount.alias("amount"), (-order).alias("before"), *context))


def craft_links(events: DataFrame, character: str, order: str, seconds: str, is_craft: Column, is_notice: Column, is_skill: Column, within: int = 1) -> DataFrame:
    """Adds capped and voter to crafts, and voted_item to skill-ups.

    A notice belongs to the next craft if that follows within the limit; any craft uses it up, and a later notice replaces
    an earlier one. A skill-up within the limit after a craft votes for that craft; else it waits, replacing one that waits
    already, for the next craft, which uses it up."""
    before = W.partitionBy(character).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    near = lambda c: (F.col(seconds) - c).between(0, within)
    marked = (
        events.withColumn("_group", F.coalesce(F.sum(F.when(is_craft, 1).otherwise(0)).over(before), F.lit(0)))
        .withColumn("_craft", F.last(F.when(is_craft, F.struct(F.col("item"), F.col(seconds).alias("at"))), ignorenulls=True).over(before))
        .withColumn("_after", F.coalesce(is_skill & near(F.col("_craft.at")), F.lit(False)))
    )
    inside = W.partitionBy(character, "_group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        marked.withColumn("_notice", F.last(F.when(is_notice, F.col(seconds)), ignorenulls=True).over(inside))
        .withColumn("_skill", F.last(F.when(is_skill & ~F.col("_after"), F.struct(F.col("skill"), F.col(seconds).alias("at"))), ignorenulls=True).over(inside))
        .withColumn("capped", F.when(is_craft, F.coalesce(near(F.col("_notice")), F.lit(False))))
        .withColumn("voter", F.when(is_craft & near(F.col("_skill.at")), F.col("_skill.skill")))
        .withColumn("voted_item", F.when(F.col("_after"), F.col("_craft.item")))
        .drop("_group", "_craft", "_after", "_notice", "_skill")
    )


def depot_estimate(events: DataFrame, keys: list[str], order: str, deposited: Column, taken: Column, left: Column, is_consume: Column) -> DataFrame:
    """Adds estimate: what is left of a material after each row.

    A consume line sets it to the amount that it reports, null if it reports none; deposits add to it and withdrawals take
    from it, not below 0; it is null before the first consume. The floor at 0 is the running minimum of the unfloored sum."""
    w = W.partitionBy(*keys).orderBy(order)
    seg = [*keys, "_segment"]
    s = W.partitionBy(*seg).orderBy(order)
    return (
        events.withColumn("_segment", F.sum(F.when(is_consume, 1).otherwise(0)).over(w))
        .withColumn("_base", F.first(F.when(is_consume, left)).over(s))
        .withColumn("_sum", F.sum(F.when(is_consume, F.col("_base")).otherwise(F.coalesce(deposited, F.lit(0)) - F.coalesce(taken, F.lit(0)))).over(s))
        .withColumn("estimate", F.when((F.col("_segment") > 0) & F.col("_base").isNotNull(), F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(s))))
        .drop("_segment", "_base", "_sum")
    )


def nearest_preceding_host(rows: DataFrame, keys: list[str], order: str, is_host: Column, host_location: Column, child_location: Column, carried: tuple[str, ...] = ()) -> DataFrame:
    """Adds host: the order of the nearest row before it that stands at the location a row names as its parent; columns `carried`
    of that row come with it as host_<name>. A row stands as a child and, where it may be one, as a host under one window, so
    nothing is joined, and rows that are dealt by their keys already stay where they are."""
    child = F.struct(F.lit(True).alias("child"), child_location.alias("where"))
    host = F.struct(F.lit(False).alias("child"), F.when(is_host, host_location).alias("where"))
    roles = F.explode(F.filter(F.array(child, host), lambda r: r.child | r.where.isNotNull()))
    w = W.partitionBy(*keys, "_role.where").orderBy(order, F.desc("_role.child")).rowsBetween(W.unboundedPreceding, -1)
    before = F.last(F.when(~F.col("_role.child"), F.struct(F.col(order).alias("_seq"), *carried)), ignorenulls=True).over(w)
    found = rows.withColumn("_role", roles).withColumn("_before", before).where("_role.child")
    return found.select(*rows.columns, F.col("_before._seq").alias("host"), *(F.col("_before")[c].alias(f"host_{c}") for c in carried))


def rate(value: Column, hours: Column, least_hours: float = 0.1) -> Column:
    """value an hour to one decimal; withheld where value is 0 or null, or hours are few."""
    return F.when((hours >= least_hours) & (value != 0), F.round(value / hours, 1))
