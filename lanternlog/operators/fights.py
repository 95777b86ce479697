"""Fights out of combat events, and who did what in them.

An engagement is a run of lines that name one enemy, up to its death or until it hasn't been named for `idle` seconds. A
fight is a chain of engagements each of which begins while an earlier one is still open; it ends when all its enemies are slain or
have gone idle. The clock is the largest time seen so far, as a log's times may step back. A line that heals belongs to the
fight that is open then. A death that no blow came before is no engagement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds after which an enemy that isn't named any more is no longer fought, and the shortest length a rate is taken over.
IDLE, LEAST_SECONDS = 30, 0.1


def engagements(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """Combat events (character, line, t, kind, actor, enemy, amount) with clock and first, the first line of their engagement;
    kinds are damage, tanking, heal and kill. Heals and idle deaths have a null first."""
    lines = W.partitionBy("character").orderBy("line")
    enemy = W.partitionBy("character", "_of").orderBy("line")
    clocked = events.withColumn("clock", F.max("t").over(lines)).withColumn("_of", F.when(F.col("kind") != "heal", F.col("enemy")))
    begins = F.lag("line").over(enemy).isNull() | (F.lag("kind").over(enemy) == "kill") | (F.col("clock") - F.lag("clock").over(enemy) > idle)
    marked = clocked.withColumn("_run", F.when(F.col("_of").isNotNull(), F.sum(begins.cast("int")).over(enemy)))
    first = F.min(F.when(F.col("kind") != "kill", F.col("line"))).over(W.partitionBy("character", "_of", "_run"))
    return marked.withColumn("first", F.when(F.col("_of").isNotNull(), first)).drop("_of", "_run")


def fights(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """Combat events with fight, the first line of the fight that they belong to, null for none.

    Intervals are chained by running maxima, so no engagement is compared with another; all windows are by character."""
    marked = engagements(events, idle)
    spans = marked.where("first IS NOT NULL").groupBy("character", "first").agg(
        F.min("clock").alias("began"),
        F.max(F.when(F.col("kind") == "kill", F.col("line"))).alias("slain"),
        F.max("clock").alias("last"),
    )
    until = F.when(F.col("slain").isNull(), F.col("last") + idle)
    before = W.partitionBy("character").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    open_ = F.coalesce(F.max("slain").over(before) > F.col("first"), F.lit(False)) | F.coalesce(F.max(until).over(before) >= F.col("began"), F.lit(False))
    chained = spans.withColumn("fight", F.max(F.when(~open_, F.col("first"))).over(W.partitionBy("character").orderBy("first")))
    ends = chained.groupBy("character", "fight").agg(F.max("slain").alias("_slain"), F.max(until).alias("_until"))
    named = marked.join(chained.select("character", "first", F.col("fight").alias("_own")), ["character", "first"], "left")
    # A heal looks back to the latest fight that began before it; a row for each fight stands among the lines at its first one.
    at = W.partitionBy("character").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    looked = named.withColumn("_latest", F.last(F.when(F.col("line") == F.col("_own"), F.col("_own")), ignorenulls=True).over(at))
    candidate = looked.withColumn("_fight", F.when(F.col("kind") == "heal", F.col("_latest")).otherwise(F.col("_own")))
    judged = candidate.join(ends.withColumnRenamed("fight", "_fight"), ["character", "_fight"], "left")
    inside = (F.col("kind") != "heal") | F.coalesce(F.col("line") < F.col("_slain"), F.lit(False)) | F.coalesce(F.col("clock") <= F.col("_until"), F.lit(False))
    return judged.withColumn("fight", F.when(inside, F.col("_fight"))).drop("_fight", "_own", "_latest", "_slain", "_until")


def fight_rows(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """(character, fight, name, start, last, seconds, damage, healing, tanking, dps) of each fight: its name is the first enemy's,
    and the rate is taken over LEAST_SECONDS at least, to one decimal."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), F.lit(0)).cast("long")
    rows = fights(events, idle).where("fight IS NOT NULL").groupBy("character", "fight").agg(
        F.min_by("enemy", "line").alias("name"),
        F.min("clock").alias("start"),
        F.max("clock").alias("last"),
        of("damage").alias("damage"),
        of("heal").alias("healing"),
        of("tanking").alias("tanking"),
    )
    seconds = F.col("last") - F.col("start")
    return rows.select("character", "fight", "name", "start", "last", seconds.alias("seconds"), "damage", "healing", "tanking", F.round(F.col("damage") / F.greatest(seconds, F.lit(LEAST_SECONDS)), 1).alias("dps"))


def fight_meters(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """(character, fight, meter, actor, total, hits): what each actor dealt and healed, and what each enemy made others take."""
    actor = F.when(F.col("kind") == "tanking", F.col("enemy")).otherwise(F.col("actor"))
    counted = fights(events, idle).where("fight IS NOT NULL AND kind <> 'kill'")
    return counted.groupBy("character", "fight", F.col("kind").alias("meter"), actor.alias("actor")).agg(F.sum("amount").alias("total"), F.count("*").alias("hits"))
