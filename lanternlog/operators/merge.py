"""Merge policies: first wins, latest snapshot, precedence of sources, additive and extreme upserts, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key, the first in order (insert-or-ignore)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def additive_merge(stored: DataFrame, delta: DataFrame, keys: list[str], sums: list[str], largest: list[str] = [], least: list[str] = []) -> DataFrame:  # noqa: B006
    """Upsert that adds, or keeps the largest or least, of columns: both sides are aggregated together."""
    cols = [*keys, *sums, *largest, *least]
    return stored.select(*cols).unionByName(delta.select(*cols)).groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in largest), *(F.min(c).alias(c) for c in least)
    )


def two_source_merge(first: DataFrame, second: DataFrame, key: str, fill: list[str], owned: list[str], names: tuple[str, str]) -> DataFrame:
    """Full join: the first source wins `fill` columns and the second fills its nulls; the second owns `owned` columns;
    `origin` names the sources that have the key."""
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    has_a, has_b = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    return both.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in fill),
        *(F.col(f"b.{c}").alias(c) for c in owned),
        F.when(has_a & has_b, f"{names[0]}+{names[1]}").when(has_a, names[0]).otherwise(names[1]).alias("origin"),
    )


def fallback(primary: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the first, and those of the other whose key it lacks."""
    return primary.unionByName(other.join(primary.select(*keys).distinct(), keys, "left_anti"))


def changed_rows(current: DataFrame, known: DataFrame, key: str, revision: str) -> DataFrame:
    """Rows that are unknown or have another revision than the known ones."""
    old = known.select(F.col(key).alias("_key"), F.col(revision).alias("_revision"))
    return current.join(old, current[key] == old["_key"], "left").where(F.col("_key").isNull() | ~F.col("_revision").eqNullSafe(F.col(revision))).drop("_key", "_revision")


def by_precedence(*states: Column) -> Column:
    """First state that is known: the manual one, then derived ones; null if none is."""
    return reduce(lambda a, b: F.coalesce(a, b), states)


def floor_lookup(rows: DataFrame, brackets: DataFrame, keys: list[str], value: str, floor: str, result: str) -> DataFrame:
    """Adds the result of the greatest bracket at or below a value; brackets are few for each key."""
    best = brackets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(floor).alias("floor"), F.col(result).alias("result")))).alias("_brackets"))
    return rows.join(best, keys, "left").withColumn(result, F.try_element_at(F.filter("_brackets", lambda b: b.floor <= F.col(value)), F.lit(-1)).result).drop("_brackets")


def prefix_match(rows: DataFrame, guides: DataFrame, key: str, guide: str) -> DataFrame:
    """Adds the guide with an equal key, else the only one that starts with the row's key or that it starts with.

    Prefixes meet by equality: each name gives all its prefixes, and a key meets the guides that equal one of its prefixes and
    those that have it as a prefix. An empty key or guide is no prefix of anything."""
    exact = guides.select(F.col(guide).alias(key), F.col(guide).alias("_exact")).distinct()
    names, known = rows.select(key).distinct(), guides.select(F.col(guide).alias("_guide")).distinct()
    starts = lambda c: F.explode(F.expr(f"transform(sequence(1, greatest(char_length({c}), 1)), i -> left({c}, i))"))
    longer = names.select(key, starts(key).alias("_guide")).join(known, "_guide")
    shorter = known.select("_guide", starts("_guide").alias(key)).join(names, key)
    near = longer.select(key, "_guide").union(shorter.select(key, "_guide")).where(f"{key} <> '' AND _guide <> ''").distinct()
    near = near.groupBy(key).agg(F.min("_guide").alias("_near"), F.count("*").alias("_n")).where("_n = 1")
    return rows.join(exact, key, "left").join(near.drop("_n"), key, "left").withColumn("guide", F.coalesce("_exact", "_near")).drop("_exact", "_near")
