"""Connected components of an undirected graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge: the smallest node of its component.

    Every node points to the least node among itself and its neighbours; pointers are doubled until all point to the root of
    their tree, and the roots form the next graph, which has half the nodes at most, until no edges are left. So rounds, and
    doublings in a round, grow with logarithms. Hubs are only aggregated and joined, never gathered."""
    both = lambda e: e.select(F.col("a").alias("v"), F.col("b").alias("u")).union(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
    edges = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    maps = []
    while not edges.isEmpty():
        least = settle(both(edges).groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")))
        step, moving = least, True
        while moving:
            jump = step.select(F.col("v").alias("m"), F.col("m").alias("to"))
            doubled = settle(step.join(jump, "m").select("v", F.col("to").alias("m"), (F.col("to") != F.col("m")).alias("moved")))
            moving = not doubled.where("moved").isEmpty()
            step = doubled.drop("moved")
        maps.append(step)
        at = lambda k: step.select(F.col("v").alias(k), F.col("m").alias(f"m{k}"))
        edges = settle(edges.join(at("a"), "a").join(at("b"), "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select(F.col("v").alias("node"), F.col("m").alias("component"))
    for step in maps[1:]:
        out = out.join(step.withColumnRenamed("v", "component"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return settle(out)
