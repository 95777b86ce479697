"""Write policies as merges of a stored table with a batch of ordered changes; each gives the table after the batch.

A key's changes are folded by aggregates over all of them, so a batch needs one shuffle and no row is replayed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status_upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored (keys, status, added_at, completed_at) after changes (keys, n, status, at), n from 1 in order. The last status holds;
    `untracked` deletes a key, and a later change adds it anew; otherwise the time of adding stays."""
    old = stored.select(*keys, F.lit(0).cast("long").alias("n"), "status", F.col("added_at").alias("at"), "completed_at")
    new = changes.select(*keys, F.col("n").cast("long").alias("n"), "status", "at", F.when(F.col("status") == "completed", F.col("at")).alias("completed_at"))
    cut = F.max(F.when(F.col("status") == "untracked", F.col("n"))).over(W.partitionBy(*keys))
    kept = old.unionByName(new).withColumn("_cut", cut).where("_cut IS NULL OR n > _cut")
    last = F.max_by(F.struct("status", "completed_at"), "n")
    return kept.groupBy(*keys).agg(last.alias("_last"), F.min_by("at", "n").alias("added_at")).select(*keys, "_last.status", "added_at", "_last.completed_at")


def without_untracked(children: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored child rows, less those of keys that the batch untracks at any time."""
    return children.join(changes.where("status = 'untracked'").select(*keys).distinct(), keys, "left_anti")


def toggle_steps(stored: DataFrame, toggles: DataFrame, keys: list[str]) -> DataFrame:
    """Stored (keys, done, done_at) after toggles (keys, at, n): an odd number of them turns a step, a missing step is not done."""
    flips = toggles.groupBy(*keys).agg(F.count("*").alias("_flips"), F.max_by("at", "n").alias("_at"))
    both = stored.select(*keys, "done", "done_at").join(flips, keys, "full")
    done = F.coalesce("done", F.lit(False)) != (F.coalesce("_flips", F.lit(0)) % 2 == 1)
    at = F.when(F.col("_flips").isNull(), F.col("done_at")).when(done, F.col("_at"))
    return both.select(*keys, done.alias("done"), at.alias("done_at"))


def latest_upsert(rows: DataFrame, keys: list[str], order: Column, last: list[str], known: list[str], first: list[str] = []) -> DataFrame:  # noqa: B006
    """Stored rows and changes together: `last` columns are those of the latest row, nulls too; `known` ones the latest that
    isn't null, so an old path or checksum outlives a change without one; `first` ones the earliest row's."""
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*last), order).alias("_last"),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in known),
        *(F.min_by(F.struct(c), order).getField(c).alias(c) for c in first),
    ).select(*keys, "_last.*", *known, *first)


def override_status(rows: DataFrame, earned: DataFrame, key: str) -> DataFrame:
    """Rows (key, status, completed_at) are complete where earned (key, at) says so, whatever their status; `source` tells
    what decided, and a time of completion that is known already stays."""
    won = F.col("at").isNotNull()
    both = rows.join(earned.groupBy(key).agg(F.min("at").alias("at")), key, "left")
    source = F.when(won, "achievement").when(F.col("status").isNotNull(), "manual")
    return both.select(key, F.when(won, "completed").otherwise(F.col("status")).alias("status"), F.coalesce("completed_at", "at").alias("completed_at"), source.alias("source"))


def rekey(rows: DataFrame, key: str, normal: Column, order: str) -> DataFrame:
    """Rows under their normalised key: rows that have it already stay, and of the others only the first takes it where it is free."""
    is_normal = F.col(key) == F.col("_new")
    rank = F.row_number().over(W.partitionBy("_new").orderBy((~is_normal).cast("int"), order))
    return rows.withColumn("_new", normal).withColumn("_rank", rank).where(is_normal | (F.col("_rank") == 1)).withColumn(key, F.col("_new")).drop("_new", "_rank")


def without_owners(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table less the rows of owners that are removed."""
    owners = gone.select(key).distinct()
    return {name: df.join(owners, key, "left_anti") for name, df in tables.items()}


def containers(rows: DataFrame, host: list[str]) -> DataFrame:
    """Capacity, used and free places of each host; rows hold host columns, `slots` of the host (null or 0: as many as its rows)
    and `is_empty`."""
    n = rows.groupBy(*host).agg(F.count("*").alias("_rows"), F.max("slots").alias("_slots"), F.count_if(~F.col("is_empty")).alias("used"))
    capacity = F.when(F.coalesce("_slots", F.lit(0)) > 0, F.col("_slots")).otherwise(F.col("_rows")).cast("long")
    return n.select(*host, capacity.alias("capacity"), "used", F.greatest(capacity - F.col("used"), F.lit(0)).alias("free"))


def renamed_keys(stored: DataFrame, pages: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of stored rows whose name now belongs to another key: they and their children are purged."""
    new = pages.select(F.col(name), F.col(key).alias("_key"))
    return stored.select(key, name).join(new, name).where(F.col(key) != F.col("_key")).select(key).distinct()


def upsert_pages(stored: DataFrame, pages: DataFrame, key: str, name: str) -> DataFrame:
    """Stored rows after a batch of pages with distinct keys and names: a page replaces the row of its key and purges others of its
    name. The batch counts as one step, so a page that gives its name to another in the same batch stays."""
    gone = renamed_keys(stored, pages, key, name).union(pages.select(key)).distinct()
    return stored.join(gone, key, "left_anti").unionByName(pages)


def replace_children(children: DataFrame, fresh: DataFrame, stored: DataFrame, pages: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows after the same batch: those of its pages are replaced by fresh ones, those of purged rows go."""
    gone = renamed_keys(stored, pages, key, name).union(pages.select(key)).distinct()
    return children.join(gone, key, "left_anti").unionByName(fresh)


def socket_candidates(items: DataFrame, sockets: DataFrame, owner: str, first: int = 12) -> DataFrame:
    """Items (owner, needs_weapon, ...) with the number of their owner's open sockets (owner, seq, is_weapon) and the first of them;
    an item that needs a weapon fits weapons only. Equal needs share one list, so no item meets every socket."""
    w = W.partitionBy(owner).orderBy("seq")
    ranked = sockets.withColumn("_all", F.row_number().over(w)).withColumn("_weapons", F.sum(F.col("is_weapon").cast("int")).over(w))
    head = lambda fits, n: F.array_sort(F.collect_list(F.when(fits & (F.col(n) <= first), F.col("seq"))))
    per = ranked.groupBy(owner).agg(F.count("*").alias("_n"), F.count_if("is_weapon").alias("_nw"), head(F.lit(True), "_all").alias("_first"), head(F.col("is_weapon"), "_weapons").alias("_firstw"))
    pick = lambda weapon, other: F.when(F.col("needs_weapon"), F.col(weapon)).otherwise(F.col(other))
    out = items.join(per, owner, "left").withColumn("n", F.coalesce(pick("_nw", "_n"), F.lit(0))).withColumn("first", F.coalesce(pick("_firstw", "_first"), F.array().cast(sockets.schema["seq"].dataType.simpleString().join(("array<", ">")))))
    return out.drop("_n", "_nw", "_first", "_firstw")
