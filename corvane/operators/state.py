"""State tables as pure functions: catalogue differences, upserts, and queues with leases.

A transition takes the old state and the clock and returns the new state; whoever holds the table writes it anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def difference(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, ``change``) of two catalogues: added, removed, updated or unchanged by the digest. Keys are unique and not null."""
    a = old.select(*keys, F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    )
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys. Columns are those of ``old``; keys of ``new`` are unique."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it doesn't hold."""
    return old.unionByName(new.select(*old.columns).join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def release_leases(queue: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Leases older than ``minutes`` become pending again; other rows stay. ``queue`` has ``status`` and the timestamp ``updated_at``."""
    stale = (F.col("status") == "leased") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return queue.withColumns({
        "updated_at": F.when(stale, now).otherwise(F.col("updated_at")), "status": F.when(stale, "pending").otherwise(F.col("status")),
    })


def lease(queue: DataFrame, key: str, order: list[Column], limit: int, now: Column) -> DataFrame:
    """The first ``limit`` pending rows in ``order`` become leased. Their keys come from a top-k, not from a sort of the queue."""
    taken = queue.where(F.col("status") == "pending").orderBy(*order, F.col(key)).limit(limit).select(key, F.lit(True).alias("_taken"))
    rows = queue.join(F.broadcast(taken), key, "left")
    hit = F.col("_taken").isNotNull()
    return rows.select(*[
        F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.when(hit, "leased").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c)
        for c in queue.columns
    ])


def mark_missing(queue: DataFrame, key: str, held: DataFrame, now: Column) -> DataFrame:
    """Leased rows whose file is not ``held`` (``key``) become missing. That is no held status: such rows are offered again."""
    rows = queue.join(held.select(key).distinct().withColumn("_held", F.lit(True)), key, "left")
    gone = (F.col("status") == "leased") & F.col("_held").isNull()
    new = rows.withColumns({"updated_at": F.when(gone, now).otherwise(F.col("updated_at")), "status": F.when(gone, "missing").otherwise(F.col("status"))})
    return new.select(*queue.columns)


def complete(queue: DataFrame, key: str, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new queue, skipped): the keys in ``done`` become done; unknown and already done ones are skipped with the reason."""
    named = done.select(key).where(F.col(key).isNotNull()).distinct()
    state = named.join(queue.select(key, "status"), key, "left")
    skipped = state.where("status IS NULL OR status = 'done'").select(key, F.when(F.col("status").isNull(), "unknown").otherwise("already done").alias("reason"))
    rows = queue.join(named.withColumn("_done", F.lit(True)), key, "left")
    hit = F.col("_done").isNotNull() & (F.col("status") != "done")
    new = rows.withColumns({"updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "done").otherwise(F.col("status"))})
    return new.select(*queue.columns), skipped


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
