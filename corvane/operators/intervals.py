"""Merging overlapping intervals into continuous periods, and the gaps between them.

Rows are first reduced to the latest end of each (key, start). That reduction combines on the map side, so
a hot key brings at most one row for each distinct start day to the sort by start, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Day number that stands for "no end"; later than any date that Spark can hold as a four-digit year.
OPEN_DAY = 2**31 - 2


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Periods and gaps of closed day intervals for each key.

    ``start`` and ``end`` are DATE columns, both days included; a null ``end`` is an open interval.
    Result: the keys, ``kind`` ('period' or 'gap'), ``first_day`` and ``last_day`` as DATE. ``last_day`` of an
    open period is null. Intervals that overlap, nest or lie on adjoining days are one period; a gap holds the days
    between two neighbouring periods. Rows with a null start, or an end before the start, are left out; null keys
    form a key of their own; repeated rows and ties have no effect; other columns, also one called ``kind``, are ignored. An
    empty input gives an empty result.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
        F.unix_date(F.col(f"`{start}`")).alias("s"),
        F.coalesce(F.unix_date(F.col(f"`{end}`")), F.lit(OPEN_DAY)).alias("e"),
    ).where(F.col("s").isNotNull() & (F.col("s") <= F.col("e")))
    ends = rows.groupBy(*names, "s").agg(F.max("e").alias("e"))

    by_start = Window.partitionBy(*names).orderBy("s")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    islands = (
        ends.withColumn("reach", F.max("e").over(before))
        .withColumn("opens", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), 1).otherwise(0))
        .withColumn("island", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    )
    periods = (
        islands.groupBy(*names, "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .withColumn("next_s", F.lead("s").over(Window.partitionBy(*names).orderBy("island")))
    )
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("e").alias("b"))
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("e") + 1).alias("a"), (F.col("next_s") - 1).alias("b"))
    out = periods.select(
        *names, F.inline(F.when(F.col("next_s").isNull(), F.array(period)).otherwise(F.array(period, gap)))
    )
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        "kind",
        F.date_from_unix_date("a").alias("first_day"),
        F.when(F.col("b") < OPEN_DAY, F.date_from_unix_date("b")).alias("last_day"),
    )
