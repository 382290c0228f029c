"""Joins whose strategy depends on a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; counting stops beyond them."""
    return df.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (the join then shuffles both sides)."""
    return F.broadcast(df) if fits(df, max_rows) else df
