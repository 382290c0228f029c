"""Partial dates as text (``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``) and the days they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip_space


def _padded(value: Column, month: str) -> Column:
    text = strip_space(value)
    return (
        F.when(text.startswith("0000"), F.lit(None))
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text)
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(text, F.lit("-01")))
        .when(text.rlike(r"^[0-9]{4}$"), F.concat(text, F.lit(f"-{month}-01")))
    )


def first_day(value: Column) -> Column:
    """First day of a partial date; null if the text is no real date. Blanks around it don't matter."""
    return F.try_to_date(_padded(value, "01"), "yyyy-MM-dd")


def last_day(value: Column) -> Column:
    """Last day of a partial date; null if the text is no real date."""
    start = F.try_to_date(_padded(value, "12"), "yyyy-MM-dd")
    return F.when(F.length(strip_space(value)) < 10, F.last_day(start)).otherwise(start)


def is_blank(value: Column) -> Column:
    """True for null and for texts of nothing but white space."""
    return value.isNull() | (strip_space(value) == "")
