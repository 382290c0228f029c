"""Merging of intervals and the partial dates that it reads."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corvane.functions.dates import first_day, is_blank, last_day
from corvane.operators.intervals import merge_intervals

SCHEMA = "subject string, predicate string, a date, b date, kind string"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def merged(spark, rows):
    df = spark.createDataFrame([(s, p, None if a is None else day(a), None if b is None else day(b), "extra") for s, p, a, b in rows], SCHEMA)
    out = merge_intervals(df, ["subject", "predicate"], "a", "b").collect()
    return sorted((r.subject, r.predicate, r.kind, (r.first_day - day(0)).days, None if r.last_day is None else (r.last_day - day(0)).days) for r in out)


def brute(rows):
    out = []
    for key in {(s, p) for s, p, _, _ in rows}:
        spans = [(a, 10_000 if b is None else b) for s, p, a, b in rows if (s, p) == key and a is not None and (b is None or b >= a)]
        days = sorted({d for a, b in spans for d in range(a, min(b, 400) + 1)})
        open_from = min((a for a, b in spans if b == 10_000), default=None)
        periods = []
        for d in days:
            if periods and d == periods[-1][1] + 1:
                periods[-1][1] = d
            else:
                periods.append([d, d])
        for k, (a, b) in enumerate(periods):
            last = None if open_from is not None and b == 400 else b
            out.append((*key, "period", a, last))
            if k:
                out.append((*key, "gap", periods[k - 1][1] + 1, a - 1))
    return sorted(out)


def test_adjoining_nested_open(spark):
    assert merged(spark, [("x", "p", 0, 4), ("x", "p", 5, 9), ("x", "p", 6, 7), ("x", "p", 20, 21), ("x", "p", 30, None), ("x", "p", 35, 36)]) == [
        ("x", "p", "gap", 10, 19), ("x", "p", "gap", 22, 29), ("x", "p", "period", 0, 9), ("x", "p", "period", 20, 21), ("x", "p", "period", 30, None),
    ]


def test_nulls_reversed_repeated_and_empty(spark):
    assert merged(spark, []) == []
    assert merged(spark, [("x", "p", None, 3), ("x", "p", 5, 1)]) == []
    assert merged(spark, [("x", "p", 1, 2)] * 3) == [("x", "p", "period", 1, 2)]
    rows = spark.createDataFrame([(None, "p", day(0), day(1), "k"), (None, "p", day(2), day(3), "k")], SCHEMA)
    assert merge_intervals(rows, ["subject", "predicate"], "a", "b").count() == 1


def test_against_days(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        a = rng.randrange(300)
        rows.append((rng.choice("xyz"), rng.choice("pq"), a, None if rng.random() < 0.004 else a + rng.randrange(-2, 9)))
    assert merged(spark, rows) == brute(rows)


def test_partial_dates(spark):
    values = ["2020", "2020-02", "2020-02-30", " 2020-02-03\t", "0000", "2020-13", "", None, "20200101", "2020-2-3"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [(str(r[0]), str(r[1]), r[2]) for r in df.select(first_day(F.col("v")), last_day(F.col("v")), is_blank(F.col("v"))).collect()]
    assert got[:2] == [("2020-01-01", "2020-12-31", False), ("2020-02-01", "2020-02-29", False)]
    assert got[2][:2] == ("None", "None") and got[3][:2] == ("2020-02-03", "2020-02-03")
    assert [g[2] for g in got] == [False] * 6 + [True, True, False, False]
    assert all(g[:2] == ("None", "None") for g in got[5:])
