"""Text and markdown expressions against small hand-written cases."""

import datetime as dt

from pyspark.sql import functions as F

from corvane.functions import markdown as M
from corvane.functions.text import index_tokens, query_terms, slug, words


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).head()[0]


def test_slug(spark):
    assert one(spark, slug(F.col("v")), v="\t Ça va_bien -- Straße! ") == "ça-va-bien----straße"
    assert one(spark, slug(F.col("v")), v=" !. ") == ""
    assert one(spark, slug(F.col("v")), v=None) is None


def test_terms(spark):
    assert one(spark, query_terms(F.col("v")), v="What is the two-factor login's état?") == ["two-factor", "login's", "état"]
    assert one(spark, query_terms(F.col("v")), v="to be or") == ["to", "be", "or"]
    assert one(spark, index_tokens(F.col("v")), v="a_b don't Élan") == ["a", "b", "don", "t", "elan"]
    assert one(spark, words(F.col("v")), v=" a b\xa0c\n") == ["a", "b", "c"]


NOTE = """---
date: 2024-03-02
status: Superseded
aliases: [one thing, "Two"]
tags:
  - red
  - blue
# comment: no
---
# Title here

**Owner:** Ann **B**
**Owner:** Other

See [[Some Page|label]] and [[some page]] ```[[hidden]]```

- [[Subject X]] Stage:: alpha · since:2023-02 until:2024
- location:: Rome since:2020-01-02
"""


def test_document_fields(spark):
    text, path = F.col("t"), F.col("p")
    row = spark.createDataFrame([(NOTE, "deep/folder/file name.md")], "t string, p string").select(
        M.front_matter(text), M.bold_fields(text), M.title(text, path), M.links(text), M.superseded_by(text), M.aliases(text, path), M.facts(text), M.folders(path), M.area(F.lit("s"), path)
    ).head()
    assert {e["field"]: e["values"] for e in row[0]} == {"date": ["2024-03-02"], "status": ["Superseded"], "aliases": ["one thing", "Two"], "tags": ["red", "blue"]}
    assert [tuple(e) for e in row[1]] == [("owner", "Ann B")]
    assert row[2] == "Title here" and row[3] == ["some-page", "subject-x"] and row[4] == "self"
    assert row[5] == ["file-name", "one-thing", "title-here", "two"]
    assert [(f.subject, f.predicate, f.value, f.since, f.until, f.functional) for f in row[6]] == [
        ("subject-x", "stage", "alpha", "2023-02", "2024", True), ("", "location", "Rome", "2020-01-02", None, True),
    ]
    assert row[7] == ["deep", "deep/folder"] and row[8] == "s/deep"


def test_dates(spark):
    cases = {
        "on 2024-05-06.": dt.date(2024, 5, 6), "3 marzo 2024": dt.date(2024, 3, 3), "March 3rd, 2024": dt.date(2024, 3, 3), "Mar 2024": dt.date(2024, 3, 1),
        "2024-13-40 or 4 May 2023": dt.date(2023, 5, 4), "2031-01-01": None, "none": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r[0]: r[1] for r in df.select("v", M.parse_date(F.lit("2026-06-30").cast("date"), F.col("v"))).collect()}
    assert got == cases


def test_scores(spark):
    day = F.lit("2026-06-30").cast("date")
    assert one(spark, M.freshness(F.col("v").cast("date"), day), v="2026-06-30") == 1.0
    assert one(spark, M.freshness(F.col("v").cast("date"), day), v=None) == 0.3
    assert one(spark, M.quality(F.col("v"), F.lit("A Template"), F.lit(0.9)), v="x.md") == 0.15
    assert one(spark, M.months_since(F.col("v"), day), v="2025") == 17
