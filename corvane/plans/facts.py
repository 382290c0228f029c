"""Queries over dated facts (``assertions``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.dates import first_day, is_blank, last_day
from corvane.functions.text import slug, strip_space
from corvane.operators.intervals import merge_intervals
from corvane.plans.base import sql_slug, sql_strip


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of each subject and predicate."""
    facts = spark.read.parquet(f"{sf_dir}/assertions.parquet").select(
        slug(F.col("subject")).alias("subject"),
        F.lower(strip_space(F.col("predicate"))).alias("predicate"),
        first_day(F.col("since")).alias("first"),
        last_day(F.col("until")).alias("last"),
        is_blank(F.col("until")).alias("open"),
    )
    valid = facts.where((F.col("subject") != "") & F.col("first").isNotNull() & (F.col("open") | F.col("last").isNotNull()))
    merged = merge_intervals(valid, ["subject", "predicate"], "first", "last")
    return merged.select(
        "subject",
        "predicate",
        "kind",
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"),
        F.coalesce(F.date_format("last_day", "yyyy-MM-dd"), F.lit("open")).alias("last_day"),
    )


P5_SQL = f"""
WITH raw AS (
  SELECT {sql_slug('subject')} AS subject, lower({sql_strip('predicate')}) AS predicate,
         {sql_strip('since')} AS s, {sql_strip("coalesce(until, '')")} AS u
  FROM assertions),
dated AS (
  SELECT subject, predicate,
    CASE WHEN starts_with(s, '0000') THEN NULL WHEN regexp_full_match(s, '[0-9]{{4}}') THEN try_cast(s || '-01-01' AS DATE)
         WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}') THEN try_cast(s || '-01' AS DATE)
         WHEN regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(s AS DATE) END AS a,
    CASE WHEN u = '' THEN DATE '9999-12-31' WHEN starts_with(u, '0000') THEN NULL
         WHEN regexp_full_match(u, '[0-9]{{4}}') THEN try_cast(u || '-12-31' AS DATE)
         WHEN regexp_full_match(u, '[0-9]{{4}}-[0-9]{{2}}') THEN last_day(try_cast(u || '-01' AS DATE))
         WHEN regexp_full_match(u, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(u AS DATE) END AS b
  FROM raw WHERE subject <> ''),
good AS (SELECT * FROM dated WHERE a IS NOT NULL AND b IS NOT NULL AND a <= b),
reach AS (
  SELECT *, max(b) OVER (PARTITION BY subject, predicate ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM good),
isl AS (
  SELECT *, sum(CASE WHEN r IS NULL OR a > r + 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY subject, predicate ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM reach),
per AS (SELECT subject, predicate, g, min(a) AS a, max(b) AS b FROM isl GROUP BY ALL),
nxt AS (SELECT *, lead(a) OVER (PARTITION BY subject, predicate ORDER BY a) AS n FROM per)
SELECT subject, predicate, 'period' AS kind, strftime(a, '%Y-%m-%d') AS first_day,
       CASE WHEN b = DATE '9999-12-31' THEN 'open' ELSE strftime(b, '%Y-%m-%d') END AS last_day FROM nxt
UNION ALL
SELECT subject, predicate, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(n - 1, '%Y-%m-%d') FROM nxt WHERE n IS NOT NULL
"""


def queries() -> dict:
    return {"p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL}
