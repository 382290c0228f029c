"""Base tables of the queries, for Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.markdown import links
from corvane.functions.text import slug, strip_space

#: The day that queries take for today.
AS_OF = "2026-06-30"


def today() -> Column:
    return F.lit(AS_OF).cast("date")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Chunks, each id once. Repeated rows are alike."""
    return read(spark, sf_dir, "chunks").select("id", *columns).dropDuplicates(["id"])


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, entity): a chunk mentions the entities to whose slugs it links."""
    found = read(spark, sf_dir, "chunks").select("id", F.explode(links(F.col("text"))).alias("entity"))
    return found.select(F.col("id").alias("chunk_id"), "entity").distinct()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type, weight): from the subject to the value of a fact; each further fact that says so adds a half."""
    facts = read(spark, sf_dir, "assertions").select(
        slug(F.col("subject")).alias("src"), slug(F.col("value")).alias("dst"), F.lower(strip_space(F.col("predicate"))).alias("type")
    )
    usable = facts.where("src <> '' AND dst <> '' AND src <> dst AND type <> ''")
    return usable.groupBy("src", "dst", "type").agg((1.0 + 0.5 * (F.count("*") - 1)).alias("weight"))


SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_slug(x: str) -> str:
    kept = rf"regexp_replace(lower({sql_strip(x)}), '[^\p{{L}}\p{{N}}_{SPACE}-]', '', 'g')"
    return f"regexp_replace(regexp_replace({kept}, '[{SPACE}_]+', '-', 'g'), '^-+|-+$', '', 'g')"


def sql_body(x: str) -> str:
    return rf"regexp_replace({x}, '\A---\s*\n(?s:.*?)\n---\s*\n', '')"


def sql_links(x: str) -> str:
    """Distinct slugs of the wiki-links of a text, as a list."""
    inner = rf"regexp_replace({sql_body(x)}, '(?s)```.*?```', '', 'g')"
    return rf"list_distinct(list_filter(list_transform(regexp_extract_all({inner}, '\[\[([^\]|#]+)(?:\|[^\]]*)?\]\]', 1), lambda v: {sql_slug('v')}), lambda v: v <> ''))"


CHUNKS_SQL = "chunk AS (SELECT DISTINCT id, doc_id, ordinal, heading_path, line_start, text, sha FROM chunks)"
MENTIONS_SQL = f"mention AS (SELECT DISTINCT id AS chunk_id, unnest({sql_links('text')}) AS entity FROM (SELECT DISTINCT id, text FROM chunks))"
RELATIONS_SQL = f"""relation AS (
  SELECT src, dst, type, 1.0 + 0.5 * (count(*) - 1) AS weight
  FROM (SELECT {sql_slug('subject')} AS src, {sql_slug('value')} AS dst, lower({sql_strip('predicate')}) AS type FROM assertions)
  WHERE src <> '' AND dst <> '' AND src <> dst AND type <> '' GROUP BY ALL)"""
UNIT_SQL = """unit AS (SELECT sha, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v
    FROM (SELECT sha, min(vec)::DOUBLE[] AS v FROM vectors WHERE len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(vec, lambda x: x <> 0)) GROUP BY sha))"""
KNN_SQL = f"""{UNIT_SQL}, first_chunk AS (SELECT sha, min(id) AS chunk FROM chunks GROUP BY sha),
  sim AS (SELECT a.sha AS x, b.sha AS y, round(list_dot_product(a.v, b.v), 9) AS c FROM unit a JOIN unit b ON a.sha <> b.sha),
  near_four AS (SELECT * FROM sim WHERE c >= 0.5 QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 4),
  knn AS (SELECT f.chunk AS src, g.chunk AS dst, round(c, 6) AS weight FROM near_four JOIN first_chunk f ON f.sha = x JOIN first_chunk g ON g.sha = y)"""
