"""SQL functions for a session: slug, query_terms, freshness, cosine, and the table function chunk_markdown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corvane.functions.text import SPACE, STOP_WORDS
from corvane.operators.sections import packed


@udtf(returnType="ordinal int, heading_path string, line_start int, text string")
class ChunkMarkdown:
    """Sections of a markdown text packed to 240 words; no rows for null."""

    def eval(self, body: str) -> Iterator[tuple]:
        if body is not None:
            for ordinal, (path, line, text) in enumerate(packed(body, 240, 36, 18)):
                yield ordinal, path, line, text


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``. All but chunk_markdown are expanded into built-in expressions."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bodies = {
        "slug(v STRING) RETURNS STRING": rf"""btrim(regexp_replace(regexp_replace(lower(regexp_replace(v, r'^[{SPACE}]+|[{SPACE}]+$', '')),
            r'[^\p{{L}}\p{{N}}_{SPACE}-]', ''), r'[{SPACE}_]+', '-'), '-')""",
        "query_terms(v STRING) RETURNS ARRAY<STRING>": rf"""CASE WHEN size(filter(regexp_extract_all(lower(v), r'[\p{{L}}\p{{N}}_\x27’-]+', 0), t -> length(t) > 1 AND NOT array_contains(array({stop}), t))) > 0
            THEN filter(regexp_extract_all(lower(v), r'[\p{{L}}\p{{N}}_\x27’-]+', 0), t -> length(t) > 1 AND NOT array_contains(array({stop}), t))
            ELSE regexp_extract_all(lower(v), r'[\p{{L}}\p{{N}}_\x27’-]+', 0) END""",
        "freshness(day DATE, as_of DATE) RETURNS DOUBLE": "CASE WHEN day IS NULL THEN 0.3D ELSE 1 / (1 + greatest(0, datediff(as_of, day)) / 1825D) END",
        "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": """aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
            / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))""",
    }
    for head, text in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {text}")
    spark.udtf.register("chunk_markdown", ChunkMarkdown)
