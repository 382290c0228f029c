"""Streams: new files as they come in, facts merged per day, and leases that run out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import slug, strip_space
from corvane.operators.state import difference


def new_documents(spark: SparkSession, folder: str, schema: str, watermark: str = "1 day") -> DataFrame:
    """A stream of parquet rows with ``sha`` and the timestamp ``seen_at``; a text that came before within the watermark is passed over."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["sha"])


def facts_by_window(facts: DataFrame, at: str = "loaded_at", width: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """Facts of each subject and predicate loaded in each window of time; late rows within the watermark still count."""
    return (
        facts.withWatermark(at, watermark)
        .groupBy(F.window(at, width).alias("w"), slug(F.col("subject")).alias("subject"), F.lower(strip_space(F.col("predicate"))).alias("predicate"))
        .agg(F.count("*").alias("facts"))
        .select(F.col("w.start").alias("start"), "subject", "predicate", "facts")
    )


def follow_catalogue(changes: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For each batch of (``source, rel_path, sha``) hand its difference from the catalogue, but for what it doesn't mention, to ``store``.

    ``load`` returns the catalogue as it stands and ``store`` writes it anew, by batch number, so that a batch given twice has no effect.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = difference(load(), rows, ["source", "rel_path"], "sha").where("change IN ('added', 'updated')")
        store(rows.join(found, ["source", "rel_path"]), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
