"""Queries that run a stream over a table to its end and return what it gave."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.lineage import ensure_checkpoint_dir
from corvane.plans.base import read, sql_slug, sql_strip
from corvane.streaming.ingest import facts_by_window


def stream_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by subject, predicate and day of loading, from a stream over all assertions.

    Windows are given off once, when the watermark has passed them. The rows are replayed in one batch, so none is late; the watermark's
    delay is the span that the late rows of the table may have.
    """
    table = read(spark, d, "assertions").select("subject", "predicate", F.col("loaded_at").cast("timestamp").alias("loaded_at")).where("loaded_at IS NOT NULL")
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # The stream's source is a folder of its own: the table, and after it one row that moves the watermark past all windows.
    table.write.parquet(f"{folder}/in")
    last = table.agg(F.max("loaded_at").alias("loaded_at")).where("loaded_at IS NOT NULL")
    last.select(F.lit(None).cast("string").alias("subject"), F.lit(END).alias("predicate"), (F.col("loaded_at") + F.expr("INTERVAL 30 DAYS")).alias("loaded_at")).write.parquet(f"{folder}/end")
    source = spark.readStream.schema(table.schema).parquet(f"{folder}/in")

    def run(stream: DataFrame) -> None:
        query = (
            facts_by_window(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run(source)
    spark.read.parquet(f"{folder}/end").write.mode("append").parquet(f"{folder}/in")
    run(spark.readStream.schema(table.schema).parquet(f"{folder}/in"))
    given = spark.read.schema("start timestamp, subject string, predicate string, facts long").parquet(f"{folder}/out")
    return given.where(F.col("predicate") != END).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "subject", "predicate", "facts")


#: The predicate of the row that ends a replay.
END = "end of the table"

SQL = {
    "stream_facts": f"""SELECT strftime(loaded_at, '%Y-%m-%d') AS day, {sql_slug('subject')} AS subject, lower({sql_strip('predicate')}) AS predicate, count(*) AS facts
      FROM assertions WHERE loaded_at IS NOT NULL GROUP BY ALL"""
}


def queries() -> dict:
    return {"stream_facts": stream_facts}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
