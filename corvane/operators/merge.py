"""Merging entities that are the same: groups with a keeper, and tables pointed to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.components import connected_components


def merge_groups(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities (``node, name, mentions`` and more) that ``pairs`` (``a, b``) link, chains included, with ``component``, ``keeper`` and ``label``.

    The keeper is the one most mentioned, then the smallest; the label is the longest name, then the first. Null names count as the shortest. Pairs come from
    both sides' claims: a claim of one side only is no synonym.
    """
    rows = connected_components(pairs, "a", "b").join(entities, "node")
    chosen = rows.groupBy("component").agg(
        F.min(F.struct((-F.col("mentions")).alias("m"), "node")).alias("k"), F.min(F.struct((-F.length(F.coalesce("name", F.lit("")))).alias("n"), "name")).alias("l")
    )
    return rows.join(chosen.select("component", F.col("k.node").alias("keeper"), F.col("l.name").alias("label")), "component")


def repointed(relations: DataFrame, moved: DataFrame) -> DataFrame:
    """Relations (``src, dst, type, weight``) with their ends renamed by ``moved`` (``norm, keeper_norm``).

    Of rows that become the same triple the one that was it already stays, then the one with fewest renamed ends, then the first; weights are not added.
    Relations of an entity with itself fall away.
    """
    def renamed(end: str) -> DataFrame:
        return moved.select(F.col("norm").alias(end), F.col("keeper_norm").alias(f"{end}_now"))

    rows = relations.join(renamed("src"), "src", "left").join(renamed("dst"), "dst", "left")
    ends = rows.select(
        F.coalesce("src_now", "src").alias("s"), F.coalesce("dst_now", "dst").alias("t"), "type", "weight", "src", "dst",
        (F.col("src_now").isNotNull().cast("int") + F.col("dst_now").isNotNull().cast("int")).alias("renamed"),
    ).where("s <> t")
    first = Window.partitionBy("s", "t", "type").orderBy("renamed", "src", "dst")
    return ends.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("s").alias("src"), F.col("t").alias("dst"), "type", F.col("weight").cast("double").alias("weight"))
