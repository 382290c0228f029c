"""What a summary of a community is made from: its members, their digest, and the relations among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.joins import small


def member_digests(members: DataFrame) -> DataFrame:
    """(``community``, ``members``, ``digest``) of (``community``, ``node``), each node once: the digest changes with the members, whatever their order.

    It adds up the members' hashes in two ways, so a community of any size is reduced where its rows are.
    """
    first, second = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    sums = members.groupBy("community").agg(F.count("*").alias("members"), F.bit_xor(first).alias("x"), F.sum(F.pmod(second, F.lit(2**31))).alias("y"))
    return sums.select("community", "members", F.sha2(F.concat_ws(",", "members", "x", "y"), 256).alias("digest"))


def pending(digests: DataFrame, summaries: DataFrame) -> DataFrame:
    """Communities (``community, digest``) that have no summary (``community, digest``) or one written for other members."""
    return digests.join(summaries.select("community", "digest"), ["community", "digest"], "left_anti")


def shown_members(members: DataFrame, mentions: DataFrame, limit: int = 60) -> DataFrame:
    """(``community``, ``node``, ``mentions``, ``place``, ``members``, ``digest``): the most mentioned members, by name on ties, with the true number of members."""
    counted = members.join(mentions, "node", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    best = Window.partitionBy("community").orderBy(F.desc("mentions"), "node")
    top = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    return top.join(member_digests(members), "community").select("community", "node", "mentions", "place", "members", "digest")


def inner_relations(shown: DataFrame, relations: DataFrame, limit: int = 80) -> DataFrame:
    """(``community``, ``place``, ``src``, ``dst``, ``type``, ``weight``): the heaviest relations of which both ends are shown in the same community."""
    a = shown.select("community", F.col("node").alias("src"))
    b = shown.select("community", F.col("node").alias("dst"))
    inside = relations.join(a, "src").join(b, ["community", "dst"])
    best = Window.partitionBy("community").orderBy(F.desc("weight"), "src", "dst", "type")
    return inside.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("community", "place", "src", "dst", "type", F.col("weight").cast("double").alias("weight"))


def themes(questions: DataFrame, summaries: DataFrame, limit: int = 6) -> DataFrame:
    """(``query_id``, ``community``, ``score``, ``semantic``, ``overlap``, ``rating``, ``place``): summaries ranked for each question.

    ``questions`` has ``query_id, terms, vec``, ``summaries`` ``community, terms, rating, vec``; terms are arrays, vectors of unit length or null. The score is
    .6 of the cosine (0 where either has no vector or their sizes differ), .25 of the share of the question's terms that the summary has, and .15 of a tenth of the rating.
    The questions are a stated set, broadcast if they are few; each summary is held against all of them.
    """
    asked = small(questions.select("query_id", F.array_distinct("terms").alias("asked"), F.col("vec").alias("qvec")), 10_000)
    rows = summaries.join(asked, F.lit(True))
    usable = F.col("vec").isNotNull() & F.col("qvec").isNotNull() & (F.size("vec") == F.size("qvec"))
    dot = F.aggregate(F.zip_with("vec", "qvec", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    semantic = F.when(usable, dot).otherwise(0.0)
    overlap = F.size(F.array_intersect("asked", "terms")) / F.greatest(F.size("asked"), F.lit(1))
    scored = rows.select("query_id", "community", semantic.alias("semantic"), overlap.alias("overlap"), "rating")
    total = scored.withColumn("score", F.round(0.6 * F.col("semantic") + 0.25 * F.col("overlap") + 0.15 * F.col("rating") / 10, 9))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "community")
    return total.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
