"""Writing back what readers extracted from chunks: entities, aliases, mentions and relations from JSON payloads.

Entities are keyed by slug, mentions by chunk. Everything is joins and aggregations over all payloads at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import slug, strip_space

# The types that an entity can have; any other counts as concept.
TYPES = ("person", "organisation", "product", "place", "concept", "event", "decision")

_RESULT = (
    "struct<sha:string,entities:array<struct<name:string,type:string,description:string,aliases:array<string>>>,"
    "relations:array<struct<src:string,dst:string,type:string,description:string>>>"
)


def parse_payloads(payloads: DataFrame, strict: bool = False) -> DataFrame:
    """(``seq``, ``sha``, ``entities``, ``relations``) of JSON texts (``seq, payload``): a list of results, or one under ``results``.

    Texts that are no JSON, results without a sha and nulls give no rows; with ``strict`` a text that is no JSON is an error.
    """
    if strict:
        broken = F.col("payload").isNotNull() & F.try_parse_json("payload").isNull()
        payloads = payloads.withColumn("payload", F.when(broken, F.raise_error(F.concat(F.lit("no JSON in payload "), F.col("seq").cast("string")))).otherwise(F.col("payload")))
    bare = F.from_json("payload", f"array<{_RESULT}>")
    wrapped = F.from_json("payload", f"struct<results:array<{_RESULT}>>")["results"]
    listed = F.when(F.trim("payload").startswith("["), bare).otherwise(wrapped)
    return payloads.select("seq", F.inline(listed)).where("sha <> ''")


def _longest(text: str, *order: str) -> Column:
    """The longest text of a group, the first in order on ties."""
    return F.min_by(text, F.struct(-F.length(text), *order))


def write_back(results: DataFrame, chunks: DataFrame, known: DataFrame) -> dict[str, DataFrame]:
    """Tables from parsed results: ``entities`` (norm, name, type, description), ``aliases`` (norm, alias), ``mentions`` (chunk_id,
    norm), ``relations`` (src, dst, type, description, weight), ``done`` and ``skipped`` (sha).

    ``chunks`` has ``id, sha``; results for other shas are skipped. ``known`` (norm, alias) are the aliases so far: a relation's end
    is an entity of its own result, else the entity with the smallest norm that has it as alias. Ends that are
    nobody's and relations of an entity with itself are left out. Of several descriptions the longest stays, of types and names the first. A relation
    told n times weighs 1 + (n - 1) / 2.
    """
    held = chunks.where("sha IS NOT NULL").select("sha", F.col("id").alias("chunk_id"))
    shas = held.select("sha").distinct()
    live = results.join(shas, "sha", "left_semi")
    named = (
        live.select("seq", "sha", F.posexplode("entities").alias("at", "e"))
        .select(
            "seq", "sha", "at", slug(F.col("e.name")).alias("norm"), strip_space(F.col("e.name")).alias("name"), F.lower(F.coalesce("e.type", F.lit("concept"))).alias("kind"),
            F.coalesce(strip_space(F.col("e.description")), F.lit("")).alias("description"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"),
        )
        .where(F.length("norm") >= 2)
    )
    first = F.struct("seq", "sha", "at")
    kind = F.when(F.col("kind").isin(*TYPES), F.col("kind")).otherwise("concept")
    entities = named.groupBy("norm").agg(F.min_by("name", first).alias("name"), F.min_by(kind, first).alias("type"), _longest("description", "seq", "sha", "at").alias("description"))
    aliases = (
        named.select("norm", F.explode("aliases").alias("a")).select("norm", slug(F.col("a")).alias("alias")).where(F.length("alias") > 2)
        .unionByName(named.select("norm", F.col("norm").alias("alias"))).distinct()
    )
    mentions = named.select("sha", "norm").distinct().join(held, "sha").select("chunk_id", "norm").distinct()

    by_alias = known.select("norm", "alias").unionByName(aliases).groupBy("alias").agg(F.min("norm").alias("found"))
    own = named.select("sha", "norm").distinct()
    told = live.select("seq", "sha", F.posexplode("relations").alias("at", "r")).select(
        "seq", "sha", "at", slug(F.col("r.src")).alias("src"), slug(F.col("r.dst")).alias("dst"), slug(F.coalesce("r.type", F.lit("related"))).alias("type"),
        F.coalesce(strip_space(F.col("r.description")), F.lit("")).alias("description"),
    )
    for end in ("src", "dst"):
        inside = own.select("sha", F.col("norm").alias(end), F.col("norm").alias(f"{end}_own"))
        told = told.join(inside, ["sha", end], "left").join(by_alias.select(F.col("alias").alias(end), F.col("found").alias(f"{end}_alias")), end, "left")
    ended = told.select(
        "seq", "sha", "at", F.coalesce("src_own", "src_alias").alias("src"), F.coalesce("dst_own", "dst_alias").alias("dst"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("related")).alias("type"), "description",
    ).where("src <> dst")
    relations = ended.groupBy("src", "dst", "type").agg(_longest("description", "seq", "sha", "at").alias("description"), (1.0 + 0.5 * (F.count("*") - 1)).alias("weight"))
    return {
        "entities": entities, "aliases": aliases, "mentions": mentions, "relations": relations,
        "done": live.select("sha").distinct(), "skipped": results.select("sha").distinct().join(shas, "sha", "left_anti"),
    }
