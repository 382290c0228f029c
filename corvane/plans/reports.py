"""Counts, maintenance reports, dashboard views, entity reports and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import markdown as M
from corvane.functions.text import STOP_WORDS, query_terms, slug, strip_space
from corvane.operators import state
from corvane.operators.extraction import parse_payloads, write_back
from corvane.operators.merge import merge_groups, repointed
from corvane.operators.substrings import contained
from corvane.plans.base import AS_OF, CHUNKS_SQL, MENTIONS_SQL, RELATIONS_SQL, chunks, mentions, read, relations, sql_links, sql_slug, sql_strip, today

COUNTED = ("sources", "documents", "chunks", "vectors", "entities", "entity_aliases", "assertions", "meetings", "transcript_turns")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table."""
    out = None
    for name in COUNTED:
        part = read(spark, d, name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


def source_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents and chunks of every source, also of those without any."""
    held = chunks(spark, d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    per = read(spark, d, "documents").select("doc_id", "source_id").join(held, "doc_id", "left").groupBy("source_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks")
    )
    return read(spark, d, "sources").select(F.col("id").alias("source_id"), "name", "weight").join(per, "source_id", "left").select(
        "name", "weight", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks")
    )


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts in normal form, loaded rows once."""
    rows = read(spark, d, "assertions").select(
        "doc_id", "line", slug(F.col("subject")).alias("subject"), F.lower(strip_space(F.col("predicate"))).alias("predicate"), strip_space(F.col("value")).alias("value"),
        strip_space(F.col("since")).alias("since"), F.nullif(strip_space(F.col("until")), F.lit("")).alias("until"), "functional",
    )
    return rows.distinct()


def overview_health(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector, documents without links, without chunks, without a date, superseded ones."""
    held = chunks(spark, d, "doc_id", "sha").select("id", "doc_id", "sha")
    docs = read(spark, d, "documents").select("doc_id", "doc_date", "superseded_by")
    linked = mentions(spark, d).join(held.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id").select("doc_id").distinct()
    parts = {
        "chunks_without_vector": held.join(read(spark, d, "vectors").where("vec IS NOT NULL").select("sha").distinct(), "sha", "left_anti"),
        "documents_without_links": docs.join(linked, "doc_id", "left_anti"),
        "documents_without_chunks": docs.join(held.select("doc_id").distinct(), "doc_id", "left_anti"),
        "documents_without_date": docs.where("doc_date IS NULL"),
        "documents_superseded": docs.where("superseded_by IS NOT NULL"),
    }
    out = None
    for name, rows in parts.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def hubs(spark: SparkSession, d: str) -> DataFrame:
    """The twelve entities mentioned by most chunks, with the number of their relations."""
    ends = relations(spark, d).select("src", "dst", "type").select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("relations"))
    seen = mentions(spark, d).groupBy("entity").agg(F.count("*").alias("chunks"))
    return seen.join(ends, "entity", "left").select("entity", "chunks", F.coalesce("relations", F.lit(0)).alias("relations")).orderBy(F.desc("chunks"), "entity").limit(12)


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Documents of enriched sources none of whose chunks mentions anything."""
    linked = mentions(spark, d).join(chunks(spark, d, "doc_id").withColumnRenamed("id", "chunk_id"), "chunk_id").select("doc_id").distinct()
    enriched = read(spark, d, "sources").where("enrich").select(F.col("id").alias("source_id"))
    return read(spark, d, "documents").join(enriched, "source_id", "left_semi").join(linked, "doc_id", "left_anti").select("doc_id", "source", "rel_path")


def thin_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with fewer than 60 spaces in all their chunks, or without chunks."""
    spaces = chunks(spark, d, "doc_id", "text").groupBy("doc_id").agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("words"))
    return read(spark, d, "documents").select("doc_id", "source", "rel_path").join(spaces, "doc_id", "left").where("words IS NULL OR words < 60")


def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Open facts of a subject and predicate that hold one value at a time and have more than one: each with its value and place."""
    open_facts = _facts(spark, d).where("functional AND until IS NULL AND subject <> ''")
    several = open_facts.groupBy("subject", "predicate").agg(F.count("*").alias("facts")).where("facts > 1")
    paths = read(spark, d, "documents").select("doc_id", "rel_path")
    listed = open_facts.join(several, ["subject", "predicate"]).join(paths, "doc_id")
    return listed.select("subject", "predicate", "value", "since", F.concat_ws(":", "rel_path", "line").alias("at"), "facts")


def duplicate_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts stated alike in more than one file."""
    paths = read(spark, d, "documents").select("doc_id", "rel_path")
    stated = _facts(spark, d).join(paths, "doc_id")
    return stated.groupBy("subject", "predicate", F.lower("value").alias("value")).agg(F.countDistinct("rel_path").alias("files")).where("files > 1")


def ageing_facts(spark: SparkSession, d: str) -> DataFrame:
    """Open facts since twelve months or longer."""
    age = M.months_since(F.col("since"), today())
    return _facts(spark, d).where("functional AND until IS NULL").withColumn("months", age).where("months >= 12").select("doc_id", "line", "subject", "predicate", "value", "since", "months")


def superseded(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have a successor, and whether it is held."""
    docs = read(spark, d, "documents").select("doc_id", "source", "rel_path", "superseded_by")
    names = docs.select(F.substring_index("rel_path", "/", -1).alias("file")).distinct().withColumn("held", F.lit(True))
    old = docs.where("superseded_by IS NOT NULL")
    return old.join(names, old["superseded_by"] == names["file"], "left").select("doc_id", "rel_path", "superseded_by", F.coalesce("held", F.col("superseded_by") == "self").alias("held"))


def corpus_view(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source and folder: their number, chunks, and how many mention anything."""
    held = chunks(spark, d, "doc_id")
    linked = mentions(spark, d).select("chunk_id").distinct().join(held.withColumnRenamed("id", "chunk_id"), "chunk_id").select("doc_id").distinct().withColumn("linked", F.lit(1))
    per = held.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    folder = F.when(F.instr("rel_path", "/") > 0, F.substring_index("rel_path", "/", 1)).otherwise("(root)")
    return (
        read(spark, d, "documents").select("doc_id", "source", folder.alias("folder")).join(per, "doc_id", "left").join(linked, "doc_id", "left")
        .groupBy("source", "folder").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"))
    )


def communities_view(spark: SparkSession, d: str) -> DataFrame:
    """For each subject's group: its most mentioned member (20 shown at most), the number of members, and the source that mentions it most."""
    members = relations(spark, d).select(F.col("src").alias("grp"), F.col("dst").alias("entity")).unionByName(relations(spark, d).select(F.col("src").alias("grp"), F.col("src").alias("entity"))).distinct()
    seen = mentions(spark, d)
    counted = members.join(seen.groupBy("entity").agg(F.count("*").alias("mentions")), "entity", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    lead = counted.groupBy("grp").agg(F.count("*").alias("members"), F.min(F.struct((-F.col("mentions")).alias("m"), F.col("entity").alias("e"))).alias("lead"))
    by_source = (
        seen.join(chunks(spark, d, "doc_id").withColumnRenamed("id", "chunk_id"), "chunk_id").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")
        .groupBy("entity", "source").agg(F.count("*").alias("n")).join(members, "entity").groupBy("grp", "source").agg(F.sum("n").alias("n"))
    )
    main = by_source.groupBy("grp").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("source").alias("s"))).alias("top"))
    return lead.where("members >= 3").join(main, "grp", "left").select("grp", "members", F.col("lead.e").alias("first_member"), F.col("top.s").alias("source"))


def theme_search(spark: SparkSession, d: str) -> DataFrame:
    """The six areas of interest (sources' folders) whose titles share most terms with each question; questions are titles of documents with ids divisible by 50."""
    docs = read(spark, d, "documents").where("title IS NOT NULL").select("doc_id", "source", M.area(F.col("source"), F.col("rel_path")).alias("area"), F.array_distinct(query_terms(F.col("title"))).alias("terms"))
    held = docs.select("area", F.explode("terms").alias("term")).distinct()
    asked = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.greatest(F.size("terms"), F.lit(1)).alias("n"), F.explode("terms").alias("term"))
    scored = asked.join(held, "term").groupBy("query_id", "area", "n").agg(F.count("*").alias("hits")).select("query_id", "area", F.round(F.col("hits") / F.col("n"), 6).alias("overlap"))
    best = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "area")
    return scored.withColumn("place", F.row_number().over(best)).where("place <= 6")


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    """What to ask: the six most mentioned entities and the four largest groups of facts."""
    top = mentions(spark, d).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(6).select(F.lit("entity").alias("kind"), F.col("entity").alias("subject"), "n")
    groups = relations(spark, d).groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(4).select(F.lit("themes").alias("kind"), F.col("src").alias("subject"), "n")
    return top.unionByName(groups)


def entity_report_related(spark: SparkSession, d: str) -> DataFrame:
    """Relations of every entity from its own side, the thirty heaviest."""
    both = relations(spark, d).select(F.col("src").alias("entity"), F.col("dst").alias("other"), "type", "weight").unionByName(
        relations(spark, d).select(F.col("dst").alias("entity"), F.col("src").alias("other"), "type", "weight")
    )
    best = Window.partitionBy("entity").orderBy(F.desc("weight"), "other", "type")
    return both.withColumn("place", F.row_number().over(best)).where("place <= 30").select("entity", "other", "type", F.col("weight").cast("double").alias("weight"), "place")


def entity_documents(spark: SparkSession, d: str) -> DataFrame:
    """For every entity the twenty documents that mention it most."""
    counted = mentions(spark, d).join(chunks(spark, d, "doc_id").withColumnRenamed("id", "chunk_id"), "chunk_id").groupBy("entity", "doc_id").agg(F.count("*").alias("mentions"))
    best = Window.partitionBy("entity").orderBy(F.desc("mentions"), "doc_id")
    return counted.withColumn("place", F.row_number().over(best)).where("place <= 20")


def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    """For each entity without description, up to eight others whose slug contains its slug."""
    named = read(spark, d, "entities").where("norm <> ''").select("id", "norm", F.coalesce(strip_space(F.col("description")), F.lit("")).alias("description"))
    asked = named.where("description = ''").select(F.col("id").alias("needle_id"), F.col("norm").alias("needle"))
    pairs = contained(asked, named.select(F.col("id").alias("text_id"), F.col("norm").alias("text"))).where("needle_id <> text_id")
    found = pairs.select(F.col("needle_id").alias("asked"), F.col("text_id").alias("id")).join(named.select("id", "norm"), "id")
    best = Window.partitionBy("asked").orderBy("norm", "id")
    return found.withColumn("place", F.row_number().over(best)).where("place <= 8").select("asked", "id", "place")


def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For the slug of every alias the entity that it names: the one whose own slug it is, else the first that has it as an alias."""
    entities = read(spark, d, "entities").select("id", "norm")
    aliases = read(spark, d, "entity_aliases").select(F.col("entity_id").alias("id"), slug(F.col("alias")).alias("name")).where("name <> ''").distinct()
    named = entities.select(F.col("norm").alias("name"), F.col("id"), F.lit(0).alias("by_alias")).unionByName(aliases.join(entities.select("id"), "id").withColumn("by_alias", F.lit(1)))
    asked = aliases.select("name").distinct()
    return named.join(asked, "name", "left_semi").groupBy("name").agg(F.min(F.struct("by_alias", "id")).alias("m")).select("name", F.col("m.id").alias("id"), (F.col("m.by_alias") == 0).alias("own"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): entity a has an alias whose slug is the norm of entity b."""
    named = read(spark, d, "entities").select(F.col("id").alias("b"), F.col("norm").alias("alias"))
    aliases = read(spark, d, "entity_aliases").select(F.col("entity_id").alias("a"), slug(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    return aliases.join(named, "alias").where("a <> b").select("a", "b").distinct()


def alias_claims(spark: SparkSession, d: str) -> DataFrame:
    """Entities that are named by another's alias."""
    return _claims(spark, d)


def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of entities each named by an alias of the other."""
    claims = _claims(spark, d)
    return claims.where("a < b").join(claims.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi")


def _merge_members(spark: SparkSession, d: str) -> DataFrame:
    """(component, node, norm, name, mentions) of entities that name each other by aliases, chains included."""
    pairs = mutual_pairs(spark, d)
    seen = mentions(spark, d).groupBy(F.col("entity").alias("norm")).agg(F.count("*").alias("mentions"))
    entities = read(spark, d, "entities").select(F.col("id").alias("node"), "norm", strip_space(F.col("name")).alias("name"))
    return merge_groups(pairs, entities.join(seen, "norm", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))))


def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Groups of entities that name each other: the keeper (most mentions, then the smallest id) and the longest name."""
    return _merge_members(spark, d).groupBy("component", "keeper", "label").agg(F.count("*").alias("entities")).select("component", "entities", "keeper", "label")


def merged_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations after the merge plan: ends that were merged point to their keeper, and each triple is held once."""
    members = _merge_members(spark, d)
    keepers = members.where("node = keeper").select("component", F.col("norm").alias("keeper_norm"))
    moved = members.where("node <> keeper").join(keepers, "component").select("norm", "keeper_norm")
    return repointed(relations(spark, d), moved)


def longest_description(spark: SparkSession, d: str) -> DataFrame:
    """For each entity type and first word of a name the longest description, the first by id on ties."""
    rows = read(spark, d, "entities").where("description IS NOT NULL").select("id", "type", F.substring_index("norm", "-", 1).alias("word"), "description")
    best = F.min(F.struct((-F.length("description")).alias("x"), "id", "description"))
    return rows.groupBy("type", "word").agg(best.alias("b")).select("type", "word", F.col("b.description").alias("description"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue of chunks as it stands: those with a vector are done or leased at their document's time, by a rule on the digest."""
    first = F.conv(F.substring("sha", 1, 2), 16, 10).cast("int")
    status = F.when(first % 3 == 0, "done").when(first % 3 == 1, "leased").otherwise("pending")
    at = F.timestamp_seconds(F.lit(1_782_777_600) - first * 60)
    return read(spark, d, "vectors").where("sha IS NOT NULL").select("sha").distinct().select("sha", status.alias("status"), at.alias("updated_at"))


NOW = "2026-06-30 00:00:00"


def enqueue_missing(spark: SparkSession, d: str) -> DataFrame:
    """The queue after chunks of enriched sources that it doesn't hold were added."""
    enriched = read(spark, d, "sources").where("enrich").select(F.col("id").alias("source_id"))
    docs = read(spark, d, "documents").join(enriched, "source_id", "left_semi").select("doc_id")
    new = chunks(spark, d, "doc_id", "sha").join(docs, "doc_id", "left_semi").select("sha").distinct().select("sha", F.lit("pending").alias("status"), F.lit(NOW).cast("timestamp").alias("updated_at"))
    return state.insert_missing(_queue(spark, d), new, ["sha"]).groupBy("status").agg(F.count("*").alias("n"))


def lease_reset(spark: SparkSession, d: str) -> DataFrame:
    """The queue after leases of more than thirty minutes were released."""
    return state.release_leases(_queue(spark, d), F.lit(NOW).cast("timestamp")).select("sha", "status", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def lease_pull(spark: SparkSession, d: str) -> DataFrame:
    """The queue's rows that are leased when the sixty oldest pending ones are pulled."""
    pulled = state.lease(_queue(spark, d), "sha", [F.asc("updated_at")], 60, F.lit(NOW).cast("timestamp"))
    return pulled.where((F.col("status") == "leased") & (F.col("updated_at") == F.lit(NOW).cast("timestamp"))).select("sha")


def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of the older files after all dated ones were put in: their keys once, with the newer row."""
    docs = read(spark, d, "documents").select("source", "rel_path", "sha", "mtime", "doc_date")
    old = docs.where("mtime < 1704067200").select("source", "rel_path", F.lit("before").alias("sha"), "mtime")
    return state.upsert(old, docs.where("doc_date IS NOT NULL"), ["source", "rel_path"])


def queue_complete(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of results that were handed in for the first chunk of every document: done, or skipped with the reason."""
    handed = chunks(spark, d, "ordinal", "sha").where("ordinal = 0").select("sha").distinct()
    new, skipped = state.complete(_queue(spark, d), "sha", handed, F.lit(NOW).cast("timestamp"))
    done = new.where("status = 'done'").join(handed, "sha", "left_semi").join(skipped, "sha", "left_anti").select("sha", F.lit("done").alias("outcome"))
    return done.unionByName(skipped.select("sha", F.col("reason").alias("outcome")))


def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that garbage collection drops: their text is no longer held."""
    return read(spark, d, "vectors").where("sha IS NOT NULL").select("sha").distinct().join(read(spark, d, "chunks").select("sha"), "sha", "left_anti")


def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    """For each source its chunks, how many different texts they hold, and how many of these have no vector."""
    docs = read(spark, d, "documents").select("doc_id", "source")
    with_vector = read(spark, d, "vectors").where("vec IS NOT NULL").select("sha").distinct().withColumn("has", F.lit(True))
    rows = chunks(spark, d, "doc_id", "sha").join(docs, "doc_id")
    texts = rows.groupBy("source", "sha").agg(F.count("*").alias("chunks")).join(with_vector, "sha", "left")
    return texts.groupBy("source").agg(F.sum("chunks").alias("chunks"), F.count("*").alias("texts"), F.count_if(F.col("has").isNull()).alias("without_vector"))


def _written_back(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Tables from write-back payloads, one for each text: the names that it links to, each related to the first one by name."""
    names = F.array_sort(F.array_distinct(M.links(F.col("text"))))
    found = read(spark, d, "chunks").where("sha IS NOT NULL").groupBy("sha").agg(F.min("text").alias("text")).select("sha", names.alias("names")).where(F.size("names") > 0)
    result = F.struct(
        "sha", F.transform("names", lambda n: F.struct(n.alias("name"), F.lit("Product").alias("type"), F.reverse(n).alias("description"), F.array(F.concat(F.lit("the "), n)).alias("aliases"))).alias("entities"),
        F.transform("names", lambda n: F.struct(n.alias("src"), F.element_at("names", 1).alias("dst"), F.lit("stands beside").alias("type"))).alias("relations"),
    )
    payloads = found.select(F.col("sha").alias("seq"), F.to_json(F.array(result)).alias("payload"))
    known = read(spark, d, "entity_aliases").select(F.col("entity_id").alias("id"), slug(F.col("alias")).alias("alias")).join(read(spark, d, "entities").select("id", "norm"), "id")
    return write_back(parse_payloads(payloads), chunks(spark, d, "sha"), known)


def written_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations written back from payloads that are made of the links of all texts, with their reinforced weight."""
    return _written_back(spark, d)["relations"].select("src", "dst", "type", F.col("weight").cast("double").alias("weight"))


def written_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions written back from payloads: each entity in every chunk that has its text."""
    return _written_back(spark, d)["mentions"].select("chunk_id", F.col("norm").alias("entity"))


def index_diff(spark: SparkSession, d: str) -> DataFrame:
    """Changes between the files before and after: documents were there before if older than 2024, and had another text if their id is divisible by 7."""
    docs = read(spark, d, "documents").select("source", "rel_path", "sha", "doc_id", "mtime", "doc_date")
    old = docs.where("mtime < 1704067200").withColumn("sha", F.when(F.col("doc_id") % 7 == 0, F.lit("other")).otherwise(F.col("sha")))
    new = docs.where("doc_date IS NOT NULL")
    return state.difference(old, new, ["source", "rel_path"], "sha")


_FACT_SQL = f"""fact AS (SELECT DISTINCT doc_id, line, {sql_slug('subject')} AS subject, lower({sql_strip('predicate')}) AS predicate, {sql_strip('value')} AS value,
  {sql_strip('since')} AS since, nullif({sql_strip('until')}, '') AS until, functional FROM assertions)"""
_LINKED = "linked AS (SELECT DISTINCT doc_id FROM mention JOIN chunk ON chunk.id = chunk_id)"
_CLAIMS = f"claim AS (SELECT DISTINCT a.entity_id AS a, e.id AS b FROM (SELECT entity_id, {sql_slug('alias')} AS s FROM entity_aliases) a JOIN entities e ON e.norm = a.s WHERE a.s <> '' AND a.entity_id <> e.id)"
_MERGE = f"""{MENTIONS_SQL}, {_CLAIMS}, mutual AS (SELECT x.a, x.b FROM claim x JOIN claim y ON x.a = y.b AND x.b = y.a),
      reach AS (SELECT DISTINCT a AS node, a AS other FROM mutual UNION SELECT r.node, m.b FROM reach r JOIN mutual m ON m.a = r.other),
      grp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
      member AS (SELECT component, node, norm, {sql_strip('name')} AS name, (SELECT count(*) FROM mention WHERE entity = norm) AS mentions FROM grp JOIN entities ON entities.id = node),
      plan AS (SELECT *, first_value(node) OVER (PARTITION BY component ORDER BY mentions DESC, node) AS keeper, first_value(name) OVER (PARTITION BY component ORDER BY length(name) DESC, name) AS label FROM member)"""
_LINKS = f"linked_text AS (SELECT sha, list_sort(list_filter({sql_links('t')}, lambda x: length(x) >= 2)) AS ns FROM (SELECT sha, min(text) AS t FROM chunks WHERE sha IS NOT NULL GROUP BY sha))"
_QUEUE = """queue AS (SELECT sha, CASE (('0x' || substr(sha, 1, 2))::INT % 3) WHEN 0 THEN 'done' WHEN 1 THEN 'leased' ELSE 'pending' END AS status,
  make_timestamp((1782777600 - ('0x' || substr(sha, 1, 2))::INT * 60)::BIGINT * 1000000) AS updated_at FROM (SELECT DISTINCT sha FROM vectors WHERE sha IS NOT NULL))"""
_AGE = f"CASE WHEN length(since) = 4 THEN try_cast(since || '-01-01' AS DATE) WHEN length(since) = 7 THEN try_cast(since || '-01' AS DATE) WHEN length(since) = 10 THEN try_cast(since AS DATE) END"

SQL = {
    "status_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in COUNTED),
    "source_stats": f"""WITH {CHUNKS_SQL} SELECT s.name, s.weight, count(DISTINCT d.doc_id) AS documents, count(c.id) AS chunks
      FROM sources s LEFT JOIN documents d ON d.source_id = s.id LEFT JOIN chunk c USING (doc_id) GROUP BY s.id, s.name, s.weight""",
    "overview_health": f"""WITH {CHUNKS_SQL}, {MENTIONS_SQL}, {_LINKED}
      SELECT 'chunks_without_vector' AS "check", count(*) AS n FROM chunk WHERE sha NOT IN (SELECT sha FROM vectors WHERE vec IS NOT NULL AND sha IS NOT NULL)
      UNION ALL SELECT 'documents_without_links', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM linked)
      UNION ALL SELECT 'documents_without_chunks', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunk)
      UNION ALL SELECT 'documents_without_date', count(*) FROM documents WHERE doc_date IS NULL
      UNION ALL SELECT 'documents_superseded', count(*) FROM documents WHERE superseded_by IS NOT NULL""",
    "hubs": f"""WITH {MENTIONS_SQL}, {RELATIONS_SQL}, ends AS (SELECT e AS entity, count(*) AS n FROM (SELECT unnest([src, dst]) AS e FROM relation) GROUP BY e)
      SELECT m.entity, count(*) AS chunks, coalesce(any_value(n), 0) AS relations FROM mention m LEFT JOIN ends USING (entity) GROUP BY m.entity ORDER BY chunks DESC, m.entity LIMIT 12""",
    "orphans": f"""WITH {CHUNKS_SQL}, {MENTIONS_SQL}, {_LINKED} SELECT doc_id, source, rel_path FROM documents d
      WHERE source_id IN (SELECT id FROM sources WHERE enrich) AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.doc_id = d.doc_id)""",
    "thin_documents": f"""WITH {CHUNKS_SQL}, w AS (SELECT doc_id, sum(length(text) - length(replace(text, ' ', ''))) AS words FROM chunk GROUP BY doc_id)
      SELECT doc_id, source, rel_path, words FROM documents LEFT JOIN w USING (doc_id) WHERE words IS NULL OR words < 60""",
    "contradictions": f"""WITH {_FACT_SQL}, o AS (SELECT *, count(*) OVER (PARTITION BY subject, predicate) AS facts FROM fact WHERE functional AND until IS NULL AND subject <> '')
      SELECT subject, predicate, value, since, rel_path || ':' || line AS at, facts FROM o JOIN documents USING (doc_id) WHERE facts > 1""",
    "duplicate_facts": f"""WITH {_FACT_SQL} SELECT subject, predicate, lower(value) AS value, count(DISTINCT rel_path) AS files FROM fact JOIN documents USING (doc_id)
      GROUP BY ALL HAVING count(DISTINCT rel_path) > 1""",
    "ageing_facts": f"""WITH {_FACT_SQL}, aged AS (SELECT *, (2026 - year({_AGE})) * 12 + 6 - month({_AGE}) AS months FROM fact WHERE functional AND until IS NULL)
      SELECT doc_id, line, subject, predicate, value, since, months FROM aged WHERE months >= 12""",
    "superseded": """SELECT doc_id, rel_path, superseded_by, superseded_by = 'self' OR superseded_by IN (SELECT regexp_replace(rel_path, '^.*/', '') FROM documents) AS held
      FROM documents WHERE superseded_by IS NOT NULL""",
    "corpus_view": f"""WITH {CHUNKS_SQL}, {MENTIONS_SQL}, {_LINKED}, n AS (SELECT doc_id, count(*) AS c FROM chunk GROUP BY doc_id)
      SELECT source, CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) ELSE '(root)' END AS folder, count(*) AS documents, coalesce(sum(c), 0)::BIGINT AS chunks,
        count(l.doc_id) AS linked FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN linked l USING (doc_id) GROUP BY ALL""",
    "communities_view": f"""WITH {CHUNKS_SQL}, {MENTIONS_SQL}, {RELATIONS_SQL}, member AS (SELECT src AS grp, dst AS entity FROM relation UNION SELECT src, src FROM relation),
      seen AS (SELECT entity, count(*) AS n FROM mention GROUP BY entity),
      lead AS (SELECT grp, count(*) AS members, (list(m.entity ORDER BY coalesce(n, 0) DESC, m.entity))[1] AS first_member FROM member m LEFT JOIN seen USING (entity) GROUP BY grp),
      src AS (SELECT grp, source, count(*) AS n FROM member JOIN mention USING (entity) JOIN chunk ON chunk.id = chunk_id JOIN documents USING (doc_id) GROUP BY ALL),
      main AS (SELECT grp, (list(source ORDER BY n DESC, source))[1] AS source FROM src GROUP BY grp)
      SELECT grp, members, first_member, source FROM lead LEFT JOIN main USING (grp) WHERE members >= 3""",
    "theme_search": rf"""WITH t AS (SELECT doc_id, source || '/' || CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) ELSE 'root' END AS area,
        list_transform(regexp_extract_all(title, '[\p{{L}}\p{{N}}_''’-]+'), lambda w: lower(w)) AS ws FROM documents WHERE title IS NOT NULL),
      k AS (SELECT doc_id, area, ws, list_filter(ws, lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(w) for w in STOP_WORDS)}], w)) AS ks FROM t),
      c AS (SELECT doc_id, area, list_distinct(CASE WHEN len(ks) > 0 THEN ks ELSE ws END) AS ts FROM k),
      held AS (SELECT DISTINCT area, unnest(ts) AS term FROM c), asked AS (SELECT doc_id AS query_id, greatest(len(ts), 1) AS n, unnest(ts) AS term FROM c WHERE doc_id % 50 = 0),
      s AS (SELECT query_id, h.area, round(count(*) / n, 6) AS overlap FROM asked JOIN held h USING (term) GROUP BY query_id, h.area, n)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, area) AS place FROM s QUALIFY place <= 6""",
    "suggestions": f"""WITH {MENTIONS_SQL}, {RELATIONS_SQL}
      (SELECT 'entity' AS kind, entity AS subject, count(*) AS n FROM mention GROUP BY entity ORDER BY n DESC, entity LIMIT 6)
      UNION ALL (SELECT 'themes', src, count(*) AS n FROM relation GROUP BY src ORDER BY n DESC, src LIMIT 4)""",
    "entity_report_related": f"""WITH {RELATIONS_SQL}, way AS (SELECT src AS entity, dst AS other, type, weight FROM relation UNION ALL SELECT dst, src, type, weight FROM relation)
      SELECT entity, other, type, weight::DOUBLE AS weight, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, other, type) AS place FROM way QUALIFY place <= 30""",
    "entity_documents": f"""WITH {CHUNKS_SQL}, {MENTIONS_SQL}, n AS (SELECT entity, doc_id, count(*) AS mentions FROM mention JOIN chunk ON chunk.id = chunk_id GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mentions DESC, doc_id) AS place FROM n QUALIFY place <= 20""",
    "did_you_mean": f"""SELECT a.id AS asked, b.id, row_number() OVER (PARTITION BY a.id ORDER BY b.norm, b.id) AS place
      FROM entities a JOIN entities b ON a.id <> b.id AND contains(b.norm, a.norm)
      WHERE coalesce({sql_strip('a.description')}, '') = '' AND a.norm <> '' QUALIFY place <= 8""",
    "entity_lookup": f"""WITH al AS (SELECT DISTINCT entity_id, {sql_slug('alias')} AS name FROM entity_aliases SEMI JOIN entities ON entities.id = entity_id WHERE {sql_slug('alias')} <> '')
      SELECT a.name, coalesce(any_value(e.id), min(a.entity_id)) AS id, any_value(e.id) IS NOT NULL AS own FROM al a LEFT JOIN entities e ON e.norm = a.name GROUP BY a.name""",
    "alias_claims": f"WITH {_CLAIMS} SELECT a, b FROM claim",
    "mutual_pairs": f"WITH {_CLAIMS} SELECT x.a, x.b FROM claim x JOIN claim y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b",
    "merge_plan": f"""WITH RECURSIVE {_MERGE} SELECT component, count(*) AS entities, any_value(keeper) AS keeper, any_value(label) AS label FROM plan GROUP BY component""",
    "merged_relations": f"""WITH RECURSIVE {_MERGE}, {RELATIONS_SQL},
      moved AS (SELECT p.norm, k.norm AS keeper_norm FROM plan p JOIN entities k ON k.id = p.keeper WHERE p.node <> p.keeper),
      r AS (SELECT src AS s, dst AS t, type, weight, coalesce(m.keeper_norm, src) AS src, coalesce(n.keeper_norm, dst) AS dst
        FROM relation LEFT JOIN moved m ON m.norm = src LEFT JOIN moved n ON n.norm = dst)
      SELECT src, dst, type, weight::DOUBLE AS weight FROM r WHERE src <> dst
      QUALIFY row_number() OVER (PARTITION BY src, dst, type ORDER BY (s <> src)::INT + (t <> dst)::INT, s, t) = 1""",
    "document_upsert": """SELECT source, rel_path, 'before' AS sha, mtime FROM documents o WHERE mtime < 1704067200
        AND NOT EXISTS (SELECT 1 FROM documents n WHERE n.source = o.source AND n.rel_path = o.rel_path AND n.doc_date IS NOT NULL)
      UNION ALL SELECT source, rel_path, sha, mtime FROM documents WHERE doc_date IS NOT NULL""",
    "queue_complete": f"""WITH {CHUNKS_SQL}, {_QUEUE} SELECT h.sha, CASE WHEN status IS NULL THEN 'unknown' WHEN status = 'done' THEN 'already done' ELSE 'done' END AS outcome
      FROM (SELECT DISTINCT sha FROM chunk WHERE ordinal = 0 AND sha IS NOT NULL) h LEFT JOIN queue USING (sha)""",
    "written_relations": f"""WITH {_LINKS}, p AS (SELECT x AS src, ns[1] AS dst FROM (SELECT ns, unnest(ns) AS x FROM linked_text))
      SELECT src, dst, 'stands-beside' AS type, (1 + 0.5 * (count(*) - 1))::DOUBLE AS weight FROM p WHERE src <> dst GROUP BY src, dst""",
    "written_mentions": f"""WITH {_LINKS} SELECT DISTINCT c.id AS chunk_id, x AS entity FROM (SELECT sha, unnest(ns) AS x FROM linked_text) JOIN chunks c USING (sha) WHERE length(x) >= 2""",
    "stale_vectors": "SELECT DISTINCT sha FROM vectors WHERE sha IS NOT NULL AND sha NOT IN (SELECT sha FROM chunks WHERE sha IS NOT NULL)",
    "distinct_texts": f"""WITH {CHUNKS_SQL} SELECT source, count(*) AS chunks, count(DISTINCT c.sha) AS texts, count(DISTINCT c.sha) FILTER (c.sha NOT IN (SELECT sha FROM vectors WHERE vec IS NOT NULL)) AS without_vector
      FROM chunk c JOIN documents USING (doc_id) GROUP BY source""",
    "longest_description": """SELECT type, split_part(norm, '-', 1) AS word, (list(description ORDER BY length(description) DESC, id))[1] AS description
      FROM entities WHERE description IS NOT NULL GROUP BY ALL""",
    "enqueue_missing": f"""WITH {CHUNKS_SQL}, {_QUEUE}, new AS (SELECT DISTINCT chunk.sha FROM chunk JOIN documents USING (doc_id) JOIN sources s ON s.id = source_id WHERE enrich)
      SELECT status, count(*) AS n FROM (SELECT sha, status FROM queue UNION ALL SELECT sha, 'pending' FROM new WHERE sha NOT IN (SELECT sha FROM queue)) GROUP BY status""",
    "lease_reset": f"""WITH {_QUEUE}, s AS (SELECT *, status = 'leased' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE AS stale FROM queue)
      SELECT sha, CASE WHEN stale THEN 'pending' ELSE status END AS status, strftime(CASE WHEN stale THEN TIMESTAMP '{NOW}' ELSE updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM s""",
    "lease_pull": f"WITH {_QUEUE} (SELECT sha FROM queue WHERE status = 'pending' ORDER BY updated_at, sha LIMIT 60) UNION ALL (SELECT sha FROM queue WHERE status = 'leased' AND updated_at = TIMESTAMP '{NOW}')",
    "index_diff": """WITH o AS (SELECT source, rel_path, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE sha END AS sha FROM documents WHERE mtime < 1704067200),
      n AS (SELECT source, rel_path, sha FROM documents WHERE doc_date IS NOT NULL)
      SELECT coalesce(o.source, n.source) AS source, coalesce(o.rel_path, n.rel_path) AS rel_path,
        CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'updated' END AS change
      FROM o FULL JOIN n ON o.source = n.source AND o.rel_path = n.rel_path""",
}


def queries() -> dict:
    named = [
        status_counts, source_stats, overview_health, hubs, orphans, thin_documents, contradictions, duplicate_facts, ageing_facts, superseded, corpus_view,
        communities_view, theme_search, suggestions, entity_report_related, entity_documents, did_you_mean, entity_lookup, alias_claims, mutual_pairs, merge_plan, merged_relations, longest_description,
        enqueue_missing, lease_reset, lease_pull, index_diff, document_upsert, queue_complete, stale_vectors, distinct_texts, written_relations, written_mentions,
    ]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
