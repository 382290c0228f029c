"""Queries over meetings and their raw transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import slug
from corvane.operators import state
from corvane.plans.base import AS_OF, read, sql_slug
from corvane.sources.meetings import file_stems, listing


NOW = f"{AS_OF} 00:00:00"


def _meetings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "meetings").distinct()


def meeting_listing(spark: SparkSession, d: str) -> DataFrame:
    """Meetings as listed: title, day, number of attendees, their names (e-mail address where there is none)."""
    return listing(_meetings(spark, d)).select("meeting_id", "title", "day", F.size("attendees").alias("attendees"), F.array_join("attendees", ", ").alias("names"))


def meeting_files(spark: SparkSession, d: str) -> DataFrame:
    """File of each meeting's transcript; those of one day and title are numbered."""
    return file_stems(listing(_meetings(spark, d)))


def meeting_sync_diff(spark: SparkSession, d: str) -> DataFrame:
    """Meetings asked for (all) against those received (with segments): synced, or not returned; and how many segments came late."""
    turns = read(spark, d, "transcript_turns")
    first = turns.groupBy("meeting_id").agg(F.count("*").alias("segments"), F.min("received_at").alias("began"))
    late = turns.join(first.select("meeting_id", "began"), "meeting_id").where(F.unix_timestamp("received_at") - F.unix_timestamp("began") > 43_200).groupBy("meeting_id").agg(F.count("*").alias("late"))
    asked = _meetings(spark, d).select("meeting_id").distinct()
    return asked.join(first, "meeting_id", "left").join(late, "meeting_id", "left").select(
        "meeting_id", F.when(F.col("segments").isNull(), "not_returned").otherwise("synced").alias("status"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("late", F.lit(0)).alias("late")
    )


def transcript_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each meeting's transcript file, numbered in the order of receipt: speaker, colon, text."""
    turns = read(spark, d, "transcript_turns").where("text IS NOT NULL")
    speaker = F.coalesce(F.nullif(F.trim(F.col("speaker")), F.lit("")), F.lit("Unknown"))
    return turns.select("meeting_id", "seg_id", F.concat(speaker, F.lit(": "), F.trim(F.regexp_replace("text", r"[\r\n\t ]+", " "))).alias("line"))


def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of each meeting by slug, with their segments and seconds between first and last."""
    turns = read(spark, d, "transcript_turns").where("speaker IS NOT NULL").select("meeting_id", slug(F.col("speaker")).alias("label"), "at_second")
    return turns.where("label <> ''").groupBy("meeting_id", "label").agg(
        F.count("*").alias("segments"), F.coalesce(F.max("at_second") - F.min("at_second"), F.lit(0)).cast("long").alias("seconds")
    )


def meeting_pull(spark: SparkSession, d: str) -> DataFrame:
    """Every meeting after the twenty longest waiting were pulled: leased, or missing and so offered again where no text of it is held; the others stay pending."""
    waiting = _meetings(spark, d).groupBy("meeting_id").agg(F.min("created_at").alias("held_at"))
    queue = waiting.select("meeting_id", "held_at", F.lit("pending").alias("status"), F.lit(NOW).cast("timestamp").alias("updated_at"))
    now = F.lit(NOW).cast("timestamp")
    held = read(spark, d, "transcript_turns").where("text IS NOT NULL").select("meeting_id").distinct()
    after = state.mark_missing(state.lease(queue, "meeting_id", [F.asc("held_at")], 20, now), "meeting_id", held, now)
    return after.select("meeting_id", "status", (F.col("status") == "missing").alias("offered"))


_M = "m AS (SELECT DISTINCT meeting_id, title, created_at, attendees FROM meetings)"
_NAMES = "list_transform(attendees, lambda a: coalesce(nullif(a.name, ''), nullif(a.email, ''), ''))"
SQL = {
    "meeting_listing": f"WITH {_M} SELECT meeting_id, coalesce(nullif(title, ''), 'Untitled meeting') AS title, substr(created_at, 1, 10) AS day, len(attendees) AS attendees, array_to_string({_NAMES}, ', ') AS names FROM m",
    "meeting_files": f"""WITH {_M}, s AS (SELECT meeting_id, substr(created_at, 1, 10) || '-' || coalesce(nullif({sql_slug("coalesce(nullif(title, ''), 'Untitled meeting')")}, ''), 'meeting') AS stem FROM m),
      n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY meeting_id) AS k FROM s)
      SELECT meeting_id, 'meeting-transcripts/' || stem || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS rel_path FROM n""",
    "meeting_sync_diff": """WITH f AS (SELECT meeting_id, count(*) AS segments, min(received_at) AS began FROM transcript_turns GROUP BY 1),
      l AS (SELECT meeting_id, count(*) AS late FROM transcript_turns JOIN f USING (meeting_id) WHERE date_diff('second', date_trunc('second', began), date_trunc('second', received_at)) > 43200 GROUP BY 1)
      SELECT meeting_id, CASE WHEN segments IS NULL THEN 'not_returned' ELSE 'synced' END AS status, coalesce(segments, 0) AS segments, coalesce(late, 0) AS late
      FROM (SELECT DISTINCT meeting_id FROM meetings) LEFT JOIN f USING (meeting_id) LEFT JOIN l USING (meeting_id)""",
    "transcript_markdown": r"""SELECT meeting_id, seg_id, coalesce(nullif(trim(speaker), ''), 'Unknown') || ': ' || trim(regexp_replace(text, '[\r\n\t ]+', ' ', 'g')) AS line
      FROM transcript_turns WHERE text IS NOT NULL""",
    "meeting_pull": """WITH m AS (SELECT meeting_id, row_number() OVER (ORDER BY min(created_at) NULLS FIRST, meeting_id) AS n FROM meetings GROUP BY meeting_id),
      s AS (SELECT meeting_id, CASE WHEN n > 20 THEN 'pending' WHEN meeting_id IN (SELECT meeting_id FROM transcript_turns WHERE text IS NOT NULL) THEN 'leased' ELSE 'missing' END AS status FROM m)
      SELECT meeting_id, status, status = 'missing' AS offered FROM s""",
    "speaker_labels": f"""SELECT meeting_id, label, count(*) AS segments, coalesce(max(at_second) - min(at_second), 0)::BIGINT AS seconds
      FROM (SELECT meeting_id, {sql_slug('speaker')} AS label, at_second FROM transcript_turns WHERE speaker IS NOT NULL) WHERE label <> '' GROUP BY ALL""",
}


def queries() -> dict:
    named = [meeting_listing, meeting_files, meeting_sync_diff, transcript_markdown, speaker_labels, meeting_pull]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
