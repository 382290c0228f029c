"""Queries that read markdown: metadata, links, facts, dates, names, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import markdown as M
from corvane.functions.text import query_terms, slug, word_count
from corvane.operators.sections import heading_chunks as chunk_sections
from corvane.plans.base import AS_OF, SPACE, read, sql_body, sql_links, sql_slug, sql_strip, today


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """Front matter of all documents, a row for each value."""
    fields = _docs(spark, d).select("doc_id", F.explode(M.front_matter(F.col("text"))).alias("e"))
    return fields.select("doc_id", F.col("e.field").alias("field"), F.posexplode("e.values").alias("place", "value"))


def bold_meta(spark: SparkSession, d: str) -> DataFrame:
    """Metadata lines at the head of documents."""
    return _docs(spark, d).select("doc_id", F.inline(M.bold_fields(F.col("text"))))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """Title read from each document, and its slug."""
    named = _docs(spark, d).where("text IS NOT NULL").select("doc_id", M.title(F.col("text"), F.col("rel_path")).alias("title"))
    return named.withColumn("slug", slug(F.col("title")))


def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """Date of each document by its metadata, file name, text or file time."""
    return _docs(spark, d).where("text IS NOT NULL").select(
        "doc_id", M.document_date(F.col("text"), F.col("rel_path"), F.col("mtime"), today()).alias("day")
    )


def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """Slugs to which each document links."""
    return _docs(spark, d).select("doc_id", F.explode(M.links(F.col("text"))).alias("target"))


def assertions_extract(spark: SparkSession, d: str) -> DataFrame:
    """Facts written in documents; a fact without a subject is about its document."""
    rows = _docs(spark, d).select("doc_id", "rel_path", "text", F.inline(M.facts(F.col("text"))))
    subject = F.when(F.col("subject") == "", slug(M.title(F.col("text"), F.col("rel_path")))).otherwise(F.col("subject"))
    return rows.select("doc_id", "line", subject.alias("subject"), "predicate", "value", "since", "until", "functional")


def superseded_status(spark: SparkSession, d: str) -> DataFrame:
    """Successors that documents name in their metadata."""
    return _docs(spark, d).select("doc_id", M.superseded_by(F.col("text")).alias("successor")).where("successor IS NOT NULL")


def document_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names under which each document can be linked."""
    return _docs(spark, d).where("text IS NOT NULL").select("doc_id", F.explode(M.aliases(F.col("text"), F.col("rel_path"))).alias("alias"))


def topic_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Folder topics of each document."""
    return _docs(spark, d).select("doc_id", F.explode(M.folders(F.col("rel_path"))).alias("prefix")).join(
        _docs(spark, d).select("doc_id", "source"), "doc_id"
    ).select("doc_id", F.concat_ws(":", F.lit("t"), "source", "prefix").alias("topic"))


def query_words(spark: SparkSession, d: str) -> DataFrame:
    """Search terms of all document titles, in order."""
    return _docs(spark, d).where("title IS NOT NULL").select("doc_id", F.posexplode(query_terms(F.col("title"))).alias("place", "term"))


def chunk_sha(spark: SparkSession, d: str) -> DataFrame:
    """Content key of each chunk from path, heading and text."""
    rows = read(spark, d, "chunks").where("text IS NOT NULL").dropDuplicates(["id"]).join(_docs(spark, d).select("doc_id", "rel_path"), "doc_id")
    key = F.concat_ws("\0", F.col("rel_path"), F.coalesce("heading_path", F.lit("Document")), F.col("text"))
    return rows.select("id", F.sha2(key, 256).alias("key"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 240 words with 36 words of overlap over each document."""
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    rows = _docs(spark, d).select("doc_id", words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 37), F.lit(204))
    return rows.select("doc_id", "words", F.posexplode(starts).alias("ordinal", "at")).select(
        "doc_id", "ordinal", F.size(F.slice("words", F.col("at") + 1, 240)).alias("words"),
        F.sha2(F.array_join(F.slice("words", F.col("at") + 1, 240), " "), 256).alias("sha"),
    )


def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into sections by heading and packed to 240 words."""
    return chunk_sections(_docs(spark, d))


def note_titles(spark: SparkSession, d: str) -> DataFrame:
    """A note's title: its first line with text, without marks, at most 100 characters."""
    first = F.try_element_at(F.filter(M.lines(F.col("text")), lambda x: F.trim(x) != ""), F.lit(1))
    return _docs(spark, d).select("doc_id", F.left(F.regexp_replace(first, r"^[#>\-*\s]+", ""), F.lit(100)).alias("note_title"), word_count(F.col("text")).alias("words")).where("note_title IS NOT NULL")


# DuckDB text of the same.
LINES = r"regexp_split_to_array({x}, '\r\n|[\n\r\x0B\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _lines(x: str) -> str:
    return LINES.format(x=x)


def _stem(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^.*/', ''), '(.)\.[^.]*$', '\1')"


def _title(x: str, path: str) -> str:
    return f"coalesce({sql_strip(f'''substr(list_filter({_lines(sql_body(x))}, lambda l: l LIKE '# %')[1], 3)''')}, {_stem(path)})"


_FRONT = r"regexp_extract(replace(text, chr(13) || chr(10), chr(10)), '\A---\s*\n(?s:(.*?))\n---\s*\n', 1)"
_ENTRY = r"(?m)^([^\s#-][^:\n]*):([^\n]*(?:\n\s*- [^\n]*)*)"
FRONT_ROWS = rf"""front AS (
  SELECT doc_id, {sql_strip('k')} AS field,
    CASE WHEN length(regexp_extract(v, '\n\s*- ', 0)) > 0
           THEN list_transform(regexp_extract_all(v, '\n\s*- ([^\n]*)', 1), lambda p: trim({sql_strip('p')}, '"'''))
         WHEN regexp_full_match({sql_strip('v')}, '\[.*\]')
           THEN list_filter(list_transform(string_split(regexp_replace({sql_strip('v')}, '^\[|\]$', '', 'g'), ','), lambda p: trim({sql_strip('p')}, '"''')), lambda p: p <> '')
         ELSE [trim({sql_strip('v')}, '"''')] END AS items
  FROM (SELECT doc_id, unnest(regexp_extract_all({_FRONT}, '{_ENTRY}', 1)) AS k, unnest(regexp_extract_all({_FRONT}, '{_ENTRY}', 2)) AS v FROM documents))"""
_KEYS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in M.META_KEYS.items()) + "}"
_MONTHS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in M.MONTHS.items()) + "}"
_BOLD = M.BOLD.replace("À-ÿ", "À-ÿ")
BOLD_ROWS = rf"""bold AS (
  SELECT doc_id, field, value FROM (
    SELECT doc_id, i, {_KEYS}[rtrim(lower({sql_strip(f"regexp_extract(l, '{_BOLD}', 1)")}), ':')] AS field,
      {sql_strip(f"replace(regexp_extract(l, '{_BOLD}', 2), '**', '')")} AS value
    FROM (SELECT doc_id, unnest(ls[1:14]) AS l, generate_subscripts(ls[1:14], 1) AS i FROM (SELECT doc_id, {_lines(sql_body('text'))} AS ls FROM documents WHERE text IS NOT NULL))
    WHERE NOT starts_with(l, '#') AND regexp_matches(l, '{_BOLD}'))
  WHERE field IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY i) = 1)"""


def _day(y: str, m: str, d: str) -> str:
    return f"CASE WHEN try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) <= DATE '{AS_OF}' THEN try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"


def _dates(x: str) -> str:
    iso = r"(?:^|[^0-9])(20[0-9]{2})[-_/]([0-9]{1,2})[-_/]([0-9]{1,2})(?:[^0-9]|$)"
    months = M.ISO_DATE and "|".join(sorted(M.MONTHS, key=lambda m: (-len(m), m)))
    dmy = rf"(?i)(?:^|[^0-9])([0-9]{{1,2}})[-_ ]({months})[a-z]*[-_ ,]+(20[0-9]{{2}})"
    mdy = rf"(?i)\b({months})[a-z]*[-_ ]+([0-9]{{1,2}})(?:st|nd|rd|th)?[-_ ,]+(20[0-9]{{2}})"
    my = rf"(?i)\b({months})[a-z]*[-_ ]+(20[0-9]{{2}})\b"
    part = lambda p, n: f"nullif(regexp_extract({x}, '{p}', {n}), '')"
    month = lambda p, n: f"cast({_MONTHS}[lower({part(p, n)})] AS VARCHAR)"
    return ", ".join([
        _day(part(iso, 1), part(iso, 2), part(iso, 3)), _day(part(dmy, 3), month(dmy, 2), part(dmy, 1)),
        _day(part(mdy, 3), month(mdy, 1), part(mdy, 2)), _day(part(my, 2), month(my, 1), "'1'"),
    ])


_FACT = M.FACT
_CODE = rf"regexp_replace({sql_body('text')}, '(?s)```.*?```', '', 'g')"
_REST = f"regexp_extract(l, '{_FACT}', 3)"

def _sections_sql() -> str:
    """Lines with running word counts, heading paths and cuts by recursion."""
    later = "list_filter(ls, lambda l: l.i > {line} AND l.b > {s} AND l.e > {s} + 240 AND NOT l.tab)[1] AS x"
    head = rf"'^(#{{1,6}})[{SPACE}]+([^\n]+?)[{SPACE}]*$'"
    return rf"""WITH RECURSIVE body AS (SELECT doc_id, {sql_body('text')} AS b, text FROM documents WHERE text IS NOT NULL),
      split AS (SELECT doc_id, length(text) - length(b) AS cut, substr(text, 1, length(text) - length(b)) AS front, {_lines('b')} AS ls FROM body),
      line AS (SELECT doc_id, length(front) - length(replace(front, chr(10), '')) AS skipped, unnest(ls) AS t, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, front, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM split)),
      told AS (SELECT *, regexp_matches(t, {head}) AS head FROM line),
      placed AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM told),
      title AS (SELECT doc_id, n, length(regexp_extract(t, {head}, 1)) AS level, {sql_strip(f"rtrim(regexp_extract(t, {head}, 2), '#')")} AS title FROM placed WHERE head),
      path AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, []::VARCHAR[] AS p FROM placed
        UNION ALL SELECT path.doc_id, title.n, list_append(p[1:level - 1], title) FROM path JOIN title ON title.doc_id = path.doc_id AND title.n = path.n + 1),
      word AS (SELECT doc_id, n, i, skipped, starts_with(ltrim(t), '|') AS tab, list_filter(regexp_split_to_array(t, '[{SPACE}]+'), lambda x: x <> '') AS ws FROM placed WHERE NOT head),
      sum AS (SELECT *, sum(len(ws)) OVER (PARTITION BY doc_id, n ORDER BY i) AS e FROM word),
      sec AS (SELECT doc_id, n, any_value(skipped) AS skipped, min(i) AS first, max(e) AS total, flatten(list(ws ORDER BY i)) AS ws, list({{'i': i, 'e': e, 'b': e - len(ws), 'tab': tab}} ORDER BY i) AS ls FROM sum GROUP BY doc_id, n),
      cut AS (SELECT doc_id, n, 0::HUGEINT AS s, first AS line, {later.format(line='first', s='0')}, ls, total FROM sec
        UNION ALL SELECT doc_id, n, ns, nl, {later.format(line='nl', s='ns')}, ls, total FROM (SELECT *, greatest(s, x.b - 36) AS ns, x.i AS nl FROM cut WHERE x IS NOT NULL)),
      piece AS (SELECT doc_id, n, line, s, coalesce(x.b, total) AS e, x IS NULL AS tail FROM cut WHERE coalesce(x.b, total) > s),
      own AS (SELECT *, e - s >= 18 OR NOT tail OR row_number() OVER (PARTITION BY doc_id ORDER BY n, line) = 1 AS kept FROM piece),
      grouped AS (SELECT own.*, count(*) FILTER (kept) OVER (PARTITION BY doc_id ORDER BY n, line) AS k, array_to_string(ws[s + 1:e], ' ') AS words, skipped FROM own JOIN sec USING (doc_id, n))
      SELECT doc_id, (k - 1)::INT AS ordinal, coalesce(nullif(arg_min(array_to_string(p, ' › '), (n, line)), ''), 'Document') AS heading_path,
        (min(line) FILTER (kept) + any_value(skipped))::INT AS line_start, string_agg(words, ' ' ORDER BY n, line) AS text
      FROM grouped JOIN path USING (doc_id, n) GROUP BY doc_id, k"""


SQL = {
    "heading_chunks": _sections_sql(),
    "frontmatter": f"WITH {FRONT_ROWS} SELECT doc_id, field, unnest(generate_series(0, len(items) - 1)) AS place, unnest(items) AS value FROM front WHERE len(items) > 0",
    "bold_meta": f"WITH {BOLD_ROWS} SELECT * FROM bold",
    "titles": f"SELECT doc_id, t AS title, {sql_slug('t')} AS slug FROM (SELECT doc_id, {_title('text', 'rel_path')} AS t FROM documents WHERE text IS NOT NULL)",
    "parse_dates": f"""WITH {FRONT_ROWS}, {BOLD_ROWS}, named AS (
        SELECT d.doc_id, coalesce((SELECT nullif(array_to_string(items, ','), '') FROM front f WHERE f.doc_id = d.doc_id AND field = 'date' LIMIT 1),
                 (SELECT value FROM bold b WHERE b.doc_id = d.doc_id AND field = 'date' LIMIT 1)) AS n,
               regexp_replace(rel_path, '^.*/', '') AS f, substr({sql_body('text')}, 1, 1200) AS b, cast(to_timestamp(mtime) AT TIME ZONE 'UTC' AS DATE) AS m
        FROM documents d WHERE text IS NOT NULL),
      got AS (SELECT doc_id, m, coalesce({_dates('n')}, {_dates('f')}) AS a, coalesce({_dates('b')}) AS s FROM named)
      SELECT doc_id, coalesce(a, CASE WHEN date_diff('day', s, m) < 900 THEN s END, m) AS day FROM got""",
    "wiki_links": f"SELECT doc_id, unnest({sql_links('text')}) AS target FROM documents",
    "assertions_extract": rf"""SELECT doc_id, cast(i AS INTEGER) AS line, CASE WHEN s = '' THEN {sql_slug(_title('text', 'rel_path'))} ELSE s END AS subject, predicate,
        trim(regexp_replace(regexp_replace(rest, '{M.UNTIL}', '', 'g'), '{M.SINCE}', '', 'g'), ' .;·') AS value,
        nullif(regexp_extract(rest, '{M.SINCE}', 1), '') AS since, nullif(regexp_extract(rest, '{M.UNTIL}', 1), '') AS until,
        predicate IN ({', '.join(f"'{f}'" for f in M.FUNCTIONAL)}) AS functional
      FROM (SELECT doc_id, rel_path, text, i, {sql_slug(f"regexp_extract(l, '{_FACT}', 1)")} AS s, lower(regexp_extract(l, '{_FACT}', 2)) AS predicate, {_REST} AS rest
        FROM (SELECT doc_id, rel_path, text, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, rel_path, text, {_lines(_CODE)} AS ls FROM documents WHERE text IS NOT NULL))
        WHERE regexp_matches(l, '{_FACT}'))""",
    "superseded_status": f"""WITH {FRONT_ROWS}, one AS (
        SELECT doc_id, max(CASE WHEN field = 'superseded_by' THEN array_to_string(items, ',') END) AS s, max(CASE WHEN field = 'status' THEN lower(array_to_string(items, ',')) END) AS st
        FROM front GROUP BY doc_id)
      SELECT doc_id, coalesce(nullif(s, ''), CASE WHEN st = 'superseded' THEN 'self' END) AS successor FROM one WHERE successor IS NOT NULL""",
    "document_aliases": f"""WITH {FRONT_ROWS}, every AS (
        SELECT doc_id, {sql_slug(_title('text', 'rel_path'))} AS alias FROM documents WHERE text IS NOT NULL
        UNION SELECT doc_id, {sql_slug(_stem('rel_path'))} FROM documents WHERE text IS NOT NULL
        UNION SELECT doc_id, {sql_slug('v')} FROM (SELECT doc_id, unnest(items) AS v FROM front WHERE field IN ('aliases', 'name')))
      SELECT doc_id, alias FROM every WHERE length(alias) > 1""",
    "topic_prefixes": """SELECT doc_id, 't:' || source || ':' || array_to_string(p[1:i], '/') AS topic
      FROM (SELECT doc_id, source, string_split(rel_path, '/') AS p, unnest([1, 2, 3]) AS i FROM documents) WHERE i < len(p)""",
    "query_words": rf"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(title, '[\p{{L}}\p{{N}}_''’-]+'), lambda w: lower(w)) AS all_w FROM documents WHERE title IS NOT NULL),
      k AS (SELECT doc_id, all_w, list_filter(all_w, lambda w: length(w) > 1 AND NOT list_contains([{', '.join(repr(w) for w in __import__('corvane.functions.text', fromlist=['x']).STOP_WORDS)}], w)) AS kept FROM t),
      c AS (SELECT doc_id, CASE WHEN len(kept) > 0 THEN kept ELSE all_w END AS w FROM k)
      SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS place, unnest(w) AS term FROM c WHERE len(w) > 0""",
    "chunk_sha": """SELECT DISTINCT c.id, sha256(rel_path || chr(0) || coalesce(heading_path, 'Document') || chr(0) || c.text) AS key
      FROM chunks c JOIN documents d USING (doc_id) WHERE c.text IS NOT NULL""",
    "chunk_windows": rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
      s AS (SELECT doc_id, ws, unnest(generate_series(0, greatest(0, len(ws) - 37), 204)) AS a FROM w WHERE len(ws) > 0)
      SELECT doc_id, cast(a / 204 AS INTEGER) AS ordinal, len(ws[a + 1:a + 240]) AS words, sha256(array_to_string(ws[a + 1:a + 240], ' ')) AS sha FROM s""",
    "note_titles": rf"""SELECT doc_id, left(regexp_replace(list_filter({_lines('text')}, lambda x: trim(x) <> '')[1], '^[#>\-*\s]+', ''), 100) AS note_title,
      len(list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '')) AS words FROM documents WHERE note_title IS NOT NULL""",
}


def queries() -> dict:
    named = [
        frontmatter, bold_meta, titles, parse_dates, wiki_links, assertions_extract, superseded_status, document_aliases, topic_prefixes, query_words,
        chunk_sha, chunk_windows, heading_chunks, note_titles,
    ]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
