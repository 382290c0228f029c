"""Markdown documents as columns: front matter, metadata lines, titles, dates, links, facts, folders.

Every function is a built-in Spark expression over the columns it is given.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.dates import first_day
from corvane.functions.text import let, slug, strip_space

# Fixed patterns: how the notes write line ends, front matter, metadata lines, links and facts.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FRONT = r"\A---\s*\n((?s).*?)\n---\s*\n"
ENTRY = r"(?m)^([^\s#-][^:\n]*):([^\n]*(?:\n\s*- [^\n]*)*)"
BOLD = r"^\s*\*\*([A-Za-zÀ-ÿ ]{2,30}):?\*\*\s*:?\s*(.+?)\s*$"
LINK = r"\[\[([^\]|#]+)(?:\|[^\]]*)?\]\]"
FACT = r"^\s*[-*]\s+(?:\[\[([^\]|#]+)(?:\|[^\]]*)?\]\]\s+)?([A-Za-z][\w-]*)::\s*(.+?)\s*$"
SINCE = r"\bsince:\s*([0-9]{4}(?:-[0-9]{2})?(?:-[0-9]{2})?)"
UNTIL = r"\buntil:\s*([0-9]{4}(?:-[0-9]{2})?(?:-[0-9]{2})?)"

# Predicates that hold one value at a time.
FUNCTIONAL = ("role", "employer", "owner", "status", "location", "stage", "instrument", "branch", "lead", "phase", "tier")

# Keys of metadata lines and the field that each stands for.
META_KEYS = {
    "date": "date", "fecha": "date", "last updated": "date", "prepared": "date", "owner": "owner", "prepared by": "owner", "author": "owner",
    "status": "status", "estado": "status", "participants": "participants", "participantes": "participants", "attendees": "participants",
    "meeting participants": "participants", "type": "type", "tipo": "type", "format": "type", "source": "source", "purpose": "purpose",
    "audience": "audience", "stage": "stage", "subject": "subject",
}

# English and Spanish month names.
MONTHS = {
    "jan": 1, "january": 1, "ene": 1, "enero": 1, "feb": 2, "february": 2, "febrero": 2, "mar": 3, "march": 3, "marzo": 3,
    "apr": 4, "april": 4, "abr": 4, "abril": 4, "may": 5, "mayo": 5, "jun": 6, "june": 6, "junio": 6, "jul": 7, "july": 7, "julio": 7,
    "aug": 8, "august": 8, "ago": 8, "agosto": 8, "sep": 9, "sept": 9, "september": 9, "septiembre": 9, "oct": 10, "october": 10, "octubre": 10,
    "nov": 11, "november": 11, "noviembre": 11, "dec": 12, "december": 12, "dic": 12, "diciembre": 12,
}
_MONTH = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
# Fixed patterns: dates in texts.
ISO_DATE = r"(?<!\d)(20\d{2})[-_/](\d{1,2})[-_/](\d{1,2})(?!\d)"
DAY_MONTH = rf"(?i)(?<!\d)(\d{{1,2}})[-_ ]({_MONTH})[a-z]*[-_ ,]+(20\d{{2}})"
MONTH_DAY = rf"(?i)\b({_MONTH})[a-z]*[-_ ]+(\d{{1,2}})(?:st|nd|rd|th)?[-_ ,]+(20\d{{2}})"
MONTH_ONLY = rf"(?i)\b({_MONTH})[a-z]*[-_ ]+(20\d{{2}})\b"


def lines(text: Column) -> Column:
    """The lines of a text, without a last empty one."""
    return let(F.split(text, LINE_BREAK), lambda found: F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found))


def body(text: Column) -> Column:
    """The text without its front matter."""
    return F.regexp_replace(text, FRONT, "")


def without_code(text: Column) -> Column:
    """The text without fenced code."""
    return F.regexp_replace(text, "(?s)```.*?```", "")


def _unquoted(value: Column) -> Column:
    return F.btrim(value, F.lit("\"'"))


def front_matter(text: Column) -> Column:
    """Front matter as array<struct<field, values>>: ``k: v``, ``k: [a, b]`` and ``- item`` lines below a key."""
    block = F.regexp_extract(F.when(text.startswith("---"), F.regexp_replace(text, "\r\n", "\n")).otherwise(""), FRONT, 1)

    def entry(key: Column, value: Column) -> Column:
        first = strip_space(F.substring_index(value, "\n", 1))
        inline = F.filter(
            F.transform(F.split(F.regexp_replace(first, r"^\[|\]$", ""), ","), lambda p: _unquoted(strip_space(p))), lambda p: p != ""
        )
        below = F.transform(F.regexp_extract_all(value, F.lit(r"\n\s*- ([^\n]*)"), F.lit(1)), lambda p: _unquoted(strip_space(p)))
        listed = F.when(F.size(below) > 0, below).when(first.rlike(r"^\[.*\]$"), inline).otherwise(F.array(_unquoted(first)))
        return F.struct(strip_space(key).alias("field"), listed.alias("values"))

    return let(block, lambda b: F.zip_with(F.regexp_extract_all(b, F.lit(ENTRY), F.lit(1)), F.regexp_extract_all(b, F.lit(ENTRY), F.lit(2)), entry))


def field(text: Column, name: str) -> Column:
    """Values of one front matter field; null if it isn't there."""
    found = F.filter(front_matter(text), lambda e: e["field"] == name)
    return let(found, lambda hits: F.when(F.size(hits) > 0, F.element_at(hits, -1)["values"]))


def bold_fields(text: Column) -> Column:
    """Metadata lines (``**Owner:** …``) among the first 14 lines of the body, as array<struct<field, value>>; the first of a field wins."""
    known = F.create_map(*[F.lit(x) for pair in META_KEYS.items() for x in pair])
    candidates = F.filter(F.slice(lines(body(text)), 1, 14), lambda x: ~x.startswith("#") & x.rlike(BOLD))
    named = F.transform(
        candidates,
        lambda x: F.struct(
            F.try_element_at(known, F.rtrim(F.lower(strip_space(F.regexp_extract(x, BOLD, 1))), F.lit(":"))).alias("field"),
            strip_space(F.replace(F.regexp_extract(x, BOLD, 2), F.lit("**"), F.lit(""))).alias("value"),
        ),
    )
    kept = F.filter(named, lambda e: e["field"].isNotNull())
    names = F.transform(kept, lambda e: e["field"])
    return F.filter(kept, lambda e, i: F.array_position(names, e["field"]) == i + 1)


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def title(text: Column, path: Column) -> Column:
    """First ``# `` line of the body, else the file's stem."""
    first = F.try_element_at(F.filter(lines(body(text)), lambda x: x.startswith("# ")), F.lit(1))
    return F.coalesce(strip_space(F.substring(first, 3, 1_000_000)), stem(path))


def parse_date(as_of: Column, *candidates: Column) -> Column:
    """First date that one of the texts holds: ISO, day month year, month day year, or month and year (day 1).

    Of each kind the first in the text counts; one after ``as_of`` or of no real day passes on to the next kind.
    """
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def month(name: Column) -> Column:
        return F.try_element_at(months, F.lower(name)).cast("string")

    def day(y: Column, m: Column, d: Column) -> Column:
        date = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        return let(date, lambda v: F.when(v <= as_of, v))

    def dated(x: Column, pattern: str, year: int, name: int, number: int | None) -> Column:
        def read(hit: Column) -> Column:
            m = F.regexp_extract(hit, pattern, name)
            return F.when(hit != "", day(F.regexp_extract(hit, pattern, year), m if pattern is ISO_DATE else month(m), F.regexp_extract(hit, pattern, number) if number else F.lit("1")))

        return let(F.regexp_extract(x, pattern, 0), read)

    found = []
    for x in candidates:
        found += [dated(x, ISO_DATE, 1, 2, 3), dated(x, DAY_MONTH, 3, 2, 1), dated(x, MONTH_DAY, 3, 1, 2), dated(x, MONTH_ONLY, 2, 1, None)]
    return F.coalesce(*found)


def document_date(text: Column, path: Column, mtime: Column, as_of: Column) -> Column:
    """Date of a document: named in its metadata or file name, else in its first 1,200 characters if less than 900 days older than
    the file, else the file's day."""
    bold = F.filter(bold_fields(text), lambda e: e["field"] == "date")
    named = F.coalesce(F.nullif(F.array_join(field(text, "date"), ","), F.lit("")), F.try_element_at(bold, F.lit(1))["value"])
    modified = F.to_date(F.timestamp_seconds(mtime))
    scanned = let(F.substring(body(text), 1, 1200), lambda head: parse_date(as_of, head))
    trusted = let(scanned, lambda day: F.when(F.datediff(modified, day) < 900, day))
    return F.coalesce(let(named, lambda n: parse_date(as_of, n)), parse_date(as_of, F.substring_index(path, "/", -1)), trusted, modified)


def links(text: Column) -> Column:
    """Slugs of the wiki-links outside fenced code, distinct and sorted."""
    targets = F.regexp_extract_all(without_code(body(text)), F.lit(LINK), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(targets, slug), lambda s: s != "")))


def facts(text: Column) -> Column:
    """Facts (``- [[subject]] predicate:: value since:… until:…``) as array<struct>; lines count in the body without fenced code."""
    rows = F.transform(lines(without_code(body(text))), lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text")))

    def fact(r: Column) -> Column:
        rest, predicate = F.regexp_extract(r["text"], FACT, 3), F.lower(F.regexp_extract(r["text"], FACT, 2))
        bare = F.regexp_replace(F.regexp_replace(rest, UNTIL, ""), SINCE, "")
        return F.struct(
            r["line"].alias("line"), slug(F.regexp_extract(r["text"], FACT, 1)).alias("subject"), predicate.alias("predicate"),
            F.btrim(bare, F.lit(" .;·")).alias("value"),
            F.nullif(F.regexp_extract(rest, SINCE, 1), F.lit("")).alias("since"), F.nullif(F.regexp_extract(rest, UNTIL, 1), F.lit("")).alias("until"),
            predicate.isin(*FUNCTIONAL).alias("functional"),
        )

    return F.transform(F.filter(rows, lambda r: r["text"].rlike(FACT)), fact)


def superseded_by(text: Column) -> Column:
    """The document named as successor, ``self`` where only the status says so, else null."""
    status = F.lower(F.array_join(field(text, "status"), ","))
    return F.coalesce(F.nullif(F.array_join(field(text, "superseded_by"), ","), F.lit("")), F.when(status == "superseded", F.lit("self")))


def aliases(text: Column, path: Column) -> Column:
    """Names of a document: slugs of title, file stem and listed aliases, longer than one character, sorted."""
    listed = F.coalesce(field(text, "aliases"), F.array().cast("array<string>"))
    name = F.coalesce(field(text, "name"), F.array().cast("array<string>"))
    every = F.concat(F.array(title(text, path), stem(path)), listed, name)
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, slug), lambda s: F.length(s) > 1)))


def folders(path: Column, depth: int = 3) -> Column:
    """The first folders of a path, as prefixes of one to ``depth`` segments."""
    parts = F.split(path, "/")
    n = F.least(F.lit(depth), F.size(parts) - 1)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(n > 0, prefixes).otherwise(F.array().cast("array<string>"))


def area(source: Column, path: Column, root: str = "root") -> Column:
    """Source and first folder, ``root`` for files at the top."""
    return F.concat_ws("/", source, F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(root))


def freshness(day: Column, as_of: Column) -> Column:
    """1 for today, a half after 1825 days; 0.3 without a date."""
    age = F.when(day.isNotNull(), F.greatest(F.lit(0), F.datediff(as_of, day)))
    return F.coalesce(1 / (1 + age / 1825.0), F.lit(0.3))


def quality(path: Column, title: Column, weight: Column) -> Column:
    """The source's weight, 0.15 for templates, placeholders and test files."""
    marked = F.lower(F.concat_ws(" ", path, title)).rlike("template|placeholder|testfile|test-file")
    return F.when(marked, F.lit(0.15)).otherwise(weight)


def months_since(partial: Column, as_of: Column) -> Column:
    """Whole months by the calendar since a partial date; null if it is none."""
    start = first_day(partial)
    return (F.year(as_of) - F.year(start)) * 12 + F.month(as_of) - F.month(start)
