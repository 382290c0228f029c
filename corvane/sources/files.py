"""Folders of markdown files: registry of sources, scan, reading, notes, stale files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import markdown as M

# Folders that are never read.
EXCLUDED = (".git", ".obsidian", ".venv", "node_modules", "__pycache__", "dist", "build")


@dataclass(frozen=True)
class Source:
    """A folder of notes. ``exclude`` names folders anywhere below it that are passed over."""

    name: str
    root: str
    weight: float = 0.8
    enrich: bool = True
    exclude: tuple[str, ...] = field(default=EXCLUDED)


def load_sources(path: str | Path, project: str | Path) -> list[Source]:
    """Sources of a registry file; relative roots are below the project. Without the file the project itself is the only one."""
    file = Path(path)
    if not file.exists():
        return [Source("notes", str(Path(project).resolve()), 1.0)]
    rows = json.loads(file.read_text())
    rows = rows.get("sources", rows) if isinstance(rows, dict) else rows
    return [
        Source(r["name"], str((Path(project) / r["root"]).resolve()), float(r.get("weight", 0.8)), bool(r.get("enrich", True)), tuple(r.get("exclude", EXCLUDED)))
        for r in rows
    ]


def save_sources(sources: list[Source], path: str | Path, project: str | Path) -> None:
    """Write a registry; roots below the project are kept relative to it."""
    base = Path(project).resolve()
    rows = []
    for s in sources:
        root = Path(s.root).resolve()
        rows.append(asdict(replace(s, root=str(root.relative_to(base)) if root.is_relative_to(base) else str(root))))
    Path(path).write_text(json.dumps({"sources": rows}, indent=2))


def add_source(sources: list[Source], source: Source) -> list[Source]:
    """The registry with one more; its root must be a folder and its name new."""
    if not Path(source.root).is_dir():
        raise ValueError(f"not a folder: {source.root}")
    if any(s.name == source.name for s in sources):
        raise ValueError(f"there is a source called {source.name}")
    return [*sources, source]


def scan(spark: SparkSession, source: Source) -> DataFrame:
    """Markdown files below a source: (``source``, ``rel_path``, ``text``, ``mtime``). Bytes that aren't UTF-8 are replaced."""
    root = Path(source.root).resolve().as_uri()
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(source.root)
        .select(F.col("path"), F.col("content"), F.col("modificationTime"))
    )
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    rel = F.substring(path, len(root.removeprefix("file://")) + 2, 100_000)
    folders = F.slice(F.split("rel_path", "/"), 1, F.greatest(F.size(F.split("rel_path", "/")) - 1, F.lit(0)))
    excluded = F.array(*[F.lit(x) for x in source.exclude]).cast("array<string>")
    text = F.call_function("try_validate_utf8", F.col("content").cast("string"))
    return (
        files.select(F.lit(source.name).alias("source"), rel.alias("rel_path"), F.coalesce(text, F.call_function("make_valid_utf8", F.col("content").cast("string"))).alias("text"), F.unix_micros("modificationTime").alias("us"))
        .where(~F.arrays_overlap(folders, excluded))
        .select("source", "rel_path", "text", (F.col("us") / 1e6).alias("mtime"))
    )


def read_documents(files: DataFrame, as_of: Column) -> DataFrame:
    """Documents of scanned files with all that their markdown says about them."""
    text, path = F.col("text"), F.col("rel_path")
    return files.select(
        "source", "rel_path", M.title(text, path).alias("title"), F.sha2("text", 256).alias("sha"), "mtime",
        M.document_date(text, path, F.col("mtime"), as_of).alias("doc_date"), M.front_matter(text).alias("front_matter"), M.bold_fields(text).alias("bold_fields"),
        M.aliases(text, path).alias("aliases"), M.links(text).alias("links"), M.superseded_by(text).alias("superseded_by"), M.facts(text).alias("facts"), "text",
    )


def stale(files: DataFrame, marker: Column) -> DataFrame:
    """Files changed after the marker's time (epoch seconds)."""
    return files.where(F.col("mtime") > marker).select("source", "rel_path", "mtime")


def notes(rows: DataFrame, day: str, folder: str = "notes") -> DataFrame:
    """Notes to be written: (``rel_path``, ``text``) of ``note_id, title, text`` and optional ``facts`` (array of ``predicate:: value``).

    The file is named after day and title; later ones of the same name are numbered by note_id. The folder must be relative and without ``..``.
    """
    if not folder.strip() or folder.startswith("/") or ".." in folder.split("/"):
        raise ValueError("the folder must be a relative path inside the collection")
    from pyspark.sql import Window

    from corvane.functions.text import slug

    facts = F.col("facts") if "facts" in rows.columns else F.array().cast("array<string>")
    bad = F.exists(F.coalesce(facts, F.array().cast("array<string>")), lambda f: ~f.rlike(r"^\s*(?:[^|]+\|)?\s*[A-Za-z][\w-]*::\s*\S"))
    lines = F.transform(
        F.coalesce(facts, F.array().cast("array<string>")),
        lambda f: F.when(F.instr(f, "|") > 0, F.concat(F.lit("- [["), F.trim(F.substring_index(f, "|", 1)), F.lit("]] "), F.trim(F.substring_index(f, "|", -1)))).otherwise(F.concat(F.lit("- "), F.trim(f))),
    )
    text = F.concat_ws(
        "\n", F.lit(f"---\ndate: {day}\n---\n"), F.concat(F.lit("# "), F.left("title", F.lit(100))), F.lit(""), F.col("text"),
        F.when(F.size(lines) > 0, F.concat(F.lit("\n## Facts\n\n"), F.array_join(lines, "\n"))),
    )
    stem = F.concat_ws("-", F.lit(day), F.coalesce(F.nullif(slug(F.col("title")), F.lit("")), F.lit("note")))
    numbered = rows.select("note_id", stem.alias("stem"), F.when(bad, F.raise_error(F.lit("a fact must read predicate:: value or subject|predicate:: value"))).otherwise(text).alias("text"))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("note_id"))
    return numbered.select(F.concat(F.lit(f"{folder}/"), "stem", F.when(n > 1, F.concat(F.lit("-"), n)).otherwise(""), F.lit(".md")).alias("rel_path"), "text")
