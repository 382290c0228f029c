"""Cutting markdown documents at headings and packing the sections' lines to a size in words.

A chunk is a range of the document's words. Headings hold none, so the words of all sections form one array, and lines are places in it: the
running sum of their word counts. Cuts are found by binary search in these sums, an overlap is a start further back, and a short end moves the end
of the range before. Every document is cut by itself, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed patterns of the markdown that is read.
FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*\n", re.S)
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")

PATH_SEPARATOR, NO_HEADING = " › ", "Document"


@dataclass
class Range:
    """Words ``first`` to ``last`` (excluded) of a document, under ``path``, from ``line`` on."""

    path: str
    line: int
    first: int
    last: int


class Outline:
    """Lines of a document: the words so far after each (``upto``), where a cut may be made (``open_at``), and its sections."""

    def __init__(self, text: str, true_lines: bool) -> None:
        front = FRONT.match(text)
        body = text[front.end() :] if front else text
        self.shift = 1 + (text.count("\n", 0, front.end()) if front and true_lines else 0)
        lines = body.splitlines()
        titles = [HEADING.match(line) for line in lines]
        parts = [[] if title else line.split() for line, title in zip(lines, titles)]
        self.words = [word for part in parts for word in part]
        self.upto = list(accumulate(map(len, parts)))
        # The next line at or after each that is no table row; table rows are never parted from what stands before them.
        self.open_at = list(range(len(lines) + 1))
        for k in reversed(range(len(lines))):
            if lines[k].lstrip().startswith("|"):
                self.open_at[k] = self.open_at[k + 1]
        self.sections: list[tuple[str, int, int]] = []
        path: tuple[str, ...] = ()
        begin = 0
        for k, title in [*((k, t) for k, t in enumerate(titles) if t), (len(lines), None)]:
            if k > begin:
                self.sections.append((PATH_SEPARATOR.join(path) or NO_HEADING, begin, k))
            if title:
                # Below a skipped level the path has no hole.
                path = (*path[: len(title[1]) - 1], title[2].rstrip("#").strip())
            begin = k + 1

    def before(self, line: int) -> int:
        return self.upto[line - 1] if line else 0

    def cuts(self, begin: int, end: int, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
        """(first line, first word, last word) of each range within the lines ``begin`` to ``end``."""
        line, first = begin, self.before(begin)
        while True:
            # The line by which the range grows too long, but not the one that it begins with.
            over = bisect_right(self.upto, first + limit, line, end)
            started = max(line, bisect_right(self.upto, first, begin, end)) + 1
            at = self.open_at[min(max(over, started), end)]
            if at >= end:
                yield line, first, self.before(end)
                return
            yield line, first, self.before(at)
            first = max(first, self.before(at) - overlap)
            line = at


def ranges(outline: Outline, limit: int, overlap: int, least: int) -> list[Range]:
    """Ranges of all sections. A section's end of fewer than ``least`` words belongs to the range before, also under another heading."""
    out: list[Range] = []
    for path, begin, end in outline.sections:
        found = list(outline.cuts(begin, end, limit, overlap))
        for k, (line, first, last) in enumerate(found):
            if k + 1 == len(found) and last - first < least and out:
                out[-1].last = max(out[-1].last, last)
            elif last > first:
                out.append(Range(path, outline.shift + line, first, last))
    return out


def packed(text: str, limit: int, overlap: int, least: int, true_lines: bool = True) -> list[tuple[str, int, str]]:
    """(heading path, line, text) of each chunk."""
    outline = Outline(text, true_lines)
    return [(r.path, r.line, " ".join(outline.words[r.first : r.last])) for r in ranges(outline, limit, overlap, least)]


def heading_chunks(docs: DataFrame, limit: int = 240, overlap: int = 36, least: int = 18, true_lines: bool = True) -> DataFrame:
    """Chunks of every document: (``doc_id``, ``ordinal``, ``heading_path``, ``line_start``, ``text``).

    ``docs`` needs ``doc_id, text``. Null and empty texts give no rows. Lines count in the whole file, or in the part after the front
    matter with ``true_lines=False``. A single line longer than the limit stays whole.
    """
    rows = docs.where("text IS NOT NULL").select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, n, *chunk) for k, text in enumerate(batch.column("text").to_pylist()) for n, chunk in enumerate(packed(text, limit, overlap, least, true_lines))]
            at, ordinal, path, line, text = zip(*found) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(ordinal, pa.int32()), pa.array(path, pa.string()), pa.array(line, pa.int32()), pa.array(text, pa.string())],
                ["doc_id", "ordinal", "heading_path", "line_start", "text"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, ordinal int, heading_path string, line_start int, text string")
