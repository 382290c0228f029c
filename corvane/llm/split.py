"""Cutting oversized texts into pieces at natural boundaries, with an overlap between neighbours.

Each text gets a prefix array of token offsets and sorted arrays of boundaries (block ends, line ends, sentence ends),
counted in tokens. A token is a word, or a part of one that is very long. A piece ends at the last block end that a binary search finds under the limit; failing that at the
last line end, the last sentence end, or hard at the limit, if need be within a word. The next piece starts ``overlap`` tokens further back.
Every row is cut by itself, so the job has no shuffle besides the removal of rows given twice.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import word_count

LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
BULLET = re.compile(r" {0,3}(?:[-*+]|\d+\.)(?:\s|$)")
SENTENCE_END = re.compile(r"[.!?…][\"'”’)\]*_]*$")

TOKEN_CHARS = 100

PIECES = "array<struct<piece_no:int,line_start:long,words:int,text:string,block_lines:array<long>>>"


def blocks(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Blocks of a markdown text as (offset of the first line, number of that line from 0), and all line offsets."""
    found: list[tuple[int, int]] = []
    lines: list[int] = []
    kind, fence = "", ""
    for number, match in enumerate(LINE.finditer(text)):
        if match.start() == len(text) and number:
            break
        line = match[0].rstrip("\r\n")
        lines.append(match.start())
        if fence:
            closing = FENCE.fullmatch(line.rstrip())
            if closing and closing[1][0] == fence[0] and len(closing[1]) >= len(fence) and not closing[2].strip():
                kind, fence = "", ""
            continue
        if not line.strip():
            kind = ""
            continue
        opening = FENCE.fullmatch(line)
        if opening and not (opening[1][0] == "`" and "`" in opening[2]):
            found.append((match.start(), number))
            kind, fence = "fence", opening[1]
            continue
        bare = line.lstrip(" ") if len(line) - len(line.lstrip(" ")) < 4 else line
        if kind == "list" and (BULLET.match(line) or line[0] in " \t"):
            continue
        if bare[0] == "|":
            new = "table"
        elif bare[0] == ">":
            new = "quote"
        elif BULLET.match(line):
            new = "list"
        else:
            new = "paragraph"
        if new != kind:
            found.append((match.start(), number))
            kind = new
    return found, lines


def tokens(text: str) -> list[tuple[int, int]]:
    """Where the tokens of a text begin and end: its words, those of more than ``TOKEN_CHARS`` characters in parts of so many."""
    return [(a, min(a + TOKEN_CHARS, m.end())) for m in re.finditer(r"\S+", text) for a in range(m.start(), m.end(), TOKEN_CHARS)]


def cut(text: str, first_line: int | None, limit: int, overlap: int) -> list[dict]:
    """Pieces of one text, in order. ``first_line`` is the line number of the text's first line."""
    spans = tokens(text)
    starts, total = [a for a, _ in spans], len(spans)
    found, lines = blocks(text)
    block_at = [bisect_left(starts, offset) for offset, _ in found]
    line_at = sorted({bisect_left(starts, offset) for offset in lines})
    sentence_at = [k + 1 for k, (a, b) in enumerate(spans) if SENTENCE_END.search(text[a:b])]
    levels = (block_at + [total], line_at + [total], sentence_at + [total])
    pieces: list[dict] = []
    done = 0
    while done < total:
        begin = max(0, done - overlap) if pieces else 0
        most = min(total, begin + limit)
        end = most
        if most < total:
            for level in levels:
                k = bisect_right(level, most) - 1
                if k >= 0 and level[k] > done:
                    end = level[k]
                    break
        line = bisect_right(lines, starts[begin]) - 1
        here = found[bisect_left(block_at, done) : bisect_left(block_at, end)]
        whole_line = not text[lines[line] : starts[begin]].strip()
        pieces.append({
            "piece_no": len(pieces),
            "line_start": None if first_line is None else first_line + line,
            "words": len(text[starts[begin] : spans[end - 1][1]].split()),
            "text": text[lines[line] if whole_line else starts[begin] : spans[end - 1][1]],
            "block_lines": [] if first_line is None else [first_line + n for _, n in here],
        })
        done = end
    return pieces


def split_oversized(df: DataFrame, limit: int = 240, overlap: int = 36) -> DataFrame:
    """Pieces of every row whose ``text`` has more than ``limit`` words, or more than ``100 * limit`` characters.

    Needs the columns ``id``, ``heading_path``, ``line_start`` and ``text``; others are ignored. Result: ``chunk_id``,
    ``piece_no`` from 0, ``heading_path``, ``line_start`` (line of the document where the piece's text starts), ``words`` (at most
    ``limit``), ``text`` and ``block_lines`` (lines where a block starts in the piece, its overlap left out).
    Rows given twice (same id) count once, the smallest row in sort order; rows with a null id are told apart by
    their text. Null, empty and short texts give no rows, nor does an empty table. A null ``line_start`` gives null lines and no block lines. A
    single block longer than the limit is cut at line ends, then sentence ends, then hard. Of a word of more than 100 characters each
    100 count like a word and may be cut apart, so a piece has at most ``100 * limit`` characters between its words' white space, also where a text has no white space.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    @F.pandas_udf(PIECES)
    def pieces(text: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([cut(t, None if pd.isna(n) else int(n), limit, overlap) for t, n in zip(text, first)])

    long_ones = df.select("id", "heading_path", F.col("line_start").cast("long").alias("line_start"), "text").where(
        (F.length("text") > TOKEN_CHARS * limit) | (word_count(F.col("text")) > limit)
    )
    once = (
        long_ones.groupBy("id", F.when(F.col("id").isNull(), F.sha2("text", 256)).alias("nameless"))
        .agg(F.min(F.struct("line_start", "text", "heading_path")).alias("row"))
        .select("id", "row.*")
    )
    return once.select(
        F.col("id").alias("chunk_id"), "heading_path", F.inline(pieces("text", "line_start"))
    ).select("chunk_id", "piece_no", "heading_path", "line_start", "words", "text", "block_lines")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all oversized chunks."""
    return split_oversized(spark.read.parquet(f"{sf_dir}/chunks.parquet")).drop("block_lines")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the document where the blocks of oversized chunks start."""
    cuts = split_oversized(spark.read.parquet(f"{sf_dir}/chunks.parquet"))
    return cuts.select("chunk_id", F.explode("block_lines").alias("line_no"))


def queries() -> dict:
    return {"p3_found": p3_found, "p3_pieces": p3_pieces}


def oracle_sql() -> dict[str, str]:
    return {}
