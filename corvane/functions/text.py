"""Text expressions: white space, slugs, query terms. All of them are built-in Spark expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as Unicode white space.
SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

# English and Spanish stop words dropped from questions.
STOP_WORDS = (
    "a an and are as at be but by for from has have if in into is it its of on or that the their then there these this to was were "
    "what when where which who why will with your you we our not no do does did can could should would may might must than them "
    "they i he she his her de la el los las un una y en por para con del al que es se su sus como mas más"
).split()

# Letters with marks in the Latin blocks, and what remains without the mark.
_MARKED = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip_space(value: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(value, F.lit(_SPACE_CHARS))


def slug(value: Column) -> Column:
    """Normal form of a name: lower case, letters, digits and hyphens only. ``--`` inside is kept.

    Null stays null. A value without letters or digits gives ''.
    """
    kept = F.regexp_replace(F.lower(strip_space(value)), rf"[^\p{{L}}\p{{N}}_{SPACE}-]", "")
    dashed = F.regexp_replace(kept, f"[{SPACE}_]+", "-")
    return F.btrim(dashed, F.lit("-"))


def words(value: Column) -> Column:
    """The runs of characters other than white space, in order."""
    return F.filter(F.split(value, f"[{SPACE}]+"), lambda w: w != "")


def word_count(value: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.size(words(value)), F.lit(0))


def query_terms(question: Column) -> Column:
    """Search terms of a question: lower case, longer than one character, without stop words.

    If no term survives, all tokens are kept. Repeated terms stay repeated.
    """
    tokens = F.transform(F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}_'’-]+"), F.lit(0)), F.lower)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(tokens, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def fold_accents(value: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(value, "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED))


def index_tokens(value: Column) -> Column:
    """Tokens of an indexed text: runs of letters and digits, lower case, without accents. Null gives an empty array."""
    tokens = F.regexp_extract_all(fold_accents(F.lower(value)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.coalesce(tokens, F.array().cast("array<string>"))


def shingles(tokens: Column, n: int) -> Column:
    """All runs of n adjacent tokens, joined by a space."""
    if n == 1:
        return tokens
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))
