"""Evaluation texts that appear in training documents.

The n-grams of the normalised evaluation items form a hash table that every task receives. Tasks scan the word windows of their
documents against it and verify the hits by comparing document and item word by word along their diagonals, and by chaining the
equal runs of neighbouring diagonals, which altered words of more or fewer tokens part. The documents are read once and never shuffled, passages
are removed in the same scan. The table holds one entry for each word of the items; should they exceed
``slice_words``, slices of them are taken one after the other, and only one is on the driver or broadcast at a time.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.lineage import cut

# Fixed patterns of markup that is no part of a text's words. All replacements keep the length.
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿*`~]+")
ENTITY = re.compile(r"&#?\w{1,31};")
BREAK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|tr|th|table|h[1-6]|hr)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
NOTE_MARK = re.compile(r"\[\^?\d{1,3}\]|\^\d{1,3}\b|[¹²³⁰-⁹†‡]+")
LINE_NUMBER = re.compile(r"(?:\n|\A)[ \t>]*\d{1,2}[.)][ \t]")
LINK_TARGET = re.compile(r"\]\([^()\s]*\)")
SOFT_BREAK = re.compile(r"(?<=[^\W\d_])-\r?\n(?=[^\W\d_])")
WORD = re.compile("[^\\W_](?:[^\\W_]|\x00)*")
# What stands between the tokens of one word: baker's, well-known, 1,000.
INNER = re.compile("['’‘ʼ‐‑.,:/_&-]\x00*")

LEAKS = ["item_id", "first_char", "last_char", "words", "altered"]


def _entity(match: re.Match) -> str:
    char = html.unescape(match[0])
    return (char if len(char) == 1 and char != "\xa0" else " ").ljust(len(match[0]), "\x00")


def bare(text: str) -> str:
    """The text with markup, note marks and invisible characters blanked out; every character keeps its place."""
    blank = lambda m: " " * len(m[0])
    void = lambda m: "\x00" * len(m[0])
    if "&" in text:
        text = ENTITY.sub(_entity, text)
    if "<" in text:
        text = TAG.sub(void, BREAK_TAG.sub(blank, text))
    if not text.isascii() or "[" in text or "^" in text:
        text = NOTE_MARK.sub(blank, text)
    if "](" in text:
        text = LINK_TARGET.sub(blank, text)
    if "-\n" in text or "-\r" in text:
        text = SOFT_BREAK.sub(void, text)
    text = LINE_NUMBER.sub(blank, text)
    return INVISIBLE.sub(void, text)


def normal(word: str) -> str:
    """Lower case, without accents and fillers."""
    word = word.replace("\x00", "").casefold()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    return [normal(w) for w in WORD.findall(bare(text))]


def inner(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for each token of a bare text that belongs to the word before it."""
    return np.array([int(k > 0 and INNER.fullmatch(text, spans[k - 1][1], a) is not None) for k, (a, _) in enumerate(spans)], dtype=np.int64)


LONGEST_OPENING = 100  # words; first sentences of more than 200 characters are none


def openings(items: DataFrame, shared_by: int = 3) -> DataFrame:
    """Items (``item_id, text``, distinct) with ``skip``: how many of their first words are a first sentence that ``shared_by`` different texts open with."""

    @F.pandas_udf("struct<opening:string,begins:array<string>>")
    def begun(texts: pd.Series) -> pd.DataFrame:
        firsts, begins = [], []
        for text in texts:
            first = re.match(r"\s*[^.:?!\n]{1,200}[.:?!\n]", text)
            firsts.append(" ".join(tokens(first[0])) if first else "")
            words = tokens(text)[:LONGEST_OPENING]
            begins.append([" ".join(words[: k + 1]) for k in range(len(words))])
        return pd.DataFrame({"opening": firsts, "begins": begins})

    heads = cut(items.withColumn("b", begun("text")).select("item_id", "text", "b.*"))
    stock = heads.where("opening <> ''").groupBy("opening").agg(F.countDistinct("text").alias("n")).where(F.col("n") >= shared_by).select(F.col("opening").alias("begin"))
    held = heads.select("item_id", "text", F.posexplode("begins").alias("place", "begin")).join(stock, "begin", "left_semi")
    skips = held.groupBy("item_id", "text").agg((F.max("place") + 1).alias("skip"))
    return items.join(skips, ["item_id", "text"], "left").select("item_id", "text", F.coalesce("skip", F.lit(0)).alias("skip"))


class ItemIndex:
    """Words of the items as numbers, and where each n-gram of words occurs in them. Items are told apart by their place in the list."""

    def __init__(self, items: list[tuple[int, str, int]], gram: int) -> None:
        self.gram, self.number, self.words, self.parts = gram, {}, {}, {}
        self.names = [item for item, _, _ in items]
        places = defaultdict(list)
        for nth, (_, text, skip) in enumerate(items):
            clean = bare(text)
            spans = [m.span() for m in WORD.finditer(clean)]
            found = [normal(clean[a:b]) for a, b in spans]
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in found[skip:]], dtype=np.int64)
            self.words[nth] = ids
            self.parts[nth] = np.cumsum(inner(clean, spans)[skip:])
            for at, key in enumerate(self.keys(ids)):
                places[int(key)].append((nth, at))
        self.places = dict(places)
        self.sorted_keys = np.array(sorted(self.places), dtype=np.uint64)

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """A hash of each window of ``gram`` numbers; equal hashes are verified later."""
        count = len(ids) - self.gram + 1
        if count <= 0:
            return np.zeros(0, dtype=np.uint64)
        unsigned = ids.astype(np.uint64)
        out = np.zeros(count, dtype=np.uint64)
        for k in range(self.gram):
            out = out * np.uint64(0x9E3779B97F4A7C15) + unsigned[k : k + count]
        return out

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Positions of windows that also occur in an item."""
        count = len(ids) - self.gram + 1
        if count <= 0 or not len(self.sorted_keys):
            return np.zeros(0, dtype=np.int64)
        known = ids > 0
        whole = known[:count].copy()
        for k in range(1, self.gram):
            whole &= known[k : k + count]
        at = np.flatnonzero(whole)
        if not len(at):
            return at
        keys = self.keys(ids)[at]
        place = np.searchsorted(self.sorted_keys, keys).clip(max=len(self.sorted_keys) - 1)
        return at[self.sorted_keys[place] == keys]


def passages(same: np.ndarray, run: int, window: int, one_in: int) -> list[tuple[int, int]]:
    """First and last positions of what the matches cover, apart from each other: ``run`` equal words, or ``window`` words with one in ``one_in`` altered. Altered words at the ends count but aren't covered."""
    cover = np.zeros(len(same) + 1, dtype=np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= run:
            cover[a] += 1
            cover[b] -= 1
    if len(same) >= window and len(edges):
        # A window holds if its equal words weigh up the altered ones: +1 and -(one_in - 1), in sum at least 0.
        sums = np.concatenate(([0], np.cumsum(np.where(same, 1, 1 - one_in))))
        highest = np.maximum.accumulate(sums[::-1])[::-1]
        starts = np.arange(len(same) - window + 1)
        ends = np.searchsorted(-highest, -sums[starts], side="right") - 1
        holds = ends - starts >= window
        equal = np.flatnonzero(same)
        np.add.at(cover, equal[np.searchsorted(equal, starts[holds])], 1)
        np.add.at(cover, equal[np.searchsorted(equal, ends[holds]) - 1] + 1, -1)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]


def best_window(same: np.ndarray, run: int, window: int, one_in: int) -> tuple[int, int] | None:
    """The longest of the passages."""
    return max(passages(same, run, window, one_in), key=lambda p: (p[1] - p[0], -p[0]), default=None)


def fewest_hits(run: int, window: int, one_in: int, gram: int) -> int:
    """Intact n-grams that a passage to be found has at least: each altered word costs itself and parts its neighbours."""
    loose = min(n - n // one_in - (n // one_in + 1) * (gram - 1) for n in range(window, window + 2 * one_in))
    return max(1, min(run - gram + 1, loose))


def chains(ids: np.ndarray, words: np.ndarray, shifts: tuple[int, int], parts: tuple[np.ndarray, np.ndarray], reach: int) -> list[list[tuple[int, int, int]]]:
    """Runs of equal words in sequence over the diagonals ``shifts``, as lists of (place in the document, its length, altered words before it).

    Between two runs as many words are altered as the document or the item has there, the greater number. ``parts`` counts, for the document
    and the item, the tokens so far that begin no word of their own. A run follows the one that leaves most equal words less altered ones.
    """
    runs = []
    for shift in range(shifts[0], shifts[1] + 1):
        begin, end = max(0, shift), min(len(ids), shift + len(words))
        if begin < end:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids[begin:end] == words[begin - shift : end - shift]).astype(np.int8), [0])))) + begin
            runs.extend(zip(edges[1::2].tolist(), edges[::2].tolist(), [shift] * (len(edges) // 2)))
    runs.sort()
    ours, theirs = parts[0].tolist(), parts[1].tolist()
    longest = shifts[1] - shifts[0]
    value, back = [0] * len(runs), [(-1, 0, 0)] * len(runs)
    for q, (end, start, shift) in enumerate(runs):
        best = None
        for p in range(q - 1, -1, -1):
            upto, _, before = runs[p]
            if upto < start - 4 * reach - longest:
                break
            at = max(start, upto, upto - before + shift)
            if at >= end:
                continue
            gap, other = at - upto, at - upto - shift + before
            if gap > 1:
                gap -= ours[at - 1] - ours[upto]
            if other > 1:
                other -= theirs[at - shift - 1] - theirs[upto - before]
            altered = max(gap, other)
            if altered <= reach and (best is None or value[p] - altered - at > best[0] - best[2]):
                best = (value[p] - altered, p, at, altered)
        value[q] = end - start
        if best:
            value[q] = end - best[2] + max(0, best[0])
            back[q] = best[1:]
    out, used = [], set()
    for q in sorted(range(len(runs)), key=lambda q: -value[q]):
        chain, fresh = [], 0
        while q >= 0:
            p, at, altered = back[q]
            at = at if p >= 0 else runs[q][1]
            fresh += 0 if q in used else runs[q][0] - at
            chain.append((q, at, runs[q][0] - at, altered))
            q = p
        if fresh >= 4:
            used.update(c[0] for c in chain)
            out.append([c[1:] for c in chain[::-1]])
    return out


def verified(
    ids: np.ndarray, index: ItemIndex, run: int, window: int, one_in: int, parts: Callable[[], np.ndarray] | None = None
) -> dict[int, list[tuple[int, int, int]]]:
    """Items that a document holds: item -> all passages, none inside another: (first word, last word, altered words).

    An altered word may be of more or fewer tokens than the item's, inserted or left out, so the runs of an item are chained over
    neighbouring diagonals. The shortest passage has fewer than ``2 * window`` words (else a half of it is one), so no more than
    ``2 * window // one_in`` altered words shift it. ``parts`` gives the flags of the document's tokens that belong to the word before.
    """
    hits = index.hits(ids)
    least = fewest_hits(run, window, one_in, index.gram)
    if len(hits) < least:
        return {}
    keys = index.keys(ids)[hits]
    diagonals: dict[int, Counter] = defaultdict(Counter)
    for at, key in zip(hits.tolist(), keys.tolist()):
        for item, place in index.places[key]:
            diagonals[item][at - place] += 1
    drift = (2 * window - 1) // one_in
    ours = None
    out: dict[int, list[tuple[int, int, int]]] = {}
    for item, counts in sorted(diagonals.items()):
        if counts.total() < least:
            continue
        words = index.words[item]
        found: list[tuple[int, int, int]] = []
        shifts = sorted(counts)
        bounds = [0, *(k for k in range(1, len(shifts)) if shifts[k] - shifts[k - 1] > drift), len(shifts)]
        for first, last in zip(bounds, bounds[1:]):
            group = shifts[first:last]
            if sum(counts[s] for s in group) < least:
                continue
            whole = False
            for shift in group:
                if counts[shift] >= least:
                    begin, end = max(0, shift), min(len(ids), shift + len(words))
                    same = ids[begin:end] == words[begin - shift : end - shift]
                    for a, b in passages(same, run, window, one_in):
                        found.append((begin + a, begin + b, int((~same[a : b + 1]).sum())))
                        whole |= b - a + 1 == len(words)
            if whole:
                continue
            if ours is None:
                flags = parts() if parts else np.zeros(len(ids), dtype=np.int64)
                ours = np.cumsum(flags)
            for chain in chains(ids, words, (group[0] - drift, group[-1] + drift), (ours, index.parts[item]), max(drift, len(words) // (one_in - 1))):
                # Altered words before the first and after the last run, as far as the document goes.
                chain = [(chain[0][0], chain[0][1], min(drift, chain[0][0])), *chain[1:], (len(ids), 0, min(drift, len(ids) - sum(chain[-1][:2])))]
                same = np.concatenate([np.repeat([False, True], [altered, n]) for _, n, altered in chain])
                place = np.concatenate([np.arange(at - altered, at + n) for at, n, altered in chain])
                found += [(int(place[a]), int(place[b]), int((~same[a : b + 1]).sum())) for a, b in passages(same, run, window, one_in)]
        for a, b, altered in sorted(found, key=lambda f: (f[0], -f[1], f[2])):
            if item not in out or b > out[item][-1][1]:
                out.setdefault(item, []).append((a, b, altered))
    return out


@dataclass(frozen=True)
class Measure:
    """What counts as material of an item: ``run`` equal words, or ``window`` words with one in ``one_in`` altered; found by n-grams of ``gram`` words."""

    run: int = 15
    window: int = 24
    one_in: int = 7
    gram: int = 4

    def __post_init__(self) -> None:
        if self.gram > self.window // (self.window // self.one_in + 1) or self.gram > self.run:
            raise ValueError("a passage could hold no intact n-gram of this length")


class Finder:
    """Finds the passages of a slice of items in texts. Numbers of words that were seen are kept."""

    def __init__(self, index: ItemIndex, measure: Measure) -> None:
        self.index, self.measure = index, measure
        self.known: dict[str, int] = {}

    def passages(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, first character, last one (excluded), words, altered words) of all passages in a text."""
        clean = bare(text)
        words = WORD.findall(clean)
        known, number = self.known, self.index.number
        ids = list(map(known.get, words))
        if None in ids:
            if len(known) > 500_000:
                known.clear()
            for k, n in enumerate(ids):
                if n is None:
                    ids[k] = known[words[k]] = number.get(normal(words[k]), 0)
        spans: list[tuple[int, int]] = []

        def parts() -> np.ndarray:
            spans.extend(m.span() for m in WORD.finditer(clean))
            return inner(clean, spans)

        m = self.measure
        found = verified(np.array(ids, dtype=np.int64), self.index, m.run, m.window, m.one_in, parts)
        if found and not spans:
            spans.extend(x.span() for x in WORD.finditer(clean))
        return [(self.index.names[nth], spans[a][0], spans[b][1], b - a + 1, altered) for nth, held in found.items() for a, b, altered in held]

    def cleaned(self, text: str) -> str:
        """The text without its passages. What a cut brings together may be a passage again, so it is looked at until there is none."""
        while found := sorted((a, b) for _, a, b, _, _ in self.passages(text)):
            at, kept = 0, []
            for first, last in found:
                kept.append(text[at : max(at, first)])
                at = max(at, last)
            text = "".join([*kept, text[at:]])
        return text


def _slices(items: DataFrame, slice_words: int) -> Iterator[list[tuple[int, str, int]]]:
    """The usable items, a slice at a time: each of about ``slice_words`` words, and only one of them is on the driver."""
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    ready = cut(openings(cut(wanted)))
    words = ready.agg(F.sum(F.length("text"))).head()[0] or 0
    count = max(1, -(-words // (6 * slice_words)))
    if count == 1:
        yield [tuple(r) for r in ready.orderBy("item_id", "text").collect()]
        return
    numbered = ready.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for k in range(count):
        yield [tuple(r) for r in numbered.where(F.col("slice") == k).drop("slice").orderBy("item_id", "text").collect()]


def _by_slices(items: DataFrame, measure: Measure, slice_words: int, step: Callable[[Broadcast, bool], None]) -> None:
    """``step`` with a broadcast finder of each slice and whether it is the only one; if not, its work must be done when it returns."""
    held = None
    for part in _slices(items, slice_words):
        if held is not None:
            step(held, False)
            held.unpersist(blocking=True)
        earlier, held = held, items.sparkSession.sparkContext.broadcast((ItemIndex(part, measure.gram), measure))
        alone = earlier is None
    step(held, alone)


def find_leaks(docs: DataFrame, items: DataFrame, measure: Measure = Measure(), slice_words: int = 2_000_000) -> DataFrame:
    """Documents that hold material of evaluation items.

    ``docs`` needs ``doc_id, text``, ``items`` needs ``item_id, text``; other columns are ignored. Result: ``doc_id``, ``item_id``,
    ``first_char`` and ``last_char`` (the passage in the document, last one excluded), ``words`` and ``altered``: one row for each
    passage of an item in a document row, so ids repeat: its longest stretches of ``run`` consecutive words, or ``window`` words of which one in
    ``one_in`` is altered, inserted or left out. Case, accents, punctuation, markup, entities, white space, note marks and
    invisible characters don't count. First sentences that several items share are no material. Null and empty texts and empty tables
    give no rows; null item ids are left out; items given twice count once, and items with the same id and other text are each looked for.
    """
    source = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found: list[DataFrame] = []

    def step(shared: Broadcast, alone: bool) -> None:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(*shared.value)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in finder.passages(text)]
                columns = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n < 2 else pa.int32()) for n, c in enumerate(columns)], ["doc_id", *LEAKS])

        leaks = source.mapInArrow(scan, "doc_id long, item_id long, first_char int, last_char int, words int, altered int")
        found.append(leaks if alone else cut(leaks))

    _by_slices(items, measure, slice_words, step)
    out = found[0]
    for leaks in found[1:]:
        out = out.unionByName(leaks)
    return out


def remove_leaks(docs: DataFrame, items: DataFrame, measure: Measure = Measure(), slice_words: int = 2_000_000) -> DataFrame:
    """The documents without the passages that ``find_leaks`` finds in them: (``doc_id``, ``text``), found and cut in one scan.

    Every row stays, so do null ids and texts and repeated rows; a text that was a passage throughout becomes empty. Nothing that counts as
    material of an item is left. If there are several slices of items, the documents are written once for each, again and again until a pass cuts nothing.
    """
    kind = dict(docs.dtypes)["doc_id"]
    left = docs.select("doc_id", "text", F.lit(False).alias("cut"))
    single = False

    def step(shared: Broadcast, alone: bool) -> None:
        nonlocal left, single
        single = alone

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(*shared.value)
            for batch in batches:
                before = batch.column("text").to_pylist()
                texts = [None if t is None else finder.cleaned(t) for t in before]
                touched = [was or a != b for was, a, b in zip(batch.column("cut").to_pylist(), before, texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(touched, pa.bool_())], ["doc_id", "text", "cut"])

        left = left.mapInArrow(scan, f"doc_id {kind}, text string, cut boolean")
        left = left if alone else cut(left)

    while True:
        _by_slices(items, measure, slice_words, step)
        # What one slice's cut brings together may be a passage of a slice before.
        if single or left.where("cut").isEmpty():
            return left.select("doc_id", "text")
        left = left.withColumn("cut", F.lit(False))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold material of evaluation items."""
    return find_leaks(*_tables(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the leaked passages."""
    return remove_leaks(*_tables(spark, sf_dir))


def queries() -> dict:
    return {"p7_found": p7_found, "p7_clean": p7_clean}


def oracle_sql() -> dict[str, str]:
    return {}
