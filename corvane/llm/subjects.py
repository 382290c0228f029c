"""Subject areas of documents by n-gram language models.

For each area an interpolated bigram model is trained on the sentences of labelled documents, beside a background model of all of
them. A sentence's cross-entropy under an area's model, held against the background's and the other areas', tells whether the sentence
deals with the area; a document gets the areas that enough of its sentences deal with. By how much a token the cross-entropy must be lower is
calibrated on labelled documents that the models have not seen, where several areas can be right at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.lineage import cut
from corvane.llm.leaks import WORD, bare, normal
from corvane.operators.joins import small

FENCED = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[`~]*[ \t]*$|\Z)")
FRONT = re.compile(r"\A---\r?\n.*?\r?\n---\r?\n", re.S)
NO_PROSE = re.compile(r"^\s*(?:#{1,6}\s|\||[-*+]\s+.*::|\*\*[^*]+:\*\*)")
ITEM = re.compile(r"^\s*(?:>\s*)?(?:[-*+]|\d+\.)\s+")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]*_]*\s+")
DIGITS = re.compile(r"\d+")

# An area's bigrams and words count as much as the background's where it has seen the word before, or as many words in all, so many times.
PAIR_PRIOR, WORD_PRIOR = 10.0, 500.0
# Weight of the bigrams in the interpolation; the rest is the words'.
PAIR_WEIGHT = 0.5


def sentences(text: str) -> list[str]:
    """Sentences and list items of a markdown text: no front matter, code, headings, tables, fact lines or metadata."""
    text = FENCED.sub("\n\n", FRONT.sub("", text))
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            out.extend(s for s in SENTENCE.split(" ".join(held)) if s.strip())
            held.clear()

    for line in text.splitlines():
        if not line.strip() or NO_PROSE.match(line):
            flush()
            continue
        item = ITEM.match(line)
        if item:
            flush()
            line = line[item.end() :]
        held.append(line.strip().lstrip("> "))
    flush()
    return out


# What ``bare`` acts upon.
MARKED = re.compile("[&<\\[\\]^*`~\n\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u00b9\u00b2\u00b3\u2070-\u2079\u2020\u2021]|\\A\\s*\\d")
UNMARKED_WORD = re.compile(r"[^\W_]+")
_terms: dict[str, str] = {}


def term(word: str) -> str:
    """A word in normal form; numbers are alike, and a plural s doesn't count."""
    w = normal(word)
    if w[:1].isdigit():
        return "0"
    return w[:-1] if len(w) > 4 and w[-1] == "s" and w[-2] != "s" else w


def raw_words(sentence: str) -> list[str]:
    """The words of a sentence as they stand there, without markup."""
    return WORD.findall(bare(sentence)) if MARKED.search(sentence) else UNMARKED_WORD.findall(sentence)


def terms(sentence: str) -> list[str]:
    """The words of a sentence in normal form."""
    found = raw_words(sentence)
    out = list(map(_terms.get, found))
    if None in out:
        if len(_terms) > 500_000:
            _terms.clear()
        for k, known in enumerate(out):
            if known is None:
                out[k] = _terms[found[k]] = term(found[k])
    return out


class AreaModels:
    """Interpolated bigram models of all areas against the background, as tables of log ratios.

    P(w|v) = PAIR_WEIGHT * P2(w|v) + (1 - PAIR_WEIGHT) * P1(w) for the areas and the background alike; an area's P2 and P1 are smoothed by
    the background's. Where the background has not seen the pair, P2 is nought in both and the words' ratio remains.
    ``counts`` maps an n-gram (a word, or two words with a space between) to its count in each area, the last place being the
    background. ``^`` stands for the start of a sentence.
    """

    def __init__(self, areas: list[str], counts: dict[str, np.ndarray]) -> None:
        self.areas = areas
        self.seen: dict[str, int] = {}
        singles = [g for g in counts if " " not in g and g != "^" and counts[g][-1] > 0]
        self.word = {g: k + 1 for k, g in enumerate(singles)}
        table = np.array([counts[g] for g in singles], dtype=np.float64).reshape(len(singles), len(areas) + 1)
        totals = table.sum(axis=0)
        base = table[:, -1:] / max(totals[-1], 1.0)
        alone = (table[:, :-1] + WORD_PRIOR * base) / (totals[:-1] + WORD_PRIOR)
        size = len(singles) + 1
        self.single = np.zeros((size, len(areas)), dtype=np.float32)
        self.single[1:] = np.log(alone / base) if len(singles) else 0
        keys, values = [], []
        for gram, row in counts.items():
            a, _, b = gram.partition(" ")
            before = counts.get(a)
            if b not in self.word or before is None or not row[-1] or not before[-1] or (a != "^" and a not in self.word):
                continue
            at = self.word[b]
            ground = row[-1] / before[-1]
            after = (row[:-1] + PAIR_PRIOR * ground) / (before[:-1] + PAIR_PRIOR)
            keys.append((self.word[a] if a != "^" else 0) * size + at)
            values.append(np.log((PAIR_WEIGHT * after + (1 - PAIR_WEIGHT) * alone[at - 1]) / (PAIR_WEIGHT * ground + (1 - PAIR_WEIGHT) * base[at - 1, 0])))
        order = np.argsort(keys) if keys else []
        self.keys = np.array(keys, dtype=np.int64)[order] if keys else np.zeros(0, dtype=np.int64)
        self.pair = np.array(values, dtype=np.float32)[order] if keys else np.zeros((0, len(areas)), dtype=np.float32)

    def numbers(self, sentence: str) -> list[int]:
        """The numbers of a sentence's words, -1 for those that the models don't know."""
        found = raw_words(sentence)
        out = list(map(self.seen.get, found))
        if None in out:
            if len(self.seen) > 500_000:
                self.seen.clear()
            for k, known in enumerate(out):
                if known is None:
                    out[k] = self.seen[found[k]] = self.word.get(term(found[k]), -1)
        return out

    def gains(self, found: list[list[str]]) -> np.ndarray:
        """As ``gains_of``, for sentences of words in normal form."""
        return self.gains_of([[self.word.get(w, -1) for w in words] for words in found])

    def gains_of(self, found: list[list[int]]) -> np.ndarray:
        """For each sentence and area: by how many nats a token its cross-entropy is lower than under the background model."""
        flat, starts = [], []
        for numbers in found:
            starts.append(len(flat))
            flat.append(0)
            flat += numbers
        ids = np.array(flat, dtype=np.int64)
        if not len(ids):
            return np.zeros((0, len(self.areas)))
        size = self.single.shape[0]
        gain = np.zeros((len(ids), len(self.areas)), dtype=np.float32)
        known = ids > 0
        gain[known] = self.single[ids[known]]
        if len(self.keys):
            key = np.where((ids[:-1] >= 0) & (ids[1:] > 0), ids[:-1] * size + ids[1:], -1)
            at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            hit = self.keys[at] == key
            gain[1:][hit] = self.pair[at[hit]]
        lengths = np.diff(np.r_[starts, len(ids)]) - 1
        return np.add.reduceat(gain, starts, axis=0, dtype=np.float64) / np.maximum(lengths, 1)[:, None]


def ngrams(words: list[str]) -> list[str]:
    """The words and the pairs of neighbours, the sentence's start included."""
    return ["^", *words, *(f"{a} {b}" for a, b in zip(["^", *words], words))]


def dealt_with(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence the area it would deal with, and the evidence: the lesser of the gain over the background and
    half the gain over the other areas' average."""
    best = gains.argmax(axis=1)
    top = gains[np.arange(len(gains)), best]
    others = (gains.sum(axis=1) - top) / max(gains.shape[1] - 1, 1)
    return best, np.minimum(top, (top - others) / 2) if gains.shape[1] > 1 else top


def accepted(best: np.ndarray, evidence: np.ndarray, threshold: float, areas: int, least: int, share: float) -> list[int]:
    """Areas that at least ``least`` sentences deal with and a ``share`` of those that deal with any area."""
    found = np.bincount(best[evidence > threshold], minlength=areas)
    return [k for k in range(areas) if found[k] >= least and found[k] >= share * found.sum()]


# Thresholds of evidence, in nats a token, among which the calibration chooses.
GRID = (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5)
# Each area is a column of the models that every task holds.
MAX_AREAS = 1000
# One labelled document in so many is held out from the models by which the threshold is calibrated.
HELD_OUT = 5


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def labelled(docs: DataFrame, labels: DataFrame, areas: list[str]) -> DataFrame:
    """(text, areas, held) of all labelled documents."""
    given = (
        labels.where(F.col("doc_id").isNotNull() & F.col("area").isin(areas))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("area")).alias("areas"))
    )
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(small(given), "doc_id")
    return rows.select("text", "areas", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0).alias("held"))


def train(known: DataFrame, areas: list[str], min_count: int = 2) -> tuple[AreaModels, AreaModels]:
    """Models of the documents that are not held out, and of all.

    N-grams seen less than ``min_count`` times are left out. What is collected and broadcast are the others of all labelled documents; the
    counting itself is distributed.
    """
    place = {area: k for k, area in enumerate(areas)}
    width = len(areas) + 1
    columns = [f"{part}{k}" for part in ("own", "all") for k in range(width)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            table = np.array(list(grams.values())).reshape(len(grams), 2 * width)
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), *(pa.array(table[:, k]) for k in range(2 * width))], ["gram", *columns])

        for row in _batches(batches):
            weights = np.zeros(2 * width)
            for area in row["areas"]:
                weights[width + place[area]] = 1.0 / len(row["areas"])
            weights[-1] = 1.0
            if not row["held"]:
                weights[:width] = weights[width:]
            for sentence in sentences(row["text"]):
                for gram in ngrams(terms(sentence)):
                    if gram in grams:
                        grams[gram] += weights
                    else:
                        grams[gram] = weights.copy()
            if len(grams) > 200_000:
                yield out()
                grams.clear()
        yield out()

    counts = (
        known.mapInArrow(count, "gram string, " + ", ".join(f"{c} double" for c in columns)).groupBy("gram")
        .agg(*[F.sum(c).alias(c) for c in columns]).where(F.col(columns[-1]) >= min_count)
    )
    rows = {row[0]: np.array(row[1:], dtype=np.float64) for row in counts.toLocalIterator()}
    return AreaModels(areas, {g: c[:width] for g, c in rows.items()}), AreaModels(areas, {g: c[width:] for g, c in rows.items()})


def calibrate(known: DataFrame, models: AreaModels, least: int, share: float) -> float:
    """The threshold at which the areas of documents that the models haven't seen agree best with their labels (F1; the middle one of ties)."""
    shared = known.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {area: k for k, area in enumerate(model.areas)}
        right, given, true = np.zeros(len(GRID)), np.zeros(len(GRID)), 0
        for row in _batches(batches):
            wanted = {place[a] for a in row["areas"]}
            true += len(wanted)
            found = [terms(s) for s in sentences(row["text"])]
            if found:
                best, evidence = dealt_with(model.gains(found))
                for k, threshold in enumerate(GRID):
                    areas = set(accepted(best, evidence, threshold, len(place), least, share))
                    right[k] += len(areas & wanted)
                    given[k] += len(areas)
        yield pa.RecordBatch.from_pydict({"k": list(range(len(GRID))), "hit": right, "given": given, "true": [float(true)] * len(GRID)})

    sums = known.mapInArrow(judge, "k long, hit double, given double, true double").groupBy("k").agg(F.sum("hit"), F.sum("given"), F.sum("true")).collect()
    f1 = {GRID[r[0]]: round(2 * r[1] / max(r[2] + r[3], 1.0), 4) for r in sums}
    ties = sorted(t for t in GRID if f1.get(t, 0.0) == max(f1.values(), default=0.0))
    return ties[len(ties) // 2]


def subject_areas(docs: DataFrame, labels: DataFrame, areas: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """Areas of every document: (``doc_id``, ``area``), one row for each area that at least ``least`` of its sentences or list items
    deal with, if they are at least ``share`` of those that deal with any area.

    ``docs`` needs ``doc_id, text``, ``labels`` ``doc_id, area``, ``areas`` ``area``; other columns are ignored. The models are
    fitted on all labelled documents, the threshold on a fifth of them that its models have not seen; all documents are scored whole. Null texts and texts without sentences
    give no rows; a document given twice is scored twice; labels for unknown documents or areas and repeated labels don't count. More than ``MAX_AREAS``
    areas are refused. Without
    usable labels, or with empty tables, the result is empty. Of areas that explain a sentence alike the first by name is taken.
    """
    names = sorted(r[0] for r in areas.select("area").where(F.col("area").isNotNull()).distinct().limit(MAX_AREAS + 1).collect())
    if len(names) > MAX_AREAS:
        raise ValueError(f"there are more than {MAX_AREAS} areas to choose from")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    if not names:
        return rows.select("doc_id", F.lit(None).cast("string").alias("area")).where(F.lit(False))
    known = cut(labelled(docs, labels, names))
    partial, models = train(known, names)
    held = known.where("held")
    # Of a handful of labelled documents none may be held out.
    threshold = calibrate(held, partial, least, share) if not held.isEmpty() else calibrate(known, models, least, share)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, found = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                found_in = [model.numbers(s) for s in sentences(text)]
                if found_in and len(model.word):
                    best, evidence = dealt_with(model.gains_of(found_in))
                    for k in accepted(best, evidence, threshold, len(model.areas), least, share):
                        ids.append(at)
                        found.append(model.areas[k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], ["doc_id", "area"])

    return rows.mapInArrow(score, f"doc_id {kind}, area string")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of all documents."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return subject_areas(read("documents"), read("area_labels"), read("subject_areas"))


def queries() -> dict:
    return {"p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return {}
