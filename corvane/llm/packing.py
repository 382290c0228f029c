"""Filling containers of fixed capacity with texts.

The sizes, in tokens, of all pieces are counted into a histogram of at most ``capacity`` entries. From it alone the plan is made:
large sizes are rounded up within groups of equal cardinality, and for these few sizes configurations of least slack are chosen, each
with the number of containers that repeat it. Spark then gives every large piece its place: its rank within its group, counted in
salted blocks, tells the configuration, container and seat. Small pieces go where they fit best: containers and small pieces are hashed
into shards of bounded size, and each shard is filled by best fit.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.lineage import cut

#: Folder of the public tokenizers' vocabulary files, and the file of tiktoken ranks used.
TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern by which this vocabulary's texts are split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corvane", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def piece_sizes(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """(``doc_id``, ``piece``, ``tokens``): a text longer than the capacity gives full pieces and the rest."""
    rows = docs.where(F.length("text") > 0).select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            at, piece, tokens = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                size = len(encode(text))
                for n in range(-(-size // capacity)):
                    at.append(k)
                    piece.append(n)
                    tokens.append(min(capacity, size - n * capacity))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(tokens, pa.int32())], ["doc_id", "piece", "tokens"]
            )

    return rows.mapInArrow(count, f"doc_id {kind}, piece int, tokens int")


class Plan:
    """Groups of large sizes, and configurations over the sizes to which they are rounded up.

    ``histogram`` maps a size to its number of pieces. Sizes up to ``small`` are left to best fit.
    """

    def __init__(self, histogram: dict[int, int], capacity: int, small: int, groups: int) -> None:
        sizes = sorted((s for s in histogram if s > small), reverse=True)
        total = sum(histogram[s] for s in sizes)
        self.group_of = np.full(capacity + 1, -1, dtype=np.int64)
        self.rounded: list[int] = []
        counts: list[int] = []
        share, filled = total / max(groups, 1), 0
        for size in sizes:
            if not self.rounded or filled >= share * len(self.rounded):
                self.rounded.append(size)
                counts.append(0)
            self.group_of[size] = len(self.rounded) - 1
            counts[-1] += histogram[size]
            filled += histogram[size]
        # For each group: where the ranks of a configuration begin, how many seats a container has, and the first container.
        self.begins: list[list[int]] = [[] for _ in self.rounded]
        self.seats: list[list[int]] = [[] for _ in self.rounded]
        self.firsts: list[list[int]] = [[] for _ in self.rounded]
        self.containers = 0
        given = [0] * len(counts)
        left = counts[:]
        for g in range(len(left)):
            while left[g]:
                chosen = self._configuration(g, left, capacity)
                times = min(left[h] // n for h, n in chosen.items())
                for h, n in chosen.items():
                    self.begins[h].append(given[h])
                    self.seats[h].append(n)
                    self.firsts[h].append(self.containers)
                    given[h] += times * n
                    left[h] -= times * n
                self.containers += times

    def _configuration(self, first: int, left: list[int], capacity: int) -> dict[int, int]:
        """A container with the largest group left over, the rest of it filled as full as the groups left over allow."""
        room = capacity - self.rounded[first]
        # by[r]: the group last added to reach the fill r, or -1; a group is added once for each piece of it that fits.
        by = np.full(room + 1, -1, dtype=np.int64)
        used = np.zeros(room + 1, dtype=np.int64)
        reached = np.zeros(room + 1, dtype=bool)
        reached[0] = True
        for g in range(first, len(left)):
            size, most = self.rounded[g], left[g] - (g == first)
            if size > room or most <= 0:
                continue
            used[:] = 0
            for _ in range(min(most, room // size)):
                new = np.zeros(room + 1, dtype=bool)
                new[size:] = reached[:-size]
                new &= ~reached
                at = np.flatnonzero(new)
                at = at[used[at - size] < most]
                if not len(at):
                    break
                used[at] = used[at - size] + 1
                by[at] = g
                reached[at] = True
            if reached[room]:
                break
        chosen = {first: 1}
        at = int(np.flatnonzero(reached)[-1])
        while at:
            g = int(by[at])
            chosen[g] = chosen.get(g, 0) + 1
            at -= self.rounded[g]
        return chosen

    def place(self, groups: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Containers of the pieces with these ranks (from 0) in these groups."""
        out = np.zeros(len(groups), dtype=np.int64)
        for g in np.unique(groups):
            mine = groups == g
            begins = np.array(self.begins[g], dtype=np.int64)
            k = np.searchsorted(begins, ranks[mine], side="right") - 1
            out[mine] = np.array(self.firsts[g])[k] + (ranks[mine] - begins[k]) // np.array(self.seats[g])[k]
        return out


def best_fit(slack: list[tuple[int, int]], sizes: list[int], capacity: int, fresh: int) -> list[int]:
    """Containers for the pieces, the largest first, each into the container that it leaves least room in.

    ``slack`` has (room, container); new containers are numbered from ``fresh``. A piece's container stands at the piece's place.
    """
    rooms = sorted(slack)
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(rooms, (sizes[k], -1))
        if at < len(rooms):
            room, container = rooms.pop(at)
        else:
            room, container = capacity, fresh
            fresh += 1
        out[k] = container
        if room > sizes[k]:
            insort(rooms, (room - sizes[k], container))
    return out


def pack(docs: DataFrame, capacity: int = 2048, small: int | None = None, groups: int = 160, vocabulary: str | None = None, shard: int = 20_000) -> DataFrame:
    """Containers of at most ``capacity`` tokens: (``container``, ``doc_id``, ``piece``, ``tokens``), each piece in one container.

    ``docs`` needs ``doc_id, text``; other columns are ignored. Only a text of more than ``capacity`` tokens is split, into full pieces
    and a rest, numbered from 0. Null and empty texts need no room and give no rows, nor does an empty table; null ids and repeated rows are
    packed like others. Container numbers are unique, not dense. The same input gives the same containers.
    """
    small = capacity // 16 if small is None else small
    sizes = cut(piece_sizes(docs, capacity, vocabulary or os.path.join(TOKENIZERS, VOCABULARY)))
    histogram = {r["tokens"]: r["count"] for r in sizes.groupBy("tokens").count().collect()}
    plan = Plan(histogram, capacity, small, groups)
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    @F.pandas_udf("long")
    def group(tokens: pd.Series) -> pd.Series:
        return pd.Series(shared.value.group_of[tokens.to_numpy()])

    @F.pandas_udf("long")
    def place(groups: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series(shared.value.place(groups.to_numpy(), ranks.to_numpy()))

    salts = max(1, sum(histogram.values()) // 50_000)
    large = sizes.where(F.col("tokens") > small).withColumn("group", group("tokens")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("group").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = large.groupBy("group", "salt").count().select("group", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("group", "salt").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "tokens")
    ranked = large.withColumn("nth", F.row_number().over(within)).join(offsets, ["group", "salt"])
    placed = cut(ranked.select(place("group", (F.col("offset") + F.col("nth") - 1).cast("long")).alias("container"), "doc_id", "piece", "tokens"))

    few = sum(n for s, n in histogram.items() if s <= small)
    shards = max(1, -(-max(few, plan.containers) // shard))
    rooms = (
        placed.groupBy("container").agg((F.lit(capacity) - F.sum("tokens")).alias("room")).where("room > 0")
        .withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(shards)))
    )
    loose = sizes.where(F.col("tokens") <= small).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    first_new, kind = plan.containers, dict(sizes.dtypes)["doc_id"]

    def fill(key: tuple, held: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["tokens", "doc_id", "piece"]).reset_index(drop=True)
        slack = list(zip(held["room"].tolist(), held["container"].tolist()))
        fresh = first_new + int(key[0]) * (1 << 32)
        pieces["container"] = best_fit(slack, pieces["tokens"].tolist(), capacity, fresh)
        return pieces[["container", "doc_id", "piece", "tokens"]].astype({"container": "int64"})

    filled = rooms.groupBy("shard").cogroup(loose.groupBy("shard")).applyInPandas(fill, f"container long, doc_id {kind}, piece int, tokens int")
    return placed.unionByName(filled)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens with all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, their tokens, the least number that could do, and the share of room used."""
    held = p6_containers(spark, sf_dir).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return held.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).select(
        "containers", "tokens", "fullest",
        F.ceil(F.col("tokens") / 2048).alias("at_least"), F.round(F.col("tokens") / (F.col("containers") * 2048), 4).alias("used"),
    )


def queries() -> dict:
    return {"p6_containers": p6_containers, "p6_fill": p6_fill}


def oracle_sql() -> dict[str, str]:
    return {}
