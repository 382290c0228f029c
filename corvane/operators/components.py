"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.lineage import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, most: int = 2_000_000) -> DataFrame:
    """Components of an undirected graph: (``node``, ``component``), the component being its smallest node.

    A graph of at most ``most`` edges, their ends 64 bytes together on average, is held by one task. In a larger one each round gives every node the smallest label among its
    neighbours' and then follows labels once, so paths shorten by more
    than half. Labels are written after each round; only the number of changes comes to the driver. Hub nodes are no trouble, since
    minima combine on the map side. Null ends and self-loops are ignored (a node with only a self-loop is its own component);
    repeated edges have no effect. Raises if ``max_rounds`` don't suffice.
    """
    pairs = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL"))
    kinds = {kind for _, kind in pairs.dtypes}
    if kinds in ({"string"}, {"bigint"}) and _fits_a_task(pairs, most):
        kind = kinds.pop()
        return written(pairs.coalesce(1).mapInArrow(_found_in_a_task, f"node {kind}, component {kind}"))
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(max_rounds):
        own = labels.select("node", "label", F.col("label").alias("old"))
        offered = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        nearest = offered.unionByName(own).groupBy("node").agg(F.min("label").alias("near"), F.min("old").alias("old"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = written(nearest.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "old"))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _fits_a_task(pairs: DataFrame, most: int) -> bool:
    held = pairs.agg(F.count("*").alias("edges"), F.sum(F.octet_length(F.col("a").cast("string")) + F.octet_length(F.col("b").cast("string"))).alias("bytes")).head()
    return held["edges"] <= most and (held["bytes"] or 0) <= 64 * most


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, for nodes ``0 .. n - 1`` and edges ``a, b``."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # The greater of two roots goes below the smaller; then every node follows its labels to the root.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _found_in_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        edges = pa.Table.from_batches(held)
        ends = pa.chunked_array(edges.column("a").chunks + edges.column("b").chunks)
        nodes = pc.unique(ends)
        nodes = nodes.take(pc.sort_indices(nodes))
        place = pc.index_in(ends, value_set=nodes).to_numpy()
        label = smallest(place[: edges.num_rows], place[edges.num_rows :], len(nodes))
        for begin in range(0, len(nodes), 65_536):
            part = slice(begin, begin + 65_536)
            yield pa.RecordBatch.from_arrays([nodes[part], nodes.take(pa.array(label[part]))], ["node", "component"])
