"""Communities of a graph that one task holds: the moves of ``graph.communities`` over arrays."""

from __future__ import annotations

import numpy as np


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)


def _takes(c: np.ndarray, level: int, turn: int) -> np.ndarray:
    """Whether each community takes nodes in this turn (else it gives), by a hash."""
    x = c.astype(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15 + (turn // 2 + 1) * 0xD1B54A32D192ED03) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(1)) == turn % 2


def _ahead(group: np.ndarray, node: np.ndarray, more: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Degrees of those of the same group that gain more."""
    order = np.lexsort((node, -more, group))
    held, before = k[order], np.zeros(len(order))
    before[1:] = np.cumsum(held)[:-1]
    begin = _runs(group[order])
    out = np.empty(len(order))
    out[order] = before - np.repeat(before[begin], np.diff(np.r_[begin, len(order)]))
    return out


def _summed(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, each once, with the sum of their weights."""
    key = i.astype(np.int64) * n + j
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = _runs(key)
    key = key[begin]
    return key // n, key % n, np.add.reduceat(w[order], begin) if len(begin) else np.zeros(0)


def moved(i: np.ndarray, j: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, total: float, resolution: float, level: int, turn: int) -> tuple[np.ndarray, int]:
    """The communities after the moves of one round, and how many nodes would have gained by one. Edges ``i, j, w`` have no self-loops."""
    n = len(k)
    weight = np.bincount(c, k, n)
    every = np.arange(n)
    node, to, tie = _summed(np.r_[i, every], np.r_[c[j], c], np.r_[w, np.zeros(n)], n)
    own = to == c[node]
    gain = np.round(tie - resolution * k[node] * (weight[to] - np.where(own, k[node], 0.0)) / total, 9)
    begin = _runs(node)
    most = np.maximum.reduceat(gain, begin)
    # On ties a node stays, else it goes to the greatest community.
    best = np.maximum.reduceat(np.where(gain == most[node], np.where(own, n, to), -1), begin)
    best = np.where(best == n, c, best)
    more = most - gain[own]
    wants = best != c
    ready = np.flatnonzero(wants & _takes(best, level, turn) & ~_takes(c, level, turn))
    before = _ahead(c[ready], ready, more[ready], k[ready]) + _ahead(best[ready], ready, more[ready], k[ready])
    goes = ready[np.round(more[ready] - resolution * k[ready] * before / total, 9) > 0]
    c = c.copy()
    c[goes] = best[goes]
    return c, int(np.count_nonzero(wants))


def parts(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, label[i], label[j])
        np.minimum.at(new, label[j], label[i])
        while not np.array_equal(new, jump := new[new]):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    return label


def communities(a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, settled: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (known by hashes) and a number of the community of each, for edges given both ways, each once.

    Each round raises modularity, so there is no bound on the number of rounds: they end.
    """
    hashes = np.unique(a)
    i, j, w = _summed(np.searchsorted(hashes, a), np.searchsorted(hashes, b), w, len(hashes))
    first, second, total, member = i, j, w.sum(), np.arange(len(hashes))
    level, n = 0, len(hashes)
    while True:
        k, c = np.bincount(i, w, n), np.arange(n)
        apart = i != j
        x, y, z = i[apart], j[apart], w[apart]
        turn, wanting = 0, n
        while wanting > settled * n:
            c, wanting = moved(x, y, z, k, c, total, resolution, level, turn)
            turn += 1
        names, c = np.unique(c, return_inverse=True)
        member = c[member]
        if n - len(names) <= settled * n:
            break
        n, level = len(names), level + 1
        i, j, w = _summed(c[i], c[j], w, n)
    inside = (member[first] == member[second]) & (first < second)
    return hashes, parts(first[inside], second[inside], len(hashes))
