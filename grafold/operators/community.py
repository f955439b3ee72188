"""Community detection on a trial's coreset graph: Leiden for modularity, one grouped-map task a trial.

A graph of one task has at most as many nodes as the coreset. The order in which nodes are looked at is
a permutation fixed by the seed and the level, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure, InvalidConfig

#: Gets (number of nodes, rows i, j, a of the symmetric matrix, advised number of clusters); gives labels.
Clusterer = Callable[[int, np.ndarray, np.ndarray, np.ndarray, int], "np.ndarray | list[int]"]


@dataclass(frozen=True)
class LeidenConfig:
    resolution: float = 1.0
    seed: int = 42
    epsilon: float = 1e-10
    min_iterations: int = 1
    max_levels: int = 100
    max_comm_size: int = 0
    quality: str = "modularity"
    skip_refinement: bool = False

    def __post_init__(self):
        if self.quality.lower() != "modularity":
            raise InvalidConfig(f"unsupported quality function {self.quality!r}; only modularity")
        if not (np.isfinite(self.resolution) and self.resolution > 0):
            raise InvalidConfig("resolution must be finite and above zero")
        if not (np.isfinite(self.epsilon) and self.epsilon >= 0):
            raise InvalidConfig("epsilon must be finite and not below zero")
        if self.min_iterations < 0 or self.max_levels < 1 or self.max_comm_size < 0:
            raise InvalidConfig("limits must not be below zero")


class _Level:
    """One level's graph: neighbours without loops, loops apart, node sizes."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, loops: np.ndarray, size: np.ndarray):
        order = np.argsort(i * max(n, 1) + j, kind="stable")
        i, j, w = i[order], j[order], w[order]
        self.n, self.i, self.j, self.w, self.loops, self.size = n, i, j, w, loops, size
        self.at = np.searchsorted(i, np.arange(n + 1))
        self.degree = np.bincount(i, weights=w, minlength=n) + 2 * loops
        self.total = self.degree.sum()  # twice the weight
        self.rows = [list(zip(j[a:b].tolist(), w[a:b].tolist(), strict=True)) for a, b in zip(self.at[:-1], self.at[1:], strict=True)]

    def quality(self, member: np.ndarray, resolution: float) -> float:
        if self.total == 0:
            return 0.0
        k = int(member.max()) + 1
        inside = np.bincount(member[self.i], weights=self.w * (member[self.i] == member[self.j]), minlength=k) / 2
        inside += np.bincount(member, weights=self.loops, minlength=k)
        volume = np.bincount(member, weights=self.degree, minlength=k)
        m = self.total / 2
        return float((inside / m - resolution * (volume / self.total) ** 2).sum())

    def merged(self, fine: np.ndarray) -> _Level:
        k = int(fine.max()) + 1
        a, b = fine[self.i], fine[self.j]
        loops = np.bincount(fine, weights=self.loops, minlength=k) + np.bincount(a, weights=self.w * (a == b), minlength=k) / 2
        key, where = np.unique((a * k + b)[a != b], return_inverse=True)
        w = np.bincount(where, weights=self.w[a != b], minlength=len(key))
        return _Level(k, key // k, key % k, w, loops, np.bincount(fine, weights=self.size, minlength=k))


def renumber(member: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... in the order in which they first occur."""
    _, first, inverse = np.unique(member, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]


def _move(g: _Level, member: np.ndarray, c: LeidenConfig, rng: np.random.Generator) -> bool:
    """Local moving with a queue; changes member in place."""
    if g.total == 0:
        return False
    volume = np.bincount(member, weights=g.degree, minlength=g.n).tolist()
    size = np.bincount(member, weights=g.size, minlength=g.n).tolist()
    degree, sizes, labels = g.degree.tolist(), g.size.tolist(), member.tolist()
    queue = deque(int(v) for v in rng.permutation(g.n) if degree[v] > 0)
    waiting = [degree[v] > 0 for v in range(g.n)]
    scale = c.resolution / g.total
    moved = False
    while queue:
        v = queue.popleft()
        waiting[v] = False
        own, dv = labels[v], degree[v]
        to: dict[int, float] = {}
        for u, w in g.rows[v]:
            to[labels[u]] = to.get(labels[u], 0.0) + w
        # Gains over staying, doubled and over the total weight.
        stay = to.get(own, 0.0) - scale * dv * (volume[own] - dv)
        best, gain = own, c.epsilon
        for label, w in to.items():
            if label == own or (c.max_comm_size and size[label] + sizes[v] > c.max_comm_size):
                continue
            more = 2 / g.total * (w - scale * dv * volume[label] - stay)
            if more > gain:
                best, gain = label, more
        if best != own:
            volume[own] -= dv
            volume[best] += dv
            size[own] -= sizes[v]
            size[best] += sizes[v]
            labels[v] = best
            moved = True
            for u, _ in g.rows[v]:
                if not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    member[:] = labels
    return moved


def _refine(g: _Level, coarse: np.ndarray, c: LeidenConfig, rng: np.random.Generator) -> np.ndarray:
    """Starts from single nodes and merges greedily inside each coarse community: every node is looked at
    once, in a shuffled order, and goes where it gains most over staying, also out of a group that others
    have joined."""
    label = list(range(g.n))
    volume, degree = g.degree.tolist(), g.degree.tolist()
    scale = c.resolution / g.total if g.total else 0.0
    for v in rng.permutation(g.n).tolist():
        own, dv = label[v], degree[v]
        to: dict[int, float] = {}
        for u, w in g.rows[v]:
            if coarse[u] == coarse[v]:
                to[label[u]] = to.get(label[u], 0.0) + w
        stay = to.pop(own, 0.0) - scale * dv * (volume[own] - dv)
        best, gain = own, c.epsilon
        for other, w in to.items():
            more = 2 / g.total * (w - scale * dv * volume[other] - stay)
            if more > gain:
                best, gain = other, more
        if best != own:
            volume[best] += dv
            volume[own] -= dv
            label[v] = best
    return renumber(np.array(label, np.int64))


def leiden(n: int, i: np.ndarray, j: np.ndarray, a: np.ndarray, config: LeidenConfig | None = None) -> np.ndarray:
    """Labels 0..c-1 (numbered as they first occur) of the nodes of a symmetric weighted matrix given by
    its entries; the diagonal and zeros are ignored, negative or non-finite entries are an error."""
    c = config or LeidenConfig()
    i, j, a = np.asarray(i, np.int64), np.asarray(j, np.int64), np.asarray(a, np.float64)
    off = i != j
    i, j, a = i[off], j[off], a[off]
    if len(a) and (not np.isfinite(a).all() or (a < 0).any()):
        raise IndexFailure("the matrix holds a negative or non-finite weight")
    i, j, a = i[a > 0], j[a > 0], a[a > 0]
    if n == 0:
        return np.zeros(0, np.int64)
    g = _Level(n, i, j, a, np.zeros(n), np.ones(n))
    node_of = np.arange(n)  # the level's node of each original node
    member = np.arange(n)
    for level in range(c.max_levels):
        rng = np.random.default_rng([c.seed & 0xFFFFFFFF, level])
        before = g.quality(member, c.resolution)
        moved = _move(g, member, c, rng)
        member = renumber(member)
        after = g.quality(member, c.resolution)
        if not moved or (level + 1 >= c.min_iterations and abs(after - before) < c.epsilon):
            break
        fine = member if c.skip_refinement else _refine(g, member, c, rng)
        k = int(fine.max()) + 1
        if k <= 1 or k == g.n:
            break
        coarse = np.empty(k, np.int64)
        coarse[fine] = member
        g, node_of, member = g.merged(fine), fine[node_of], coarse
    return renumber(member[node_of])


def leiden_clusterer(config: LeidenConfig | None = None) -> Clusterer:
    """The default clusterer; the advised number of clusters is not used."""
    c = config or LeidenConfig()
    return lambda n, i, j, a, k: leiden(n, i, j, a, c)


def cluster(graph: DataFrame, coreset: DataFrame, clusterer: Clusterer, num_clusters: int) -> DataFrame:
    """graph(trial, i, j, a) of the coreset(trial, ord, ...) -> the coreset with ``label``. Every trial is
    one task; the clusterer must give one label for each node."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])  # the sums do not depend on arrival
        n = int(pdf["i"].max()) + 1
        labels = np.asarray(clusterer(n, pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64), pdf["a"].to_numpy(np.float64), num_clusters))
        if labels.shape != (n,):
            raise IndexFailure(f"the clusterer gave {labels.shape} labels for {n} nodes")
        if len(labels) and (labels.min() < 0):
            raise IndexFailure("the clusterer gave a label below zero")
        return pd.DataFrame({"trial": key[0], "ord": np.arange(n), "label": labels.astype(np.int32)})

    labels = graph.groupBy("trial").applyInPandas(run, "trial int, ord int, label int")
    return coreset.join(labels, ["trial", "ord"])


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """edges(src, dst, weight) once each, labels(node, label) -> one row (modularity); 0 without edges.
    A loop counts once inside. Joins and aggregates only."""
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    e = edges.join(a, "src").join(b, "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("la").alias("label"), F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0.0).alias("inside")), F.struct(F.col("lb").alias("label"), F.lit(0.0).alias("inside")))).alias("x"), "weight").select("x.*", "weight")
    by = ends.groupBy("label").agg(F.sum("inside").alias("inside"), F.sum("weight").alias("volume"))
    m = F.sum("volume") / 2
    # sum(inside) / m - resolution * sum(volume**2) / (2m)**2
    return by.agg(F.coalesce(F.sum("inside") / m - F.lit(resolution) * F.sum(F.col("volume") * F.col("volume")) / (F.sum("volume") * F.sum("volume")), F.lit(0.0)).alias("modularity"))


def aggregate_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The quotient graph: (src, dst, weight) between communities, loops (src = dst) kept."""
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst")).agg(F.sum("weight").alias("weight"))
