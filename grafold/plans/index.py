"""The public index: an edge table that takes update batches and answers clustering queries."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure, InvalidConfig, InvalidInput
from grafold.operators import consensus as C
from grafold.operators import neighbours as N
from grafold.operators import projection as P
from grafold.operators import updates as U
from grafold.operators.community import Clusterer, LeidenConfig, cluster, leiden_clusterer
from grafold.operators.components import cut
from grafold.operators.coreset import check_matrix, coreset_graph
from grafold.operators.sampling import check_sizes, extract_coreset
from grafold.sources.tables import ops_of


@dataclass(frozen=True)
class IndexConfig:
    """``num_clusters`` is advice to the clusterer and sets the default of ``sampling_seeds``. The last three are
    checked and otherwise unused: they size buffers of an engine in memory, and Spark plans need no such hints."""

    num_clusters: int
    sigma: float = 1000.0
    coreset_size: int = 8192
    sampling_seeds: int | None = None
    num_trials: int = 1
    rng_seed: int | None = None
    node_capacity: int = 1024
    expected_edges_per_node: int = 16
    degree_rebuild_threshold: int = 4096

    def __post_init__(self):
        for name in ("num_clusters", "coreset_size", "num_trials", "node_capacity", "expected_edges_per_node", "degree_rebuild_threshold"):
            if getattr(self, name) < 1:
                raise InvalidConfig(f"{name} must be above zero")
        if not (math.isfinite(self.sigma) and self.sigma > 0):
            raise InvalidConfig("sigma must be finite and above zero")
        if self.sampling_seeds is not None and self.sampling_seeds < 1:
            raise InvalidConfig("sampling_seeds must be above zero")
        if self.seeds >= self.coreset_size:
            raise InvalidConfig("sampling_seeds must be below coreset_size")

    @property
    def seeds(self) -> int:
        return max(2, min(4 * self.num_clusters, self.coreset_size - 1)) if self.sampling_seeds is None else self.sampling_seeds


@dataclass
class QueryResult:
    """labels(pos, node, label[, score]) of one trial."""

    labels: DataFrame
    trial_index: int
    num_clusters: int
    total_score: float

    def in_order(self) -> DataFrame:
        return self.labels.orderBy("pos")


@dataclass
class AllTrials:
    """Every trial of a query: labels(trial, pos, node, label, score), trials(trial, num_clusters, total_score)."""

    labels: DataFrame
    trials: DataFrame

    def results(self) -> list[QueryResult]:
        """One result for each trial, in order; their labels keep the score of each node."""
        rows = self.trials.orderBy("trial").collect()  # a row for each trial
        return [QueryResult(self.labels.where(F.col("trial") == r["trial"]).drop("trial"), r["trial"], r["num_clusters"], r["total_score"]) for r in rows]


@dataclass
class Consensus:
    """Reusable: the labels of all trials and their weights. Pairs are scored on demand."""

    labels: DataFrame  # trial, pos, node, label, score
    trials: DataFrame  # trial, num_clusters, total_score, weight
    nodes: DataFrame  # pos, node

    def score_pairs(self, pairs: DataFrame) -> DataFrame:
        C.require_members(pairs, self.labels)
        return C.score_pairs(pairs, self.labels, self.trials)

    def score_pair(self, u: int, v: int) -> float:
        return self.score_pairs(self.nodes.sparkSession.createDataFrame([(u, v)], "u long, v long")).first()["score"]

    def score_flat_pairs(self, flat: DataFrame) -> DataFrame:
        return self.score_pairs(C.flat_pairs(flat))

    def score_matrix(self, nodes: DataFrame | None = None) -> DataFrame:
        if nodes is not None:
            C.require_members(nodes.select(F.col("node").alias("u"), F.col("node").alias("v")), self.labels)
        return C.score_matrix(self.nodes if nodes is None else nodes, self.labels, self.trials)

    def dense_matrix(self, nodes: DataFrame | None = None) -> DataFrame:
        """(node, scores) with the zeros, of all nodes asked for or of some."""
        if nodes is not None:
            C.require_members(nodes.select(F.col("node").alias("u"), F.col("node").alias("v")), self.labels)
        return C.dense_matrix(self.nodes if nodes is None else nodes, self.labels, self.trials)

    def threshold_pairs(self, pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
        return C.threshold_pairs(self.score_pairs(pairs), threshold)

    def connected_components(self, pairs: DataFrame, threshold: float = 0.8, include_singletons: bool = True) -> DataFrame:
        return C.connected_components(self.score_pairs(pairs), self.nodes, threshold, include_singletons)

    @property
    def num_trials(self) -> int:
        return self.trials.count()

    @property
    def num_nodes(self) -> int:
        return self.nodes.count()

    @property
    def num_clusters(self) -> dict[int, int]:
        """Clusters of each trial."""
        return {r["trial"]: r["num_clusters"] for r in self.trials.select("trial", "num_clusters").collect()}

    @property
    def trial_indices(self) -> list[int]:
        return [r["trial"] for r in self.trials.select("trial").orderBy("trial").collect()]


class GraphIndex:
    """``edges`` may start from any table (src, dst, weight), src < dst. An update batch adds its last writes as a
    small checkpointed delta; reading lays the deltas over the base. The base is written anew when
    ``COMPACT_DELTAS`` deltas have come together or a query needs the degrees, not for each batch.

    ``timing`` adds up over all queries: seconds of the steps, and how many queries, trials, coreset nodes
    and labels there were."""

    COMPACT_DELTAS = 16

    def __init__(self, spark: SparkSession, config: IndexConfig, clusterer: Clusterer | None = None, edges: DataFrame | None = None):
        self.spark, self.config = spark, config
        self.clusterer = clusterer or leiden_clusterer(LeidenConfig(seed=config.rng_seed or 0))
        self._base = U.empty_edges(spark) if edges is None else edges
        self._deltas: list[DataFrame] = []
        self._nodes: DataFrame | None = None
        self.timing: dict[str, float] = {}

    @property
    def edges(self) -> DataFrame:
        if not self._deltas:
            return self._base
        out = None
        for k, delta in enumerate(self._deltas):
            part = delta.withColumn("k", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return U.overlay(self._base, out.groupBy("src", "dst").agg(F.max_by(F.struct("weight"), "k").alias("w")).select("src", "dst", "w.weight"))

    def _compact(self) -> None:
        if self._deltas:
            self._base, self._deltas = cut(self.edges), []

    def _spent(self, **steps: float) -> None:
        for name, value in steps.items():
            self.timing[name] = self.timing.get(name, 0) + value

    # Updates

    def update_edges(self, ops: DataFrame | list) -> U.UpdateStats:
        """Applies ops (a table with ``seq``, or tuples in order). The first invalid one raises, after those
        before it have been applied."""
        if isinstance(ops, list):
            ops = ops_of(self.spark, ops)
        if "seq" not in ops.columns:
            raise InvalidInput("ops need a column seq, which orders them")
        began = time.perf_counter()
        ops = cut(ops.select(F.col("seq").cast("long").alias("seq"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.col("weight").cast("double").alias("weight")))
        bad = U.first_invalid(ops).first()
        good = ops if bad is None else ops.where(F.col("seq") < bad["seq"])
        stats = U.UpdateStats(**U.update_stats(self.edges, good).first().asDict())
        if stats.total:
            self._deltas, self._nodes = [*self._deltas, cut(U.last_writes(good))], None
        if len(self._deltas) >= self.COMPACT_DELTAS:
            self._compact()
        self._spent(update_s=time.perf_counter() - began, updates=stats.total)
        U.raise_invalid(bad)
        return stats

    def update_edge(self, u: int, v: int, weight: float) -> None:
        self.update_edges([(u, v, weight)])

    def delete_edge(self, u: int, v: int) -> bool:
        """Whether there was such an edge."""
        return self.update_edges([(u, v, None)]).deleted == 1

    def flush(self) -> None:
        """Compacts the edges and computes their degrees. Queries do it by themselves."""
        if self._nodes is None:
            self._compact()
            self._nodes = cut(U.degrees(self.edges))

    def clear(self) -> None:
        self._base, self._deltas, self._nodes = U.empty_edges(self.spark), [], None

    @property
    def nodes(self) -> DataFrame:
        self.flush()
        return self._nodes

    def contains_node(self, node: int) -> bool:
        return N.degree(self.edges, node) is not None

    def live_nodes(self) -> DataFrame:
        return N.live_nodes(self.edges)

    def live_node_count(self) -> int:
        return self.nodes.count()

    @property
    def volume(self) -> float:
        """The sum of all degrees."""
        return N.size_volume(self.nodes).first()["volume"]

    def neighbours(self, node: int) -> DataFrame:
        """(dst, weight) of one node."""
        return N.neighbours_of(self.edges, node)

    def neighbourhoods(self, nodes: DataFrame | list) -> DataFrame:
        """(pos, node, dst, weight); IndexFailure for a node without an edge."""
        table = self._table(nodes)
        N.require_live(table, self.edges)
        return N.neighbourhoods(table, self.edges)

    def intersecting(self, sources: DataFrame | list, targets: DataFrame | list) -> DataFrame:
        """(pos, node, dst, ord, weight): the neighbours of the sources among the targets; IndexFailure for a
        source without an edge."""
        table = self._table(sources)
        N.require_live(table, self.edges)
        return N.intersecting(table, self._table(targets).withColumnRenamed("pos", "ord"), self.edges)

    # Queries

    def _query(self, query: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(labels of all trials, trials)."""
        began, c = time.perf_counter(), self.config
        check_sizes(self.nodes.count(), c.coreset_size, c.seeds, c.num_trials)
        lost = query.select("node").join(self.nodes, "node", "left_anti").first()
        if lost is not None:
            raise IndexFailure(f"unknown node {lost['node']}")
        coreset = extract_coreset(self.edges, self.nodes, c.rng_seed or 0, c.coreset_size, c.seeds, c.num_trials, c.sigma)
        drawn = time.perf_counter()
        graph = cut(coreset_graph(coreset, self.edges, c.sigma))
        check_matrix(graph)
        built = time.perf_counter()
        labelled = cut(cluster(graph, coreset, self.clusterer, c.num_clusters))
        clustered = time.perf_counter()
        labels = cut(P.project(query, labelled, self.edges, self.nodes, c.sigma))
        trials = cut(P.trial_scores(labels).join(P.counted(labelled), "trial"))
        done = time.perf_counter()
        self._spent(coreset_s=drawn - began, graph_s=built - drawn, cluster_s=clustered - built, label_s=done - clustered, query_s=done - began)
        self._spent(queries=1, trials=c.num_trials, coreset_nodes=coreset.count(), labels=labels.count())
        return labels, trials

    def _table(self, nodes: DataFrame | list) -> DataFrame:
        if isinstance(nodes, list):
            return self.spark.createDataFrame(list(enumerate(nodes)), "pos int, node long")
        if "pos" not in nodes.columns:
            nodes = nodes.withColumn("pos", F.col("node"))
        return nodes.select("pos", F.col("node").cast("long").alias("node"))

    def query(self, nodes: DataFrame | list) -> QueryResult:
        """The trial of least score; labels keep the order and the repeats of the nodes asked for. A table
        without ``pos`` takes the node for it."""
        labels, trials = self._query(self._table(nodes))
        best = P.winner(trials.select("trial", "total_score")).first()
        if best is None:
            raise InvalidInput("no nodes were asked for")
        k = trials.where(F.col("trial") == best["trial"]).first()["num_clusters"]
        return QueryResult(labels.where(F.col("trial") == best["trial"]).select("pos", "node", "label"), best["trial"], k, best["total_score"])

    def query_all(self) -> QueryResult:
        return self.query(self.nodes.select("node"))

    def query_all_trials(self, nodes: DataFrame | list | None = None) -> AllTrials:
        """Every trial, of the nodes asked for or of all nodes."""
        return AllTrials(*self._query(self._table(self.nodes.select("node") if nodes is None else nodes)))

    def query_consensus(self, nodes: DataFrame | list, weighting: str = "score_softmax", temperature: float | str | None = None) -> Consensus:
        table = self._table(nodes)
        C.require_unique(table)
        labels, trials = self._query(table)
        C.check_scores(trials, weighting)
        return Consensus(labels, C.trial_weights(trials, weighting, temperature), table)

    def score_pairs(self, pairs: DataFrame | list, weighting: str = "score_softmax", temperature: float | str | None = None) -> DataFrame:
        """pairs(u, v) -> with score; the consensus is asked for the nodes that occur. No pairs: no query."""
        if isinstance(pairs, list):
            pairs = self.spark.createDataFrame(pairs, "u long, v long") if pairs else self.spark.createDataFrame([], "u long, v long")
        if pairs.isEmpty():
            return pairs.withColumn("score", F.lit(0.0))
        pairs = cut(pairs)
        return self.query_consensus(cut(C.first_seen(pairs)), weighting, temperature).score_pairs(pairs)

    def score_pair(self, u: int, v: int, weighting: str = "score_softmax", temperature: float | str | None = None) -> float:
        return self.score_pairs([(u, v)], weighting, temperature).first()["score"]

    def score_flat_pairs(self, flat: DataFrame, weighting: str = "score_softmax", temperature: float | str | None = None) -> DataFrame:
        return self.score_pairs(C.flat_pairs(flat), weighting, temperature)
