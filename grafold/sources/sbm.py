"""A synthetic dynamic graph: edges of a stochastic block model that arrive and expire.

At tick t a pair is drawn, inside a cluster with probability E_int / (E_int + E_ext), else across two
clusters, and its weight grows by 1; after ``lifetime`` ticks it falls by 1 again. Expiries come before
the arrival of the same tick. All draws are hashes of (seed, tick), so the stream is a projection of
``range`` and every row can be made anywhere; running weights are one window over each pair's events.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafold.functions.errors import InvalidConfig
from grafold.functions.scalars import hash_long, uniform


@dataclass(frozen=True)
class SbmParams:
    seed: int
    nodes_per_cluster: int
    clusters: int
    p_internal: float
    q_external: float
    multiplier: float = 1.0
    lifetime: float = 1.0

    def __post_init__(self):
        if self.nodes_per_cluster < 1 or self.clusters < 1:
            raise InvalidConfig("clusters and their nodes must be above zero")
        for name in ("p_internal", "q_external"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) >= 0):
                raise InvalidConfig(f"{name} must be finite and not below zero")
        for name in ("multiplier", "lifetime"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) > 0):
                raise InvalidConfig(f"{name} must be finite and above zero")

    @property
    def internal(self) -> float:
        n, k = self.nodes_per_cluster, self.clusters
        return k * n * (n - 1) / 2 * self.p_internal

    @property
    def external(self) -> float:
        n, k = self.nodes_per_cluster, self.clusters
        return k * (k - 1) / 2 * n * n * self.q_external

    @property
    def updates(self) -> int:
        return math.ceil(self.multiplier * (self.internal + self.external))

    @property
    def ticks_alive(self) -> int:
        return max(1, math.ceil(self.lifetime * (self.internal + self.external)))


def _arrivals(spark: SparkSession, p: SbmParams) -> DataFrame:
    """(time, u, v): the pair of each tick; ticks without two different nodes are skipped."""
    n, k = p.nodes_per_cluster, p.clusters
    share = p.internal / (p.internal + p.external) if p.internal + p.external else 0.0
    d = lambda name, m: F.pmod(hash_long(F.lit(p.seed), F.lit(name), "time"), F.lit(m))
    t = spark.range(p.updates).select(F.col("id").alias("time"))
    # Two clusters of k without return, two nodes of n without return: the second skips the first.
    inside = (uniform(F.lit(p.seed), F.lit("kind"), "time") < share) | F.lit(k < 2)
    t = t.withColumns({"inside": inside, "c": d("c", k), "a": d("a", n)})
    t = t.withColumns({"c2": d("c2", max(1, k - 1)), "b": F.when(F.col("inside"), d("b", max(1, n - 1))).otherwise(d("b2", n))})
    t = t.withColumns({"c2": F.when(F.col("inside"), F.col("c")).otherwise(F.when(F.col("c2") >= F.col("c"), F.col("c2") + 1).otherwise(F.col("c2"))), "b": F.when(F.col("inside") & (F.col("b") >= F.col("a")) & F.lit(n > 1), F.col("b") + 1).otherwise(F.col("b"))})
    return t.select("time", (F.col("c") * n + F.col("a")).alias("u"), (F.col("c2") * n + F.col("b")).alias("v")).where("u <> v").select("time", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def sbm_ops(spark: SparkSession, p: SbmParams) -> DataFrame:
    """(seq, time, u, v, weight): the op stream with absolute weights, weight null where a pair goes."""
    up = _arrivals(spark, p).withColumn("delta", F.lit(1.0))
    down = up.select((F.col("time") + p.ticks_alive).alias("time"), "u", "v", F.lit(-1.0).alias("delta")).where(F.col("time") < p.updates)
    run = Window.partitionBy("u", "v").orderBy("time", "delta")
    events = up.unionByName(down).withColumn("w", F.sum("delta").over(run))
    seq = F.col("time") * 2 + (F.col("delta") > 0).cast("long")
    return events.select(seq.alias("seq"), "time", "u", "v", F.when(F.col("w") > 0, F.col("w")).alias("weight"))


def truth_labels(spark: SparkSession, p: SbmParams) -> DataFrame:
    """(node, label): the planted cluster of each node."""
    return spark.range(p.nodes_per_cluster * p.clusters).select(F.col("id").alias("node"), F.floor(F.col("id") / p.nodes_per_cluster).cast("int").alias("label"))


def batches(ops: DataFrame, p: SbmParams, step: float) -> DataFrame:
    """Adds ``batch``: the stream cut to snapshots each of ``step`` of its span; the last may be short."""
    if not (math.isfinite(step) and step > 0):
        raise InvalidConfig("step must be finite and above zero")
    width = max(1.0, step * max(1, p.updates - 1))
    return ops.withColumn("batch", F.floor(F.col("time") / F.lit(width)).cast("int"))


def apply_to(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """A batch's edges after replay; deletes of missing edges are no error."""
    from grafold.operators.updates import merge

    return merge(edges, ops)
