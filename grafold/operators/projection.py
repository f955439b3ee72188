"""Projection of queried nodes onto the nearest kernel centroid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafold.operators.coreset import centers
from grafold.operators.updates import symmetric


def project(query: DataFrame, labelled: DataFrame, edges: DataFrame, nodes: DataFrame, sigma: float, stats: DataFrame | None = None) -> DataFrame:
    """query(pos, node), labelled = coreset with label -> (trial, pos, node, label, score).

    A node takes the centroid of least norm - 2 * inner product. Of equal ones the cluster s of smallest
    norm (first on ties) wins if it has no hit, else the smallest label. A cluster without a hit is as
    far as its norm, so only s can win among those: clusters that are hit are compared with s alone.
    """
    stats = centers(labelled, edges) if stats is None else stats
    mine = query.select("node").distinct().join(nodes.select("node", "degree"), "node")
    c = labelled.select("trial", F.col("node").alias("dst"), "label", F.col("weight").alias("w"), F.col("degree").alias("dc"))
    # The coreset's size is part of the configuration; of the edges only those that end in it are shuffled.
    hits = symmetric(edges).join(F.broadcast(c), "dst").join(mine, F.col("src") == F.col("node"))
    scores = hits.groupBy("trial", "node", "label").agg(F.sum(F.col("w") * F.col("weight") / (F.col("degree") * F.col("dc"))).alias("ip"))
    least = stats.groupBy("trial").agg(F.min(F.struct("norm", "label")).alias("s")).select("trial", F.col("s.label").alias("s"), F.col("s.norm").alias("s_norm"))
    near = scores.join(F.broadcast(stats), ["trial", "label"]).where(F.col("norm") < float("inf")).withColumn("dist", F.col("norm") - 2 * F.col("ip") / F.col("denom"))
    best = near.groupBy("trial", "node").agg(F.min(F.struct("dist", "label")).alias("b"), F.collect_set("label").alias("hit"))
    each = mine.join(F.broadcast(least)).join(best, ["trial", "node"], "left")
    s_unhit = ~F.coalesce(F.array_contains("hit", F.col("s")), F.lit(False))
    take_s = F.col("b").isNull() | (s_unhit & (F.col("s_norm") <= F.col("b.dist")))
    dist = F.when(take_s, F.col("s_norm")).otherwise(F.col("b.dist"))
    chosen = each.select("trial", "node", F.when(take_s, F.col("s")).otherwise(F.col("b.label")).alias("label"), (dist + 1 / (F.col("degree") * F.col("degree")) + F.lit(sigma) / F.col("degree")).alias("score"))
    return query.select("pos", "node").join(chosen, "node").select("trial", "pos", "node", "label", "score")


def trial_scores(projected: DataFrame) -> DataFrame:
    """(trial, total_score) over all queried positions."""
    return projected.groupBy("trial").agg(F.sum("score").alias("total_score"))


def winner(scores: DataFrame) -> DataFrame:
    """The trial of least total score, the first on ties: one row (trial, total_score). One aggregate."""
    order = F.when(F.isnan("total_score"), float("inf")).otherwise(F.col("total_score"))
    return scores.agg(F.min(F.struct(order.alias("o"), "trial", "total_score")).alias("m")).where("m is not null").select("m.trial", "m.total_score")


def counted(labelled: DataFrame) -> DataFrame:
    """(trial, num_clusters)."""
    return labelled.groupBy("trial").agg(F.count_distinct("label").alias("num_clusters"))
