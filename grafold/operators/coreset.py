"""The coreset's own graph and the kernel centroids of its clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure
from grafold.operators.updates import symmetric


def induced_edges(coreset: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among each trial's coreset: (trial, i, j, weight, wi, di, wj, dj), both directions."""
    a = coreset.select(F.col("trial"), F.col("node").alias("src"), F.col("ord").alias("i"), F.col("weight").alias("wi"), F.col("degree").alias("di"))
    b = coreset.select(F.col("trial"), F.col("node").alias("dst"), F.col("ord").alias("j"), F.col("weight").alias("wj"), F.col("degree").alias("dj"))
    # No larger than the configuration says, so edges are not shuffled for it.
    return symmetric(edges).join(F.broadcast(a), "src").join(F.broadcast(b), ["trial", "dst"]).select("trial", "i", "j", "weight", "wi", "di", "wj", "dj")


def coreset_graph(coreset: DataFrame, edges: DataFrame, sigma: float) -> DataFrame:
    """(trial, i, j, a): a = A_ij (w_i / d_i)(w_j / d_j), and sigma w_i**2 / d_i on the diagonal."""
    off = induced_edges(coreset, edges).select("trial", "i", "j", (F.col("weight") * (F.col("wi") / F.col("di")) * (F.col("wj") / F.col("dj"))).alias("a"))
    diagonal = coreset.select("trial", F.col("ord").alias("i"), F.col("ord").alias("j"), (F.lit(sigma) * F.col("weight") * F.col("weight") / F.col("degree")).alias("a"))
    return off.unionByName(diagonal)


def check_matrix(graph: DataFrame) -> None:
    """IndexFailure for a negative or non-finite entry off the diagonal."""
    bad = graph.where("i <> j").where(F.isnan("a") | (F.col("a") < 0) | (F.abs("a") == float("inf")) | F.col("a").isNull())
    if not bad.isEmpty():
        raise IndexFailure("the matrix holds a negative or non-finite weight")


def centers(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """labelled = coreset with label -> (trial, label, denom, norm): the sum of weights of a cluster and the
    squared norm of its centroid; a cluster of no weight has an infinite norm."""
    denom = labelled.groupBy("trial", "label").agg(F.sum("weight").alias("denom"))
    side = labelled.select("trial", F.col("ord").alias("i"), F.col("label").alias("li"))
    other = labelled.select("trial", F.col("ord").alias("j"), F.col("label").alias("lj"))
    inner = induced_edges(labelled, edges).join(side, ["trial", "i"]).join(other, ["trial", "j"]).where("li = lj")
    total = inner.groupBy("trial", F.col("li").alias("label")).agg(F.sum(F.col("wi") * F.col("wj") * F.col("weight") / (F.col("di") * F.col("dj"))).alias("pairs"))
    norm = F.when(F.col("denom") > 0, F.coalesce("pairs", F.lit(0.0)) / (F.col("denom") * F.col("denom"))).otherwise(float("inf"))
    return denom.join(total, ["trial", "label"], "left").select("trial", "label", "denom", norm.alias("norm"))
