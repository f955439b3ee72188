"""Clustering and ranking quality as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafold.functions.scalars import hash_long, uniform
from grafold.operators.ordering import running

EPS = 2.220446049250313e-16


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand_index(labels: DataFrame) -> DataFrame:
    """labels(truth, pred, ...) -> one row (ari): 1 for identical partitions or fewer than two rows, 0 where
    the index is not defined. One pass to the contingency table, everything else on it."""
    cells = labels.groupBy("truth", "pred").agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("truth").agg(F.sum("n").alias("n"), F.count("*").alias("parts")), cells.groupBy("pred").agg(F.sum("n").alias("n"), F.count("*").alias("parts"))
    c = cells.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("both"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("all"))
    r = rows.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("a"), F.coalesce(F.max("parts"), F.lit(0)).alias("pa"))
    q = cols.agg(F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("b"), F.coalesce(F.max("parts"), F.lit(0)).alias("pb"))
    one = c.join(F.broadcast(r)).join(F.broadcast(q))  # one row each
    expected = F.col("a") * F.col("b") / _pairs(F.col("all"))
    below = (F.col("a") + F.col("b")) / 2 - expected
    same = (F.col("pa") <= 1) & (F.col("pb") <= 1)
    return one.select(F.when((F.col("all") < 2) | same, 1.0).when(F.abs(below) < EPS, 0.0).otherwise((F.col("both") - expected) / below).alias("ari"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """scored(score, truth 0/1) -> one row (roc_auc), NaN unless both classes occur. Equal scores count half;
    the work is on distinct scores, in score order."""
    by = scored.groupBy("score").agg(F.sum(F.col("truth").cast("double")).alias("p"), F.sum(1 - F.col("truth").cast("double")).alias("n"))
    u = running(by, ["score"], {"upto": "n"}).withColumn("before", F.col("upto") - F.col("n"))
    out = u.agg(F.sum(F.col("p") * (F.col("before") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(float("nan")).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """scored(score, truth 0/1) -> one row (average_precision), NaN unless both classes occur; equal scores are one step."""
    by = scored.groupBy("score").agg(F.sum(F.col("truth").cast("double")).alias("p"), F.count("*").cast("double").alias("c"))
    step = running(by, [F.desc("score")], {"tp": "p", "all": "c"})
    out = step.agg(F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("s"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    return out.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("c")), F.col("s") / F.col("p")).otherwise(float("nan")).alias("average_precision"))


def winner_summary(labels: DataFrame, scores: DataFrame, truth: DataFrame) -> DataFrame:
    """(trial, total_score, num_clusters, ari) of the trial of least score."""
    from grafold.operators.projection import winner

    best = winner(scores)
    mine = labels.join(F.broadcast(best.select("trial")), "trial").join(truth.select("node", F.col("label").alias("truth")), "node")
    ari = adjusted_rand_index(mine.select("truth", F.col("label").alias("pred")))
    return best.join(F.broadcast(mine.agg(F.count_distinct("label").alias("num_clusters")))).join(F.broadcast(ari))  # one row each


def balanced_pairs(labels: DataFrame, count: int, seed: int) -> DataFrame:
    """labels(node, label) -> (pair, u, v, truth): count div 2 draws of same-label pairs and the rest of
    cross-label pairs, in proportion to the nodes; a kind that does not exist gives none. Nodes are numbered
    within their label, so a partner is a look-up, not a search."""
    w = Window.partitionBy("label").orderBy(hash_long(F.lit(seed), F.lit("order"), "node"), "node")
    numbered = labels.withColumn("k", F.row_number().over(w) - 1)
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    spark = labels.sparkSession
    half = count // 2
    draws = spark.range(count).select(F.col("id").cast("int").alias("pair"), (F.col("id") < half).cast("int").alias("truth"))
    for c in ("a", "b", "x", "y"):
        draws = draws.withColumn(c, uniform(F.lit(seed), F.lit(c), "pair"))
    big = sizes.where("size >= 2")
    order = Window.orderBy("label")  # a row for each label
    num = lambda df: df.withColumns({"at": F.row_number().over(order) - 1, "labels": F.count("*").over(Window.partitionBy())})
    same = draws.where("truth = 1").join(num(big).select("label", "size", "at", "labels"), F.floor(F.col("a") * F.col("labels")) == F.col("at"))
    i, j = F.floor(F.col("x") * F.col("size")), F.floor(F.col("y") * (F.col("size") - 1))
    same = same.select("pair", "truth", F.col("label").alias("l1"), i.alias("i"), F.col("label").alias("l2"), F.when(j >= i, j + 1).otherwise(j).alias("j"))
    every = num(sizes).where("labels >= 2")
    one = draws.where("truth = 0").join(every.select("label", "size", "at", "labels"), F.floor(F.col("a") * F.col("labels")) == F.col("at"))
    other = F.floor(F.col("b") * (F.col("labels") - 1))
    one = one.select("pair", "truth", F.col("label").alias("l1"), F.floor(F.col("x") * F.col("size")).alias("i"), "y", F.when(other >= F.col("at"), other + 1).otherwise(other).alias("at2"))
    cross = one.join(every.select(F.col("label").alias("l2"), F.col("size").alias("size2"), F.col("at").alias("at2")), "at2").select("pair", "truth", "l1", "i", "l2", F.floor(F.col("y") * F.col("size2")).alias("j"))
    n1 = numbered.select(F.col("label").alias("l1"), F.col("k").alias("i"), F.col("node").alias("u"))
    n2 = numbered.select(F.col("label").alias("l2"), F.col("k").alias("j"), F.col("node").alias("v"))
    return same.unionByName(cross).join(n1, ["l1", "i"]).join(n2, ["l2", "j"]).select("pair", "u", "v", "truth")


def query_subset(live: DataFrame, fraction: float, least: int, seed: int) -> DataFrame:
    """A seeded subset of live(node): max(least, floor(fraction * n)) nodes at most, sorted."""
    keyed = live.select("node", hash_long(F.lit(seed), "node").alias("h"))
    keyed = keyed.withColumn("part", F.shiftright("h", 40).cast("int"))  # 4,096 parts of a hash of 52 bits
    sizes = sorted((r["part"], r["count"]) for r in keyed.groupBy("part").count().collect())
    n = sum(c for _, c in sizes)
    take = min(n, max(least, int(fraction * n)))
    last = 0
    for last, c in sizes:
        if c >= take:
            break
        take -= c
    # All of the parts below, and the rest out of one part.
    rest = keyed.where(F.col("part") == last).orderBy("h", "node").limit(take)
    return keyed.where(F.col("part") < last).unionByName(rest).select("node").orderBy("node")


def expected_edges_per_node(nodes_per_cluster: int, clusters: int, p: float, q: float) -> int:
    """A capacity hint: the expected degree, one at least."""
    return max(1, round((nodes_per_cluster - 1) * p + nodes_per_cluster * (clusters - 1) * q))


def default_sampling_seeds(clusters: int, size: int) -> int:
    """The experiments' default, twice the index's own."""
    return max(2, min(8 * clusters, size - 1))
