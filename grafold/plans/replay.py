"""Replays of a dynamic workload: ingest a batch, query a subset, measure quality; and their reports."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafold.operators.community import leiden
from grafold.operators.consensus import score_pairs
from grafold.operators.metrics import adjusted_rand_index, average_precision, balanced_pairs, query_subset, roc_auc, winner_summary
from grafold.plans.index import GraphIndex, IndexConfig
from grafold.sources import sbm

_ROW = "batch int, num_trials int, nodes long, ingest_s double, query_s double, pair_s double, ari double, roc_auc double, average_precision double"


def replay(spark: SparkSession, params: sbm.SbmParams, config: IndexConfig, step: float = 0.1, fraction: float = 0.2, pairs: int = 10_000) -> DataFrame:
    """One row for each batch from the first at which the graph is larger than the coreset."""
    index = GraphIndex(spark, config)
    ops = sbm.batches(sbm.sbm_ops(spark, params), params, step)
    truth = sbm.truth_labels(spark, params)
    rows = []
    for batch in [r["batch"] for r in ops.select("batch").distinct().orderBy("batch").collect()]:  # at most 1 / step + 1
        began = time.perf_counter()
        index.update_edges(ops.where(F.col("batch") == batch).select("seq", "u", "v", "weight"))
        index.flush()
        ingested = time.perf_counter()
        live = index.live_node_count()
        if live <= config.coreset_size:
            continue
        subset = query_subset(index.live_nodes(), fraction, config.coreset_size, params.seed + batch)
        consensus = index.query_consensus(subset)
        queried = time.perf_counter()
        mine = truth.join(subset, "node")
        scored = score_pairs(balanced_pairs(mine, pairs, params.seed + batch), consensus.labels, consensus.trials)
        auc, ap = roc_auc(scored).first()[0], average_precision(scored).first()[0]
        done = time.perf_counter()
        best = winner_summary(consensus.labels, consensus.trials.select("trial", "total_score"), truth).first()
        rows.append((batch, config.num_trials, subset.count(), ingested - began, queried - ingested, done - queried, best["ari"], auc, ap))
    return spark.createDataFrame(rows, _ROW)


def trial_scaling(spark: SparkSession, params: sbm.SbmParams, config: IndexConfig, trials: list[int], **how) -> DataFrame:
    """The replay for several numbers of trials."""
    out = None
    for t in trials:
        part = replay(spark, params, replace(config, num_trials=t), **how)
        out = part if out is None else out.unionByName(part)
    return out


def summary(runs: DataFrame) -> DataFrame:
    """Totals and means for each number of trials."""
    mean = [F.avg(c).alias(f"mean_{c}") for c in ("query_s", "pair_s", "ari", "roc_auc", "average_precision")]
    return runs.groupBy("num_trials").agg(F.count("*").alias("batches"), F.sum("ingest_s").alias("ingest_s"), F.sum("query_s").alias("query_s"), *mean)


def early_batches(runs: DataFrame, below: float = 0.98, otherwise: int = 5) -> DataFrame:
    """Batches whose single-trial ROC-AUC is below a bound; without any, the first few."""
    weak = runs.where((F.col("num_trials") == 1) & (F.col("roc_auc") < below)).select("batch").distinct()
    return weak.orderBy("batch") if not weak.isEmpty() else runs.select("batch").distinct().orderBy("batch").limit(otherwise)


def write_report(runs: DataFrame, path: str) -> None:
    """Per-batch rows and the summary as CSV with headers."""
    runs.orderBy("num_trials", "batch").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/batches")
    summary(runs).orderBy("num_trials").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def control_leiden(edges: DataFrame, truth: DataFrame, limit: int = 5_000_000) -> tuple[DataFrame, float]:
    """The whole graph clustered in one process, as a control for experiments; refused above ``limit`` edges."""
    import numpy as np

    n = edges.count()
    if n > limit:
        raise ValueError(f"{n} edges are too many for one process")
    pdf = edges.toPandas()
    ids, codes = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
    i, j, w = codes[:n], codes[n:], pdf["weight"].to_numpy()
    labels = leiden(len(ids), np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w]))
    found = edges.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(ids, labels, strict=True)], "node long, label int")
    both = found.select("node", F.col("label").alias("pred")).join(truth.select("node", F.col("label").alias("truth")), "node")
    return found, adjusted_rand_index(both).first()[0]
