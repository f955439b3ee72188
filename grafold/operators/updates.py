"""The ordered log of edge upserts and deletes, merged into edge and degree tables.

ops(seq, u, v, weight): weight null deletes, anything else replaces the pair's weight. Within a batch
the last op of a pair wins; the first invalid op (self-loop, weight not finite and above zero, negative
or null id) ends the batch, and the ops before it stay applied.
edges(src, dst, weight): src < dst. nodes(node, degree): nodes exist as long as they have an edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure, InvalidInput, InvalidWeight
from grafold.functions.scalars import canonical, strict

OPS = "seq long, u long, v long, weight double"
EDGES = "src long, dst long, weight double"
NODES = "node long, degree double"


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EDGES)


def _invalid():
    loop = F.col("u") == F.col("v")
    bad_id = F.col("u").isNull() | F.col("v").isNull() | (F.col("u") < 0) | (F.col("v") < 0)
    bad_weight = F.col("weight").isNotNull() & ~strict(F.col("weight"))
    return F.when(bad_id, "id").when(loop, "loop").when(bad_weight, "weight")


def first_invalid(ops: DataFrame) -> DataFrame:
    """(seq, reason) of the op that ends the batch; no rows if all are valid. One aggregate, no sort."""
    bad = ops.withColumn("reason", _invalid()).where("reason is not null")
    return bad.agg(F.min(F.struct("seq", "reason")).alias("m")).where("m is not null").select("m.*")


def valid_prefix(ops: DataFrame) -> DataFrame:
    """The ops before the first invalid one."""
    stop = first_invalid(ops).select(F.col("seq").alias("stop"))
    return ops.join(F.broadcast(stop), F.col("seq") >= F.col("stop"), "left_anti")  # one row at most


def judged(ops: DataFrame) -> DataFrame:
    """The ops with ``reason``, null for a valid one."""
    return ops.withColumn("reason", _invalid())


def raise_invalid(row) -> None:
    if row is None:
        return
    if row["reason"] == "weight":
        raise InvalidWeight(f"op {row['seq']}: the weight must be finite and above zero")
    if row["reason"] == "loop":
        raise IndexFailure(f"op {row['seq']}: self-loops are not supported")
    raise InvalidInput(f"op {row['seq']}: node ids must be integers from 0")


def last_writes(ops: DataFrame) -> DataFrame:
    """The last op of each pair: (src, dst, weight), weight null for a delete. Partial aggregation, no window."""
    return canonical(ops).groupBy("src", "dst").agg(F.max_by(F.struct("weight"), "seq").alias("w")).select("src", "dst", "w.weight")


def overlay(edges: DataFrame, written: DataFrame) -> DataFrame:
    """The edges under last writes(src, dst, weight), one for each pair, weight null for a delete."""
    new = written.select("src", "dst", "weight", F.lit(True).alias("touched"))
    old = edges.select("src", "dst", F.col("weight").alias("old"))
    both = old.join(new, ["src", "dst"], "full_outer")
    now = F.when(F.col("touched"), F.col("weight")).otherwise(F.col("old"))
    return both.select("src", "dst", now.alias("weight")).where("weight is not null")


def merge(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """The edges after a batch of valid ops."""
    return overlay(edges, last_writes(ops))


@dataclass(frozen=True)
class UpdateStats:
    total: int
    set: int
    deleted: int
    missing_deletes: int


def update_stats(edges: DataFrame, ops: DataFrame) -> DataFrame:
    """One row (total, set, deleted, missing_deletes); a delete counts as deleted if the pair existed just then."""
    log = canonical(ops)
    before = F.lag(F.struct(F.col("weight").isNotNull().alias("there"))).over(Window.partitionBy("src", "dst").orderBy("seq"))
    held = edges.select("src", "dst", F.lit(True).alias("held"))
    judged = log.withColumn("before", before).join(held, ["src", "dst"], "left")
    existed = F.coalesce(F.col("before.there"), F.col("held"), F.lit(False))
    gone = F.col("weight").isNull()
    return judged.agg(
        F.count("*").alias("total"),
        F.count_if(~gone).alias("set"),
        F.count_if(gone & existed).alias("deleted"),
        F.count_if(gone & ~existed).alias("missing_deletes"),
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    ends = F.explode(F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return edges.select(ends, "weight").select("e.src", "e.dst", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    """nodes(node, degree): the sum of a node's weights."""
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))


def node_ops(before: DataFrame, after: DataFrame, ops: DataFrame) -> DataFrame:
    """What a batch did to its nodes: (node, degree) for each endpoint, degree null if the node is gone.
    Endpoints that did not exist before or after (only missing deletes) are left out. Only the touched
    nodes' edges are summed."""
    touched = ops.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    of = lambda edges: symmetric(edges).withColumnRenamed("src", "node").join(touched, "node", "left_semi")
    now = of(after).groupBy("node").agg(F.sum("weight").alias("degree"))
    was = of(before).select("node", F.lit(True).alias("was")).distinct()
    out = touched.join(now, "node", "left").join(was, "node", "left")
    return out.where("degree is not null or was is not null").select("node", "degree")


def apply_node_ops(nodes: DataFrame, diff: DataFrame) -> DataFrame:
    """nodes after (node, degree) diffs; a node twice in one diff is an error, deletes of unknown nodes are ignored."""
    if not diff.groupBy("node").count().where("count > 1").isEmpty():
        raise IndexFailure("a node occurs twice in one batch of node ops")
    both = nodes.select("node", F.col("degree").alias("was")).join(diff.withColumn("touched", F.lit(True)), "node", "full_outer")
    return both.select("node", F.when(F.col("touched"), F.col("degree")).otherwise(F.col("was")).alias("degree")).where("degree is not null")
