"""Look-ups of nodes in the edge table: equi-joins, whose physical form is left to the optimiser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure
from grafold.operators.updates import degrees, symmetric


def require_live(batch: DataFrame, edges: DataFrame, column: str = "node") -> None:
    """IndexFailure if a node of the batch has no edge."""
    live = symmetric(edges).select(F.col("src").alias(column))
    lost = batch.select(column).distinct().join(live, column, "left_anti").first()
    if lost is not None:
        raise IndexFailure(f"unknown node {lost[0]}")


def _known(found: Column, node: str) -> Column:
    """True, or a failure of the query that names the node."""
    return F.when(found, True).otherwise(F.raise_error(F.format_string("unknown node %s", F.coalesce(F.col(node).cast("string"), F.lit("null")))).cast("boolean"))


def neighbourhoods(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """batch(pos, node) -> (pos, node, dst, weight), all neighbours of each position. A node without an edge is
    unknown and fails the query."""
    sides = symmetric(edges).select("src", "dst", "weight", F.rand().isNotNull().alias("found"))  # not folded away
    both = batch.select("pos", "node").join(sides, F.col("node") == F.col("src"), "left")
    return both.where(_known(F.coalesce("found", F.lit(False)), "node")).select("pos", "node", "dst", "weight")


def neighbours_of(edges: DataFrame, node: int) -> DataFrame:
    """(dst, weight) of one node; no rows for one without an edge. Reads its edges only."""
    mine = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return mine.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("dst"), "weight")


def intersecting(sources: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of the sources(pos, node) that are among targets(ord, node), with the first ordinal of each.
    An unknown source fails the query; targets may be unknown."""
    t = targets.groupBy(F.col("node").alias("dst")).agg(F.min("ord").alias("ord"))
    return neighbourhoods(sources, edges).join(t, "dst").select("pos", "node", "dst", "ord", "weight")


def induced(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """The subgraph on batch(pos, node): (pos, node, dst, ord, weight) with ordinals of both ends."""
    return intersecting(batch, batch.select(F.col("pos").alias("ord"), "node"), edges)


def fold(batch: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """What a visit of the matched edges sums up: (node, matched, total), without keeping the rows."""
    return visit(batch, targets, edges, F.count("*").alias("matched"), F.sum("weight").alias("total"))


def visit(batch: DataFrame, targets: DataFrame, edges: DataFrame, *folds: Column) -> DataFrame:
    """Any aggregates of the caller over the matched edges (pos, node, dst, ord, weight) of each node."""
    return intersecting(batch, targets, edges).groupBy("node").agg(*folds)


def size_volume(nodes: DataFrame) -> DataFrame:
    """One row (size, volume): the number of nodes and the sum of their degrees."""
    return nodes.agg(F.count("*").alias("size"), F.coalesce(F.sum("degree"), F.lit(0.0)).alias("volume"))


def as_rows(hoods: DataFrame) -> DataFrame:
    """One row for each position with its neighbours as a sorted array."""
    return hoods.groupBy("pos", "node").agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))


def edge_weight(edges: DataFrame, u: int, v: int) -> float | None:
    row = edges.where((F.col("src") == min(u, v)) & (F.col("dst") == max(u, v))).first()
    return None if row is None else row["weight"]


def degree(edges: DataFrame, node: int) -> float | None:
    """Reads one node's edges only."""
    row = edges.where((F.col("src") == node) | (F.col("dst") == node)).agg(F.sum("weight").alias("d")).first()
    return row["d"]


def live_nodes(edges: DataFrame) -> DataFrame:
    return symmetric(edges).select(F.col("src").alias("node")).distinct().orderBy("node")


def max_degree_node(nodes: DataFrame) -> DataFrame:
    """(node, degree) of the largest degree, of equal ones the smallest id. One aggregate."""
    return nodes.agg(F.max(F.struct("degree", (-F.col("node")).alias("m"), "node")).alias("x")).where("x is not null").select("x.node", "x.degree")


__all__ = ["as_rows", "degree", "degrees", "edge_weight", "fold", "induced", "intersecting", "live_nodes", "max_degree_node", "neighbourhoods", "neighbours_of", "require_live", "size_volume", "visit"]
