"""External node ids of any kind (text, numbers, ...) as dense whole numbers, in a dictionary table.

dictionary(name, node): ``name`` is the id as text with its type before it, so 1 and "1" differ. Ids are
looked up and brought back by joins at the edges of the API; the graph itself holds numbers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure, InvalidInput
from grafold.operators.ordering import running

NAMES = "name string, node long"


def empty_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NAMES)


def name_of(table: DataFrame, column: str) -> Column:
    """An external id with its type."""
    kind = dict(table.dtypes)[column]
    kind = "long" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def intern(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """The dictionary with every name of wanted(name); new ones are numbered on, in order of names."""
    new = wanted.where("name is not null").select("name").distinct().join(names, "name", "left_anti")
    last = names.agg(F.coalesce(F.max("node"), F.lit(-1)).alias("last"))
    numbered = running(new.withColumn("one", F.lit(1).cast("long")), ["name"], {"k": "one"})
    return names.select("name", "node").unionByName(numbered.join(last).select("name", (F.col("k") + F.col("last")).alias("node")))


def release(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """The dictionary without the names of nodes that are no more; their numbers are not used again."""
    return names.join(nodes.select("node"), "node", "left_semi").select("name", "node")


def inside(ops: DataFrame, names: DataFrame) -> DataFrame:
    """ops(seq, a, b, weight) of names -> ops(seq, u, v, weight) of numbers. Deletes of an unknown name are
    left out: there is nothing to delete, and a delete gives no number."""
    u, v = names.select(F.col("name").alias("a"), F.col("node").alias("u")), names.select(F.col("name").alias("b"), F.col("node").alias("v"))
    both = ops.join(u, "a", "left").join(v, "b", "left")
    return both.where("weight is not null or (u is not null and v is not null)").select("seq", "u", "v", "weight")


def look_up(batch: DataFrame, names: DataFrame) -> DataFrame:
    """batch(name, ...) -> its columns and node; IndexFailure if a name is unknown."""
    lost = batch.select("name").join(names, "name", "left_anti").first()
    if lost is not None:
        raise IndexFailure(f"unknown node {lost['name']}")
    return batch.join(names, "name")


class NamedIndex:
    """A GraphIndex whose nodes have external ids. Ops are tables (seq, u, v, weight) or tuples in order; the
    ids of one call are of one kind."""

    def __init__(self, index, names: DataFrame | None = None):
        from grafold.operators.components import cut

        self.index, self._cut = index, cut
        self.names = empty_names(index.spark) if names is None else names

    def _ops(self, ops: DataFrame | list) -> DataFrame:
        if isinstance(ops, list):
            kind = {type(x) for op in ops for x in op[:2]}
            if len(kind) > 1:
                raise InvalidInput("the ids of one call must be of one kind")
            of = {int: "long", float: "double"}.get(kind.pop() if kind else str, "string")
            ops = self.index.spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], f"seq long, u {of}, v {of}, weight double")
        return ops.select("seq", name_of(ops, "u").alias("a"), name_of(ops, "v").alias("b"), F.col("weight").cast("double").alias("weight"))

    def update_edges(self, ops: DataFrame | list):
        """As the index's own; deletes of unknown ids count as missing."""
        ops = self._cut(self._ops(ops))
        if (loop := ops.where("a is null or b is null").first()) is not None:
            raise InvalidInput(f"op {loop['seq']}: a node id is null")
        written = ops.where("weight is not null")
        self.names = self._cut(intern(self.names, written.select(F.col("a").alias("name")).union(written.select("b"))))
        known = self._cut(inside(ops, self.names))
        stats = self.index.update_edges(known)
        lost = ops.count() - known.count()
        return type(stats)(stats.total + lost, stats.set, stats.deleted, stats.missing_deletes + lost)

    def release(self) -> None:
        """Forgets the ids of nodes without an edge."""
        self.names = self._cut(release(self.names, self.index.nodes))

    def _table(self, nodes: DataFrame | list) -> DataFrame:
        if isinstance(nodes, list):
            kind = {int: "long", float: "double"}.get(type(nodes[0]) if nodes else str, "string")
            nodes = self.index.spark.createDataFrame(list(enumerate(nodes)), f"pos int, node {kind}")
        return look_up(nodes.select("pos", F.col("node").alias("id"), name_of(nodes, "node").alias("name")), self.names)

    def query(self, nodes: DataFrame | list):
        """As the index's own on nodes(pos, node); labels(pos, node, label) hold the external ids."""
        table = self._cut(self._table(nodes))
        found = self.index.query(table.select("pos", "node"))
        found.labels = found.labels.join(table.select("pos", "id"), "pos").select("pos", F.col("id").alias("node"), "label")
        return found

    def score_pairs(self, pairs: DataFrame | list, **how) -> DataFrame:
        """pairs(u, v) of external ids -> with score."""
        if isinstance(pairs, list):
            kind = {int: "long", float: "double"}.get(type(pairs[0][0]) if pairs else str, "string")
            pairs = self.index.spark.createDataFrame(pairs, f"u {kind}, v {kind}")
        named = pairs.withColumns({"_u": name_of(pairs, "u"), "_v": name_of(pairs, "v")})
        ends = look_up(look_up(named.withColumnRenamed("_u", "name"), self.names).withColumnRenamed("node", "nu").drop("name").withColumnRenamed("_v", "name"), self.names)
        ends = self._cut(ends.withColumnRenamed("node", "nv").drop("name"))
        scored = self.index.score_pairs(ends.select(F.col("nu").alias("u"), F.col("nv").alias("v")).distinct(), **how)
        return ends.join(scored.select(F.col("u").alias("nu"), F.col("v").alias("nv"), "score"), ["nu", "nv"]).select("u", "v", "score")
