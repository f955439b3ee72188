"""Graphs and op logs out of tables and files; any source that Spark reads with these columns will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafold.operators.updates import OPS


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_ops(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An op log (seq, u, v, weight) from files with a fixed schema."""
    return spark.read.format(fmt).schema(OPS).load(path) if fmt != "csv" else spark.read.schema(OPS).option("header", True).csv(path)


def ops_of(spark: SparkSession, updates: list[tuple[int, int, float | None]]) -> DataFrame:
    """An op log from tuples in order; None deletes."""
    return spark.createDataFrame([(i, u, v, None if w is None else float(w)) for i, (u, v, w) in enumerate(updates)], OPS)


def part_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """edges(src, dst, weight): parts (even ids) and suppliers (odd ids) by their number of line items."""
    u, v = F.col("l_partkey") * 2, F.col("l_suppkey") * 2 + 1
    return read_table(spark, folder, "lineitem").groupBy(F.least(u, v).alias("src"), F.greatest(u, v).alias("dst")).agg(F.count("*").cast("double").alias("weight"))


def co_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """edges(src, dst, weight): parts ordered together, by the number of orders."""
    item = read_table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = item.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return item.select("l_orderkey", F.col("l_partkey").alias("src")).join(other, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def event_ops(spark: SparkSession, folder: str) -> DataFrame:
    """ops(seq, u, v, weight) from events: a user and the key of its props; errors delete."""
    e = read_table(spark, folder, "events")
    key = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("u"), (F.lit(1_000_000) + key).alias("v"), F.when(F.col("event_type") != "error", F.col("value")).alias("weight"))
