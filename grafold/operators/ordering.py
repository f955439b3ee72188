"""Running sums over a whole table in two levels, so no task sees more than one range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafold.operators.components import cut


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The table dealt out by ranges of its order, checkpointed, with ``block``, the number of the range."""
    return cut(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Adds to each row, for every name in ``sums``, the sum of the column named there up to and with it. Rows
    of equal order are summed in any order."""
    dealt = ranges(df, *order)
    upto = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = dealt.groupBy("block").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    totals = totals.select("block", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    out = dealt.withColumns({name: F.sum(c).over(upto) for name, c in sums.items()}).join(totals, "block")
    return out.select(*df.columns, *((F.col(name) + F.col(f"_{name}")).alias(name) for name in sums))
