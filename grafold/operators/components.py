"""Connected components of a table of links, by hook and contract rounds; reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local master gets a folder of its own, as in tests; a cluster
    must name one that all its machines reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Spark's switch for the deletion of a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, freed: bool = False) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder. The shuffle files behind it stay until the
    driver collects garbage, or are freed at once."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    if not freed:
        return df.checkpoint(eager=True)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # Spark reads the switch when it makes a frame
    finally:
        spark.conf.set(CLEANUP, before)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of any comparable ids, in any direction, repeated or not -> (id, root): the smallest
    id of its component for every id that occurs. Rows with a null end are ignored; no rows give none.

    Each round hooks every vertex onto its smallest smaller neighbour (ids fall along a chain, so there
    are no cycles), jumps pointers, and rewrites the links onto the parents; links inside a tree vanish.
    Only the links shrink from round to round, and a hub costs one partial aggregate, never a list.
    """
    links = links.select("a", "b").where("a is not null and b is not null")
    seen = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    falling = lambda e: cut(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = falling(links)
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
        jump = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.id"), "left")
        parent = cut(jump.select(F.col("x.id").alias("p_id"), F.coalesce("y.to", "x.to").alias("p_to")))
        parents.append(parent)
        for end in ("a", "b"):
            edges = edges.join(parent, F.col(end) == F.col("p_id"), "left").withColumn(end, F.coalesce("p_to", end)).select("a", "b")
        edges = falling(edges)
    out = seen.select("id", F.col("id").alias("root"))
    for parent in parents:
        out = out.join(parent, F.col("root") == F.col("p_id"), "left").select("id", F.coalesce("p_to", "root").alias("root"))
    return out
