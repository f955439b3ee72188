"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``. ``run`` writes each stage as Parquet in the shared
folder and reads it again for the next, so an executor lost later costs no earlier stage.

Results on odd input are those of the operators: documents without letters (null and empty texts too)
are not accepted by language ID; repeated rows of one doc_id go through the stages as rows, and the
near-duplicate stage keeps those of the doc_id that stays; rows of null doc_id are one document to the
stages that compare documents; very long texts go through whole; extra columns, whatever their names, are
carried to the last stage; an empty table gives an empty result.

Texts go to Python in batches of ``BATCH_ROWS`` at most, which a worker's memory follows: a stage sets that
for its session, where a larger number stands, as the batches are cut when its rows are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafold.llm import decontaminate, jaccard_join, language_id, line_dedup, piece_codec
from grafold.operators.components import shared_folder


#: Rows of a batch that goes to Python; Spark's own number is 10,000, of any length.
BATCH_ROWS = 1_000


def _short_batches(spark: SparkSession) -> None:
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those that no learned language explains."""
    _short_batches(spark)
    return language_id.accepted(docs, language_id.train(docs))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rewrites texts without the lines that many documents share; n_chars follows."""
    _short_batches(spark)
    kept = line_dedup.dedup_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, 0.8) the document of smallest doc_id."""
    _short_batches(spark)
    groups = jaccard_join.jaccard_groups(docs, 5, 8, 10).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(groups, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    _short_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes whole texts; (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    _short_batches(spark)
    return piece_codec.encode_digests(docs, piece_codec.default_model())


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("encode", stage_encode),
]

#: Language ID, tiling and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` and returns the last one's rows."""
    shared = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
