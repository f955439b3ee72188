"""Line dedup over levelled sorted runs of line hashes.

Method
------
``LineRuns`` keeps, under one path, runs of (key hash, documents, largest doc_id) as tables bucketed and
sorted by hash; every hash is in exactly one run. A batch of documents is aggregated to one row for each
hash, written in the same buckets, and merged with each run, bucket by bucket and without a shuffle: hashes
that no run holds become the batch's own run at level 0 (anti-join), those held are added to the run that
holds them as an overlay, which reading sums. When a level has ``FANOUT`` runs they are compacted with
their overlays to one sorted run of the next level, so a hash is rewritten only log(batches) times. A
manifest, to which each batch appends one version, names the tables, so the runs can be opened again and
the next batch added; a version that was not finished is not seen.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; only keys of at least
``min_chars`` code points count. Keys are compared by 128-bit hash. Keys found in at least ``min_docs``
documents lose all their lines, except in the largest doc_id that holds them. Documents are read twice:
once for the keys, once to be rewritten, joined by doc_id with their own keys to drop.

Results on odd input: null or empty text is one empty line and stays, as empty text; a very long text is
read whole, line by line; of a repeated line all places go, and the largest doc_id keeps all of its own; rows that repeat a doc_id count as
one document for the number of documents and are each rewritten; extra columns are kept by ``dedup_lines``;
an empty table gives an empty result; rows of null doc_id are one document, the smallest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafold.operators.components import cut, shared_folder

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 4
_WHITE = b" \t\n\x0b\x0c\r"
_RUN = "hi long, lo long, n_docs long, last long"
_MANIFEST = "version int, buckets int, level int, run int, part int, table string"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, None if it is too short."""
    key = line.strip(_WHITE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if text:
                    found = {k for x in text.split(b"\n") if len(x) >= min_chars and (k := _key(x, min_chars))}
                    docs += [doc] * len(found)
                    keys += found
            raw = pa.py_buffer(b"".join(keys))
            both = pa.Array.from_buffers(pa.int64(), 2 * len(keys), [None, raw]).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(both[0::2]), pa.array(both[1::2])], ["doc_id", "hi", "lo"])

    return run


def _rewrite(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                n, dropped, out = [], [], []
                for text, gone in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("gone").to_pylist(), strict=True):
                    text = text or b""
                    lines = text.count(b"\n") + 1
                    kept = text
                    if gone:
                        gone = {x["hi"].to_bytes(8, "little", signed=True) + x["lo"].to_bytes(8, "little", signed=True) for x in gone}
                        stay = [x for x in text.split(b"\n") if len(x) < min_chars or _key(x, min_chars) not in gone]
                        dropped.append(lines - len(stay))
                        kept = b"\n".join(stay)
                    else:
                        dropped.append(0)
                    n.append(lines)
                    out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                columns = [part.column(c) for c in part.schema.names if c not in ("text", "gone")]
                names = [c for c in part.schema.names if c not in ("text", "gone")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], [*names, "n_lines", "n_dropped", "kept"])

    return run


class LineRuns:
    """The levelled runs under ``path``. ``levels[i]`` lists the runs of level i; a run is a list of table
    names, the sorted table and its overlays. An existing manifest is opened."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout, self.version = spark, path.rstrip("/"), fanout, 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[list[str]]] = [[]]
        try:
            manifest = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        for r in manifest.where(F.col("version") == manifest.agg(F.max("version")).first()[0]).orderBy("level", "run", "part").collect():
            self.version, self.buckets = r["version"], r["buckets"]
            while len(self.levels) <= r["level"]:
                self.levels.append([])
            level = self.levels[r["level"]]
            if len(level) <= r["run"]:
                level.append([])
            level[r["run"]].append(r["table"])
            spark.sql(f"CREATE TABLE IF NOT EXISTS {r['table']} ({_RUN}) USING parquet CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{r['table']}'")

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows = df.select("hi", "lo", "n_docs", "last").repartition(self.buckets, "hi", "lo").sortWithinPartitions("hi", "lo")
        rows.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _sum(self, names: list[str]) -> DataFrame:
        # Read as files: a union of bucketed scans may claim a partitioning that the planner takes back from them.
        out = self.spark.read.schema(_RUN).parquet(*(f"{self.path}/{name}" for name in names))
        return out.groupBy("hi", "lo").agg(F.sum("n_docs").alias("n_docs"), F.max("last").alias("last")) if len(names) > 1 else out

    def add(self, batch: DataFrame) -> None:
        """batch(hi, lo, n_docs, last), a row for each hash of documents that no other batch has."""
        new = self.spark.table(self._write(batch))
        for level in self.levels:
            for run in level:
                held = self.spark.table(run[0]).select("hi", "lo")
                run.append(self._write(new.join(held, ["hi", "lo"], "left_semi")))
                new = new.join(held, ["hi", "lo"], "left_anti")
        self.levels[0].append([self._write(new)])
        self._compact()
        self._record()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                # Hashes of different runs are different, so only a run's own overlays are summed.
                self.levels[i + 1].append([self._write(self._sum([t for run in level for t in run]))])
                self.levels[i] = []

    def _record(self) -> None:
        self.version += 1
        rows = [(self.version, self.buckets, i, j, k, name) for i, level in enumerate(self.levels) for j, run in enumerate(level) for k, name in enumerate(run)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def all(self) -> DataFrame:
        """Every hash once: (hi, lo, n_docs, last)."""
        return self._sum([t for level in self.levels for run in level for t in run])


def _drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(doc_id, gone): for each document that loses lines, the keys of these."""
    spark = docs.sparkSession
    keys = cut(docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text").mapInArrow(_keys(min_chars), "doc_id long, hi long, lo long"))
    runs = LineRuns(spark, f"{shared_folder(spark)}/line-runs-{uuid.uuid4().hex}")
    for b in range(batches):
        part = keys.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)
        runs.add(part.groupBy("hi", "lo").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last")))
    hot = runs.all().where(F.col("n_docs") >= min_docs).select("hi", "lo", "last")
    lose = keys.join(hot, ["hi", "lo"]).where("doc_id <> last")
    return lose.groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> its columns with text rewritten, and n_lines, n_dropped; with ``digest``
    (doc_id, n_lines, n_dropped, kept_sha256) instead."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest if not digest)).alias("row")  # names inside cannot clash
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    gone = _drops(base.select("doc_id", "text"), min_chars, min_docs, batches).withColumnRenamed("doc_id", "of")
    joined = base.join(gone, F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("of"), "left").select("doc_id", "row", "text", "gone")
    inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in base.schema["row"].dataType)
    out = joined.mapInArrow(_rewrite(min_chars, digest), f"doc_id long, row struct<{inner}>, n_lines long, n_dropped long, kept string")
    if digest:
        return out.select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))
    named = {"doc_id": F.col("doc_id"), "text": F.col("kept").alias("text")}
    extra = [c for c in ("n_lines", "n_dropped") if c not in docs.columns]
    return out.select(*(named.get(c, F.col(f"row.`{c}`")) for c in docs.columns), *extra)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


#: DuckDB. Its trim takes a set of characters; translate lower-cases A-Z alone.
OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.last AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
