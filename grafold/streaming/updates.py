"""Op logs as streams: every micro-batch adds a small delta to the edge table, merged on read and compacted.

The table is a base and the deltas since: ``base/v=<batch>`` holds the state after that batch, ``delta/v=<batch>``
the last write of each pair in one batch, ``rejected/v=<batch>`` its invalid ops with their reason. A batch
that is run again after a failure overwrites its own folders, so ops are applied exactly once. Every
``compact_every`` batches the state is written as a new base; the base before it is kept for readers, what
is older is removed.

What becomes of an invalid op does not depend on how files fall into batches: with ``on_invalid`` "reject"
it is recorded as rejected and all other ops are applied; with "fail" the ops before it are applied, it and
the rest of its batch are recorded, and the query fails with its reason.

Arrival order is the order of batches, ``seq`` the order within one; with ``newest_only`` an op that is older
(by seq) than the last one seen of its pair is dropped instead, whatever the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grafold.functions.errors import InvalidConfig
from grafold.operators.components import cut
from grafold.operators.updates import OPS, canonical, first_invalid, judged, raise_invalid

_STATE = "src long, dst long, weight double, seq long"
_REJECTED = OPS + ", reason string"


class EdgeTable:
    """The edge table below a folder all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, newest_only: bool = False, on_invalid: str = "reject", compact_every: int = 16):
        if on_invalid not in ("reject", "fail"):
            raise InvalidConfig("on_invalid must be 'reject' or 'fail'")
        if compact_every < 1:
            raise InvalidConfig("compact_every must be above zero")
        self.spark, self.folder, self.newest_only, self.on_invalid, self.compact_every = spark, folder.rstrip("/"), newest_only, on_invalid, compact_every

    def _path(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/v={version}"

    def _versions(self, kind: str) -> list[int]:
        """The finished versions of a kind of folder, rising. There are at most two bases, and as many deltas as
        two compactions span."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _remove(self, kind: str, version: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, version))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def version(self, version: int) -> DataFrame:
        """The state after a batch: live edges and, with newest_only, the tombstones (weight null)."""
        bases = [v for v in self._versions("base") if v <= version]
        base = bases[-1] if bases else -1
        parts = [(base, "base")] if bases else []
        parts += [(v, "delta") for v in self._versions("delta") if base < v <= version]
        if not parts:
            return self.spark.createDataFrame([], _STATE)
        out = None
        for v, kind in parts:
            part = self.spark.read.schema(_STATE).parquet(self._path(kind, v)).withColumn("v", F.lit(v))
            out = part if out is None else out.unionByName(part)
        order = F.struct("seq", "v") if self.newest_only else F.col("v")
        state = out.groupBy("src", "dst").agg(F.max_by(F.struct("weight", "seq"), order).alias("x")).select("src", "dst", "x.*")
        return state if self.newest_only else state.where("weight is not null")

    def latest(self) -> int:
        return max([*self._versions("base"), *self._versions("delta")], default=-1)

    def edges(self, version: int | None = None) -> DataFrame:
        return self.version(self.latest() if version is None else version).where("weight is not null").select("src", "dst", "weight")

    def rejected(self) -> DataFrame:
        """(seq, u, v, weight, reason, batch): the ops that were not applied; reason "after" for those behind an
        invalid one that failed the query."""
        out = self.spark.createDataFrame([], _REJECTED + ", batch int")
        for v in self._versions("rejected"):
            out = out.unionByName(self.spark.read.schema(_REJECTED).parquet(self._path("rejected", v)).withColumn("batch", F.lit(v)))
        return out

    def apply(self, ops: DataFrame, batch_id: int) -> None:
        """Adds one micro-batch; for foreachBatch."""
        ops = cut(judged(ops.select("seq", "u", "v", "weight")))
        bad = None
        if self.on_invalid == "fail" and (bad := first_invalid(ops.drop("reason")).first()) is not None:
            ops = cut(ops.withColumn("reason", F.when(F.col("seq") >= bad["seq"], F.coalesce("reason", F.lit("after")))))
        out = ops.where("reason is not null")
        if not out.isEmpty():
            out.write.mode("overwrite").parquet(self._path("rejected", batch_id))
        new = canonical(ops.where("reason is null")).groupBy("src", "dst").agg(F.max_by(F.struct("weight", "seq"), "seq").alias("x")).select("src", "dst", "x.*")
        new.write.mode("overwrite").parquet(self._path("delta", batch_id))
        if (batch_id + 1) % self.compact_every == 0:
            self._compact(batch_id)
        raise_invalid(bad)

    def _compact(self, version: int) -> None:
        before = [v for v in self._versions("base") if v < version]
        self.version(version).write.mode("overwrite").parquet(self._path("base", version))
        for v in before[:-1]:
            self._remove("base", v)
        for v in self._versions("delta"):
            if before and v <= before[-1]:
                self._remove("delta", v)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def read_op_stream(spark: SparkSession, folder: str, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of op files (seq, u, v, weight)."""
    return spark.readStream.format(fmt).schema(OPS).options(**options).load(folder)
