"""Every query of the engine by name, with the SQL that checks it.

Graph: parts and suppliers by their line items, whole. Op log: all events. Sampler queries use three
trials of two seeds (which SQL can follow) and 256 draws; where Leiden would label, SQL needs a stand-in,
a hash of (trial, node).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafold.functions.scalars import hash_long, trial_seed, uniform
from grafold.operators import community, consensus, coreset, metrics, neighbours, projection, sampling, updates
from grafold.operators.components import cut, shared_folder
from grafold.operators.ordering import running
from grafold.plans.index import GraphIndex, IndexConfig
from grafold.sources import sbm, tables

SEED, TRIALS, SIZE, SIGMA, LABELS = 42, 3, 256, 1000.0, 64

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _u(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


def _h(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT)"


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds doubles, whose last digits depend on the order of summation."""
    return df.withColumns({c: F.round(c, digits) for c in names})


# Graph

EDGES = """
WITH RECURSIVE e AS (
  SELECT least(u, v) AS src, greatest(u, v) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM (SELECT 2 * l_partkey AS u, 2 * l_suppkey + 1 AS v FROM lineitem) GROUP BY 1, 2
), s AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e
), n AS (SELECT src AS node, sum(weight) AS degree FROM s GROUP BY 1)
"""


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    return tables.part_supplier(spark, sf)


@query(EDGES + "SELECT * FROM e")
def edges(spark, sf):
    return _graph(spark, sf)


@query(EDGES + "SELECT node, degree FROM n")
def weighted_degree(spark, sf):
    return updates.degrees(_graph(spark, sf))


@query(EDGES + "SELECT node FROM n")
def live_nodes(spark, sf):
    return neighbours.live_nodes(_graph(spark, sf))


@query(EDGES + "SELECT node, degree FROM n ORDER BY degree DESC, node LIMIT 1")
def max_degree_node(spark, sf):
    return neighbours.max_degree_node(updates.degrees(_graph(spark, sf)))


@query(EDGES + "SELECT count(*) AS size, sum(degree) AS volume FROM n")
def size_volume(spark, sf):
    return neighbours.size_volume(updates.degrees(_graph(spark, sf)))


@query(EDGES + "SELECT node AS pos, node, dst, weight FROM n JOIN s ON s.src = n.node")
def neighbourhoods(spark, sf):
    g = _graph(spark, sf)
    return neighbours.neighbourhoods(neighbours.live_nodes(g).withColumn("pos", F.col("node")), g)


_TARGETS = EDGES + ", t AS (SELECT s_suppkey AS ord, 2 * s_suppkey + 1 AS node FROM supplier UNION ALL SELECT s_suppkey + 7, 2 * s_suppkey + 1 FROM supplier WHERE s_nationkey < 5)"


def _targets(spark, sf) -> DataFrame:
    s = tables.read_table(spark, sf, "supplier")
    node = (2 * F.col("s_suppkey") + 1).alias("node")
    return s.select(F.col("s_suppkey").alias("ord"), node).unionByName(s.where("s_nationkey < 5").select((F.col("s_suppkey") + 7).alias("ord"), node))


@query(_TARGETS + "SELECT n.node AS pos, n.node, s.dst, m.ord, s.weight FROM n JOIN s ON s.src = n.node JOIN (SELECT node, min(ord) AS ord FROM t GROUP BY 1) m ON m.node = s.dst")
def intersecting_neighbourhoods(spark, sf):
    g = _graph(spark, sf)
    return neighbours.intersecting(neighbours.live_nodes(g).withColumn("pos", F.col("node")), _targets(spark, sf), g)


@query(_TARGETS + "SELECT s.src AS node, count(*) AS matched, sum(s.weight) AS total FROM s WHERE s.dst IN (SELECT node FROM t) GROUP BY 1")
def neighbourhood_fold(spark, sf):
    g = _graph(spark, sf)
    return neighbours.fold(neighbours.live_nodes(g).withColumn("pos", F.col("node")), _targets(spark, sf), g)


_INDUCED = EDGES + ", b AS (SELECT DISTINCT src AS pos, src AS node FROM s WHERE weight >= 2)"


@query(_INDUCED + "SELECT a.pos, a.node, s.dst, b.pos AS ord, s.weight FROM b a JOIN s ON s.src = a.node JOIN b ON b.node = s.dst")
def coreset_neighbourhoods(spark, sf):
    g = _graph(spark, sf)
    strong = neighbours.live_nodes(g.where("weight >= 2"))
    return neighbours.induced(strong.select(F.col("node").alias("pos"), "node"), g)


# Op log

OPS = """
WITH ops AS (
  SELECT event_id AS seq, user_id AS u, 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS v,
    CASE WHEN event_type <> 'error' THEN value END AS weight FROM events
), stop AS (SELECT min(seq) AS stop FROM ops WHERE weight <= 0 OR isnan(weight) OR isinf(weight)
), good AS (SELECT seq, least(u, v) AS src, greatest(u, v) AS dst, weight FROM ops, stop WHERE stop IS NULL OR seq < stop
), early AS (SELECT * FROM good WHERE seq < (SELECT max(seq) / 2 FROM ops)
), later AS (SELECT * FROM good WHERE seq >= (SELECT max(seq) / 2 FROM ops)
), e0 AS (SELECT src, dst, arg_max(weight, seq) AS weight FROM (SELECT src, dst, seq, row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC) AS k, weight FROM early) WHERE k = 1 AND weight IS NOT NULL GROUP BY 1, 2
), e1 AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC) AS k FROM good) WHERE k = 1 AND weight IS NOT NULL)
"""


def _log(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(the first half of the valid ops, the second)."""
    ops = updates.valid_prefix(tables.event_ops(spark, sf))
    half = tables.read_table(spark, sf, "events").agg((F.max("event_id") / 2).alias("half"))
    ops = cut(ops.join(F.broadcast(half)))  # one row
    return ops.where("seq < half").drop("half"), ops.where("seq >= half").drop("half")


@query(OPS + "SELECT * FROM e1")
def edge_merge_lww(spark, sf):
    first, second = _log(spark, sf)
    return updates.merge(updates.merge(updates.empty_edges(spark), first), second)


@query(
    OPS
    + """, judged AS (
  SELECT l.*, coalesce(lag(l.weight IS NOT NULL) OVER (PARTITION BY l.src, l.dst ORDER BY l.seq), e0.src IS NOT NULL) AS existed
  FROM later l LEFT JOIN e0 ON e0.src = l.src AND e0.dst = l.dst)
SELECT count(*) AS total, count(*) FILTER (WHERE weight IS NOT NULL) AS "set",
  count(*) FILTER (WHERE weight IS NULL AND existed) AS deleted, count(*) FILTER (WHERE weight IS NULL AND NOT existed) AS missing_deletes FROM judged"""
)
def edge_update_stats(spark, sf):
    first, second = _log(spark, sf)
    return updates.update_stats(updates.merge(updates.empty_edges(spark), first), second)


@query(
    OPS
    + """, s0 AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0), s1 AS (SELECT src, dst, weight FROM e1 UNION ALL SELECT dst, src, weight FROM e1),
touched AS (SELECT src AS node FROM later UNION SELECT dst FROM later)
SELECT t.node, round(d.degree, 6) AS degree FROM touched t LEFT JOIN (SELECT src, sum(weight) AS degree FROM s1 GROUP BY 1) d ON d.src = t.node
WHERE d.src IS NOT NULL OR t.node IN (SELECT src FROM s0)"""
)
def node_ops_diff(spark, sf):
    first, second = _log(spark, sf)
    before = cut(updates.merge(updates.empty_edges(spark), first))
    return _r(updates.node_ops(before, updates.merge(before, second), second), "degree")


@query(OPS + ", s1 AS (SELECT src, dst, weight FROM e1 UNION ALL SELECT dst, src, weight FROM e1) SELECT src AS node, round(sum(weight), 6) AS degree FROM s1 GROUP BY 1")
def node_ops_applied(spark, sf):
    first, second = _log(spark, sf)
    before = cut(updates.merge(updates.empty_edges(spark), first))
    after = cut(updates.merge(before, second))
    return _r(updates.apply_node_ops(updates.degrees(before), updates.node_ops(before, after, second)), "degree")


@query("SELECT min(event_id) AS seq, 'weight' AS reason FROM events WHERE event_type <> 'error' AND (value <= 0 OR isnan(value) OR isinf(value)) HAVING min(event_id) IS NOT NULL")
def prefix_abort(spark, sf):
    return updates.first_invalid(tables.event_ops(spark, sf))


BROKEN = """
WITH last AS (SELECT max(event_id) AS last FROM events
), ops AS (
  SELECT event_id AS seq, user_id AS u, CASE WHEN event_id = last // 8 * 7 THEN user_id ELSE 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) END AS v,
    CASE WHEN event_id = last // 4 * 3 THEN -value WHEN event_id > last // 4 * 3 AND event_id % 100 = 0 THEN 'nan'::DOUBLE WHEN event_type <> 'error' THEN value END AS weight FROM events, last
), judged AS (SELECT *, CASE WHEN u = v THEN 'loop' WHEN weight <= 0 OR isnan(weight) OR isinf(weight) THEN 'weight' END AS reason FROM ops
)
"""


def _broken(spark, sf) -> DataFrame:
    """All events as ops, with a negative weight after three quarters and NaN weights and a loop later."""
    ops = tables.event_ops(spark, sf)
    last = tables.read_table(spark, sf, "events").agg(F.max("event_id").alias("last"))
    ops = ops.join(F.broadcast(last))  # one row
    at = lambda part, of: F.floor(F.col("last") / of) * part
    value = tables.read_table(spark, sf, "events").select(F.col("event_id").alias("seq"), "value")
    weight = F.when(F.col("seq") == at(3, 4), -F.col("value")).when((F.col("seq") > at(3, 4)) & (F.col("seq") % 100 == 0), float("nan")).otherwise(F.col("weight"))
    return cut(ops.join(value, "seq").select("seq", "u", F.when(F.col("seq") == at(7, 8), F.col("u")).otherwise(F.col("v")).alias("v"), weight.alias("weight")))


@query(BROKEN + "SELECT min(seq) AS seq, arg_min(reason, seq) AS reason FROM judged WHERE reason IS NOT NULL")
def first_invalid_op(spark, sf):
    return updates.first_invalid(_broken(spark, sf))


@query(BROKEN + "SELECT least(u, v) AS src, greatest(u, v) AS dst, arg_max(struct_pack(w := weight), seq).w AS weight FROM ops WHERE seq < (SELECT min(seq) FROM judged WHERE reason IS NOT NULL) GROUP BY 1, 2 HAVING arg_max(struct_pack(w := weight), seq).w IS NOT NULL")
def prefix_merge(spark, sf):
    """The edges that the ops before the first invalid one leave."""
    return updates.merge(updates.empty_edges(spark), updates.valid_prefix(_broken(spark, sf)))


def _streamed(spark, sf):
    from grafold.streaming.updates import EdgeTable, read_op_stream

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ops = _broken(spark, sf)
    for part in range(4):
        ops.where(F.col("seq") % 4 == part).coalesce(1).write.mode("append").parquet(f"{folder}/ops")
    table = EdgeTable(spark, f"{folder}/edges", newest_only=True, compact_every=3)
    table.start(read_op_stream(spark, f"{folder}/ops", maxFilesPerTrigger=1), f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return table


@query(BROKEN + "SELECT least(u, v) AS src, greatest(u, v) AS dst, arg_max(struct_pack(w := weight), seq).w AS weight FROM judged WHERE reason IS NULL GROUP BY 1, 2 HAVING arg_max(struct_pack(w := weight), seq).w IS NOT NULL")
def streaming_valid_ops(spark, sf):
    """A stream with invalid ops: all others are applied, whatever the files."""
    return _streamed(spark, sf).edges()


@query(BROKEN + "SELECT seq, reason FROM judged WHERE reason IS NOT NULL")
def streaming_rejected_ops(spark, sf):
    return _streamed(spark, sf).rejected().select("seq", "reason")


@query(OPS + "SELECT * FROM e1")
def streaming_merge(spark, sf):
    """The op log as a stream of files, merged batch by batch."""
    from grafold.streaming.updates import EdgeTable, read_op_stream

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in _log(spark, sf):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/ops")
    table = EdgeTable(spark, f"{folder}/edges", newest_only=True)
    table.start(read_op_stream(spark, f"{folder}/ops", maxFilesPerTrigger=1), f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return table.edges()


# Sampler

_T = ", ".join(f"({t}, '{trial_seed(SEED, t)}')" for t in range(TRIALS))
SAMPLER = (
    EDGES
    + f"""
, t(trial, key) AS (VALUES {_T}
), top AS (SELECT node AS top, degree AS top_degree FROM n ORDER BY degree DESC, node LIMIT 1
), base AS (SELECT node, degree, top, {SIGMA} + {SIGMA} / top_degree * degree AS f0 FROM n, top
), leaf AS (SELECT trial, arg_min(node, {_h("key", "'leaf'", "node")}) AS seed FROM t, n GROUP BY 1
), seeds AS (SELECT trial, seed, min(step) AS step FROM (SELECT trial, top AS seed, 0 AS step FROM t, top UNION ALL SELECT trial, seed, 1 FROM leaf) GROUP BY 1, 2
), offers AS (
  SELECT trial, node, f, seed FROM (SELECT trial, s.dst AS node, s.weight / d.degree AS f, seed, row_number() OVER (PARTITION BY trial, s.dst ORDER BY s.weight / d.degree, step) AS k
  FROM seeds JOIN s ON s.src = seed JOIN n d ON d.node = seed) WHERE k = 1
), state AS (
  SELECT t.trial, b.node, b.degree, CASE WHEN m.seed IS NOT NULL THEN 0.0 WHEN o.f < b.f0 THEN o.f ELSE b.f0 END AS f,
    CASE WHEN m.seed IS NOT NULL THEN b.node WHEN o.f < b.f0 THEN o.seed ELSE b.top END AS owner
  FROM t CROSS JOIN base b LEFT JOIN offers o ON o.trial = t.trial AND o.node = b.node LEFT JOIN seeds m ON m.trial = t.trial AND m.seed = b.node
), mass AS (
  SELECT *, f / sum(f) OVER (PARTITION BY trial) + degree / sum(degree) OVER (PARTITION BY trial, owner) AS g FROM state
), cum AS (SELECT *, sum(g) OVER (PARTITION BY trial ORDER BY node) AS hi FROM mass
), total AS (SELECT trial, max(hi) AS total FROM cum GROUP BY 1
), asked AS (SELECT t.trial, i, {_u("key", "'draw'", "i")} * total AS at, total FROM t JOIN total USING (trial), range({SIZE}) r(i)
), draws AS (SELECT a.trial, a.i, c.node, c.g / a.total AS prob, c.degree FROM asked a JOIN cum c ON c.trial = a.trial AND c.hi >= a.at AND c.hi - c.g < a.at
), core AS (
  SELECT trial, row_number() OVER (PARTITION BY trial ORDER BY first) - 1 AS ord, node, weight, degree, {_h("'label'", "trial", "node")} % {LABELS} AS label
  FROM (SELECT trial, node, degree, sum(degree / (prob * {SIZE})) AS weight, min(i) AS first FROM draws GROUP BY 1, 2, 3)
), inner_edges AS (
  SELECT a.trial, a.ord AS i, b.ord AS j, s.weight, a.weight AS wi, a.degree AS di, b.weight AS wj, b.degree AS dj, a.label AS li, b.label AS lj
  FROM core a JOIN s ON s.src = a.node JOIN core b ON b.trial = a.trial AND b.node = s.dst
), centers AS (
  SELECT c.trial, c.label, sum(c.weight) AS denom, coalesce(max(p.pairs), 0) / (sum(c.weight) * sum(c.weight)) AS norm
  FROM core c LEFT JOIN (SELECT trial, li AS label, sum(wi * wj * weight / (di * dj)) AS pairs FROM inner_edges WHERE li = lj GROUP BY 1, 2) p
    ON p.trial = c.trial AND p.label = c.label GROUP BY 1, 2
), hits AS (
  SELECT c.trial, n.node, c.label, sum(c.weight * s.weight / (n.degree * c.degree)) AS ip FROM n JOIN s ON s.src = n.node JOIN core c ON c.node = s.dst GROUP BY 1, 2, 3
), first_center AS (SELECT trial, label AS s, norm AS s_norm FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY norm, label) AS k FROM centers) WHERE k = 1
), ranked AS (
  SELECT f.trial, n.node, n.degree, c.label, c.norm - 2 * coalesce(h.ip, 0) / c.denom AS dist,
    row_number() OVER (PARTITION BY f.trial, n.node ORDER BY c.norm - 2 * coalesce(h.ip, 0) / c.denom, CASE WHEN c.label = f.s AND h.ip IS NULL THEN 0 ELSE 1 END, c.label) AS k
  FROM first_center f CROSS JOIN n JOIN centers c ON c.trial = f.trial LEFT JOIN hits h ON h.trial = f.trial AND h.node = n.node AND h.label = c.label
), projected AS (SELECT trial, node AS pos, node, label, dist + 1 / (degree * degree) + {SIGMA} / degree AS score FROM ranked WHERE k = 1
), scores AS (SELECT trial, sum(score) AS total_score FROM projected GROUP BY 1)
"""
)


def _sampler(spark, sf) -> dict[str, DataFrame]:
    g = cut(_graph(spark, sf))  # read by each of the steps
    n = cut(updates.degrees(g))
    trials = sampling.trials_table(spark, SEED, TRIALS)
    base = sampling.base_mass(n, SIGMA)
    schedule = sampling.seed_schedule(g, base, trials, 2)
    return {"g": g, "n": n, "trials": trials, "base": base, "schedule": schedule, "state": sampling.seeded_state(g, base, trials, schedule)}


def _core(spark, sf) -> dict[str, DataFrame]:
    x = _sampler(spark, sf)
    draws = sampling.coreset_draws(sampling.smoothed_mass(x["state"]), x["trials"], SIZE)
    core = cut(sampling.coreset_weights(draws, x["n"], SIZE))
    return x | {"core": core.withColumn("label", F.pmod(hash_long(F.lit("label"), "trial", "node"), F.lit(LABELS)).cast("int"))}


def _projected(spark, sf) -> dict[str, DataFrame]:
    x = _core(spark, sf)
    return x | {"projected": projection.project(x["n"].select(F.col("node").alias("pos"), "node"), x["core"], x["g"], x["n"], SIGMA)}


@query(SAMPLER + "SELECT node, degree, round(f0, 6) AS f0 FROM base")
def base_contribution(spark, sf):
    return _r(sampling.base_mass(updates.degrees(_graph(spark, sf)), SIGMA).select("node", "degree", "f0"), "f0")


@query(SAMPLER + "SELECT trial, node, degree, round(f, 9) AS f, owner FROM state")
def seed_repair(spark, sf):
    return _r(_sampler(spark, sf)["state"].select("trial", "node", "degree", "f", "owner"), "f", digits=9)


@query(SAMPLER + "SELECT trial, node, round(g, 9) AS g FROM mass")
def smoothed_mass(spark, sf):
    return _r(sampling.smoothed_mass(_sampler(spark, sf)["state"]).select("trial", "node", "g"), "g", digits=9)


@query(SAMPLER + "SELECT trial, i, node, round(prob, 9) AS prob FROM draws")
def coreset_draws(spark, sf):
    x = _sampler(spark, sf)
    return _r(sampling.coreset_draws(sampling.smoothed_mass(x["state"]), x["trials"], SIZE), "prob", digits=9)


@query(SAMPLER + "SELECT trial, ord, node, round(weight, 6) AS weight, degree FROM core")
def coreset_weights(spark, sf):
    return _r(_core(spark, sf)["core"].drop("label"), "weight")


@query(SAMPLER + f"SELECT trial, i, j, round(weight * (wi / di) * (wj / dj), 6) AS a FROM inner_edges UNION ALL SELECT trial, ord, ord, round({SIGMA} * weight * weight / degree, 1) FROM core")
def coreset_graph(spark, sf):
    x = _core(spark, sf)
    return coreset.coreset_graph(x["core"], x["g"], SIGMA).withColumn("a", F.when(F.col("i") == F.col("j"), F.round("a", 1)).otherwise(F.round("a", 6)))


@query(SAMPLER + "SELECT trial, label, round(denom, 6) AS denom, round(norm, 12) AS norm FROM centers")
def center_norms(spark, sf):
    x = _core(spark, sf)
    return _r(_r(coreset.centers(x["core"], x["g"]), "denom"), "norm", digits=12)


@query(SAMPLER + "SELECT trial, pos, node, label, round(score, 6) AS score FROM projected")
def label_projection(spark, sf):
    return _r(_projected(spark, sf)["projected"], "score")


@query(SAMPLER + "SELECT trial, round(total_score, 4) AS total_score FROM scores")
def trial_scores(spark, sf):
    return _r(projection.trial_scores(_projected(spark, sf)["projected"]), "total_score", digits=4)


@query(SAMPLER + "SELECT trial, round(total_score, 4) AS total_score FROM scores ORDER BY scores.total_score, trial LIMIT 1")
def winner_trial(spark, sf):
    return _r(projection.winner(projection.trial_scores(_projected(spark, sf)["projected"])), "total_score", digits=4)


def _weights(spark, sf, how: str, temperature=None) -> DataFrame:
    return _r(consensus.trial_weights(projection.trial_scores(_projected(spark, sf)["projected"]), how, temperature).select("trial", "weight"), "weight")


@query(SAMPLER + "SELECT trial, round(1.0 / count(*) OVER (), 6) AS weight FROM scores")
def trial_weights_uniform(spark, sf):
    return _weights(spark, sf, "uniform")


@query(SAMPLER + "SELECT trial, round(1 / greatest(total_score, 1e-12) / sum(1 / greatest(total_score, 1e-12)) OVER (), 6) AS weight FROM scores")
def trial_weights_inverse(spark, sf):
    return _weights(spark, sf, "inverse_score")


@query(SAMPLER + ", x AS (SELECT trial, exp(-(total_score - (SELECT min(total_score) FROM scores)) / greatest((SELECT stddev_pop(total_score) FROM scores), 1e-12)) AS w FROM scores) SELECT trial, round(w / sum(w) OVER (), 6) AS weight FROM x")
def trial_weights_softmax(spark, sf):
    return _weights(spark, sf, "score_softmax")


# Consensus on stand-in labels of every node in five trials

LABELLED = (
    EDGES
    + f"""
, w(trial, weight) AS (VALUES (0, 0.1), (1, 0.2), (2, 0.3), (3, 0.25), (4, 0.15)
), l AS (SELECT trial, node, {_h("'c'", "trial", "node")} % 24 AS label FROM w, n
), scored AS (SELECT e.src AS u, e.dst AS v, sum(CASE WHEN a.label = b.label THEN w.weight ELSE 0 END) AS score
  FROM e JOIN l a ON a.node = e.src JOIN l b ON b.node = e.dst AND b.trial = a.trial JOIN w ON w.trial = a.trial GROUP BY 1, 2)
"""
)
_W = [(0, 0.1), (1, 0.2), (2, 0.3), (3, 0.25), (4, 0.15)]


def _labelled(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, labels, trial weights)."""
    g = _graph(spark, sf)
    w = spark.createDataFrame(_W, "trial int, weight double")
    labels = updates.degrees(g).select("node").join(F.broadcast(w.select("trial"))).withColumn("label", F.pmod(hash_long(F.lit("c"), "trial", "node"), F.lit(24)).cast("int"))  # five rows
    return g, labels, w


def _scored(spark, sf) -> DataFrame:
    g, labels, w = _labelled(spark, sf)
    return consensus.score_pairs(g.select(F.col("src").alias("u"), F.col("dst").alias("v")), labels, w)


@query(LABELLED + "SELECT u, v, round(score, 6) AS score FROM scored")
def pair_scores(spark, sf):
    return _r(_scored(spark, sf), "score")


@query(LABELLED + "SELECT floor(row_number() OVER (ORDER BY src, dst) - 1)::BIGINT AS pair, src AS u, dst AS v FROM e")
def flat_pairs(spark, sf):
    g = running(_graph(spark, sf).withColumn("one", F.lit(1)), ["src", "dst"], {"k": "one"}).withColumn("k", F.col("k") - 1)
    flat = g.select(F.posexplode(F.array("src", "dst")).alias("side", "node"), "k").select((F.col("k").cast("long") * 2 + F.col("side")).alias("pos"), "node")
    return consensus.flat_pairs(flat)


@query(LABELLED + "SELECT a.node AS u, b.node AS v, round(sum(w.weight), 6) AS score FROM l a JOIN l b ON b.trial = a.trial AND b.label = a.label JOIN w ON w.trial = a.trial GROUP BY 1, 2")
def score_matrix(spark, sf):
    _, labels, w = _labelled(spark, sf)
    return _r(consensus.score_matrix(labels.select("node").distinct(), labels, w), "score")


@query(
    LABELLED
    + """, sparse AS (SELECT a.node AS u, b.node AS v, sum(w.weight) AS score FROM l a JOIN l b ON b.trial = a.trial AND b.label = a.label JOIN w ON w.trial = a.trial GROUP BY 1, 2),
dense AS (SELECT a.node, b.node AS other, coalesce(s.score, 0) AS score FROM n a CROSS JOIN n b LEFT JOIN sparse s ON s.u = a.node AND s.v = b.node)
SELECT node, count(*) AS entries, md5(string_agg(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY other)) AS row_md5 FROM dense GROUP BY 1"""
)
def dense_score_matrix(spark, sf):
    """Every entry of the matrix of all nodes, zeros too; a row's entries as one digest."""
    _, labels, w = _labelled(spark, sf)
    return consensus.dense_matrix(labels.select("node").distinct(), labels, w, _digest, "entries long, row_md5 string")


def _digest(scores) -> dict:
    """The number of a row's scores and the md5 of their millionths, joined by commas."""
    import hashlib

    import numpy as np
    import pandas as pd

    whole = np.floor(scores * 1_000_000 + 0.5).astype(np.int64)
    at = np.flatnonzero(whole)
    code, values = pd.factorize(whole[at])
    words = [f"{x},".encode() for x in values.tolist()]
    gap = np.diff(at, prepend=-1) - 1  # zeros before each other entry
    text: list[bytes] = [b""] * (2 * len(at))
    text[0::2] = [b"0," * n for n in gap.tolist()]
    text[1::2] = [words[c] for c in code.tolist()]
    text.append(b"0," * int(len(whole) - 1 - (at[-1] if len(at) else -1)))
    return {"entries": len(scores), "row_md5": hashlib.md5(b"".join(text)[:-1]).hexdigest()}


@query(LABELLED + "SELECT u, v, round(score, 6) AS score FROM scored WHERE score >= 0.15")
def threshold_pairs(spark, sf):
    return _r(consensus.threshold_pairs(_scored(spark, sf), 0.15), "score")


@query(
    LABELLED
    + """, kept AS (SELECT src AS u, dst AS v FROM e WHERE weight >= 3), both_ways AS (SELECT u, v FROM kept UNION ALL SELECT v, u FROM kept),
reach(node, root) AS (SELECT node, node FROM n UNION SELECT k.v, r.root FROM reach r JOIN both_ways k ON k.u = r.node)
SELECT node, min(root) AS component FROM reach GROUP BY 1"""
)
def connected_components(spark, sf):
    g = _graph(spark, sf)
    pairs = g.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("weight").alias("score"))
    return consensus.connected_components(pairs, updates.degrees(g), 3.0, True)


@query(LABELLED + "SELECT round(sum(CASE WHEN la = lb THEN weight ELSE 0 END) / sum(weight) - (SELECT sum(d * d) / pow(sum(d), 2) FROM (SELECT l.label, sum(n.degree) AS d FROM n JOIN l ON l.node = n.node AND l.trial = 0 GROUP BY 1)), 9) AS modularity FROM (SELECT e.weight, a.label AS la, b.label AS lb FROM e JOIN l a ON a.node = e.src AND a.trial = 0 JOIN l b ON b.node = e.dst AND b.trial = 0)")
def modularity(spark, sf):
    g, labels, _ = _labelled(spark, sf)
    return _r(community.modularity(g, labels.where("trial = 0")), "modularity", digits=9)


@query(LABELLED + "SELECT least(a.label, b.label) AS src, greatest(a.label, b.label) AS dst, sum(e.weight) AS weight FROM e JOIN l a ON a.node = e.src AND a.trial = 0 JOIN l b ON b.node = e.dst AND b.trial = 0 GROUP BY 1, 2")
def aggregate_graph(spark, sf):
    g, labels, _ = _labelled(spark, sf)
    return community.aggregate_graph(g, labels.where("trial = 0"))


# Quality

_ARI = f"""
WITH x AS (SELECT label AS truth, CASE WHEN {_u("'keep'", "vec_id")} < 0.7 THEN label ELSE {_h("'other'", "vec_id")} % 10 END AS pred FROM embeddings),
c AS (SELECT truth, pred, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2),
v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY truth)) AS t,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY pred)) AS p, (SELECT sum(n) FROM c) AS a)
SELECT round((b - t * p / (a * (a - 1) / 2)) / ((t + p) / 2 - t * p / (a * (a - 1) / 2)), 9) AS ari FROM v
"""


@query(_ARI)
def ari(spark, sf):
    e = tables.read_table(spark, sf, "embeddings")
    pred = F.when(uniform(F.lit("keep"), "vec_id") < 0.7, F.col("label")).otherwise(F.pmod(hash_long(F.lit("other"), "vec_id"), F.lit(10)))
    return _r(metrics.adjusted_rand_index(e.select(F.col("label").alias("truth"), pred.alias("pred"))), "ari", digits=9)


_RANKED = LABELLED + f", x AS (SELECT round(score, 6) AS score, CASE WHEN {_u("'truth'", 'u', 'v')} < 0.3 + score / 2 THEN 1 ELSE 0 END AS truth FROM scored)"


def _truth(spark, sf) -> DataFrame:
    return _scored(spark, sf).select(F.round("score", 6).alias("score"), (uniform(F.lit("truth"), "u", "v") < 0.3 + F.col("score") / 2).cast("int").alias("truth"))


@query(_RANKED + ", r AS (SELECT truth, avg(k) OVER (PARTITION BY score) AS k FROM (SELECT *, row_number() OVER (ORDER BY score) AS k FROM x)) SELECT round((sum(k) FILTER (WHERE truth = 1) - sum(truth) * (sum(truth) + 1.0) / 2) / (sum(truth) * sum(1.0 - truth)), 9) AS roc_auc FROM r")
def pair_roc_auc(spark, sf):
    return _r(metrics.roc_auc(_truth(spark, sf)), "roc_auc", digits=9)


@query(_RANKED + ", b AS (SELECT score, sum(truth) AS p, count(*) AS c FROM x GROUP BY 1), d AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS a FROM b) SELECT round(sum(p * tp / a::DOUBLE) / sum(p), 9) AS average_precision FROM d")
def pair_average_precision(spark, sf):
    return _r(metrics.average_precision(_truth(spark, sf)), "average_precision", digits=9)


_BALANCED = (
    LABELLED
    + f"""
, own AS (SELECT node, label, row_number() OVER (PARTITION BY label ORDER BY {_h("'11'", "'order'", "node")}, node) - 1 AS k FROM l WHERE trial = 0
), sizes AS (SELECT label, count(*) AS size FROM own GROUP BY 1
), big AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS pos, count(*) OVER () AS labels FROM sizes WHERE size >= 2
), every AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY label) - 1 AS pos, count(*) OVER () AS labels FROM sizes) WHERE labels >= 2
), d AS (SELECT pair, {_u("'11'", "'a'", "pair")} AS a, {_u("'11'", "'b'", "pair")} AS b, {_u("'11'", "'x'", "pair")} AS x, {_u("'11'", "'y'", "pair")} AS y FROM range(1000) r(pair)
), same AS (SELECT pair, 1 AS truth, label AS l1, floor(x * size) AS i, label AS l2, floor(y * (size - 1)) + CASE WHEN floor(y * (size - 1)) >= floor(x * size) THEN 1 ELSE 0 END AS j FROM d JOIN big ON pos = floor(a * labels) WHERE pair < 500
), one AS (SELECT pair, label AS l1, floor(x * size) AS i, y, floor(b * (labels - 1)) + CASE WHEN floor(b * (labels - 1)) >= pos THEN 1 ELSE 0 END AS at2 FROM d JOIN every ON pos = floor(a * labels) WHERE pair >= 500
), drawn AS (SELECT * FROM same UNION ALL SELECT pair, 0, l1, i, e.label, floor(y * e.size) FROM one JOIN every e ON e.pos = at2)
SELECT CAST(pair AS INTEGER) AS pair, p.node AS u, q.node AS v, truth FROM drawn JOIN own p ON p.label = l1 AND p.k = i JOIN own q ON q.label = l2 AND q.k = j
"""
)


@query(_BALANCED)
def balanced_pairs(spark, sf):
    _, labels, _ = _labelled(spark, sf)
    return metrics.balanced_pairs(labels.where("trial = 0").select("node", "label"), 1000, 11)


@query(EDGES + f"SELECT node FROM n ORDER BY {_h("'7'", 'node')}, node LIMIT greatest(50, (SELECT floor(0.2 * count(*))::BIGINT FROM n))")
def query_subset(spark, sf):
    return metrics.query_subset(neighbours.live_nodes(_graph(spark, sf)), 0.2, 50, 7)


# Workload

PARAMS = sbm.SbmParams(seed=42, nodes_per_cluster=32, clusters=6, p_internal=0.4, q_external=0.01, multiplier=2.0, lifetime=0.5)
_SBM = f"""
WITH d AS (
  SELECT time, {_u("42", "'kind'", "time")} < {PARAMS.internal / (PARAMS.internal + PARAMS.external)!r} AS inside, {_h("42", "'c'", "time")} % 6 AS c, {_h("42", "'a'", "time")} % 32 AS a,
    {_h("42", "'c2'", "time")} % 5 AS c2, {_h("42", "'b'", "time")} % 31 AS b1, {_h("42", "'b2'", "time")} % 32 AS b2 FROM range({PARAMS.updates}) r(time)
), x AS (SELECT time, 32 * c + a AS u, CASE WHEN inside THEN 32 * c + b1 + CASE WHEN b1 >= a THEN 1 ELSE 0 END ELSE 32 * (c2 + CASE WHEN c2 >= c THEN 1 ELSE 0 END) + b2 END AS v FROM d
), up AS (SELECT time, least(u, v) AS u, greatest(u, v) AS v, 1.0 AS delta FROM x WHERE u <> v
), ev AS (SELECT * FROM up UNION ALL SELECT time + {PARAMS.ticks_alive}, u, v, -1.0 FROM up WHERE time + {PARAMS.ticks_alive} < {PARAMS.updates}
), o AS (SELECT 2 * time + CASE WHEN delta > 0 THEN 1 ELSE 0 END AS seq, time, u, v, sum(delta) OVER (PARTITION BY u, v ORDER BY time, delta ROWS UNBOUNDED PRECEDING) AS w FROM ev)
"""


@query(_SBM + "SELECT seq, time, u, v, CASE WHEN w > 0 THEN CAST(w AS DOUBLE) END AS weight FROM o")
def sbm_ops(spark, sf):
    return sbm.sbm_ops(spark, PARAMS)


@query(_SBM + f"SELECT floor(time / {0.1 * (PARAMS.updates - 1)!r})::INTEGER AS batch, count(*) AS ops, count(*) FILTER (WHERE w <= 0) AS deletes FROM o GROUP BY 1")
def sbm_batches(spark, sf):
    return sbm.batches(sbm.sbm_ops(spark, PARAMS), PARAMS, 0.1).groupBy("batch").agg(F.count("*").alias("ops"), F.count_if(F.col("weight").isNull()).alias("deletes"))


@query(_SBM + ", z AS (SELECT u, v, arg_max(w, seq) AS w FROM o GROUP BY 1, 2) SELECT u AS src, v AS dst, CAST(w AS DOUBLE) AS weight FROM z WHERE w > 0")
def sbm_replay(spark, sf):
    return sbm.apply_to(updates.empty_edges(spark), sbm.sbm_ops(spark, PARAMS).select("seq", "u", "v", "weight"))


# Whole queries: random draws and Leiden, beyond SQL


def _index(spark, sf, trials: int) -> GraphIndex:
    return GraphIndex(spark, IndexConfig(8, coreset_size=128, sampling_seeds=16, num_trials=trials, rng_seed=SEED), edges=cut(_graph(spark, sf)))


@query()
def leiden_query(spark, sf):
    return _index(spark, sf, 1).query_all().labels


@query()
def query_all_trials(spark, sf):
    index = _index(spark, sf, TRIALS)
    return index.query_all_trials().labels


@query()
def consensus_query(spark, sf):
    index = _index(spark, sf, TRIALS)
    return index.score_pairs(index.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


# Whole queries with a clusterer and two seeds that SQL can follow: labels go round by the order of the coreset

BY_ORDER = SAMPLER.replace(f"{_h("'label'", "trial", "node")} % {LABELS} AS label", f"(row_number() OVER (PARTITION BY trial ORDER BY first) - 1) % {LABELS} AS label")


def _round(n, i, j, a, k):
    import numpy as np

    return np.arange(n) % 64


def _followed(spark, sf) -> GraphIndex:
    config = IndexConfig(8, sigma=SIGMA, coreset_size=SIZE, sampling_seeds=2, num_trials=TRIALS, rng_seed=SEED)
    return GraphIndex(spark, config, clusterer=_round, edges=cut(_graph(spark, sf)))


@query(BY_ORDER + "SELECT trial, pos, node, label, round(score, 6) AS score FROM projected")
def index_all_trials(spark, sf):
    return _r(_followed(spark, sf).query_all_trials().labels, "score")


@query(BY_ORDER + "SELECT pos, node, label FROM projected WHERE trial = (SELECT trial FROM scores ORDER BY total_score, trial LIMIT 1)")
def index_winner(spark, sf):
    return _followed(spark, sf).query_all().labels


@query(
    BY_ORDER
    + """, x AS (SELECT trial, exp(-(total_score - (SELECT min(total_score) FROM scores)) / greatest((SELECT stddev_pop(total_score) FROM scores), 1e-12)) AS w FROM scores
), wt AS (SELECT trial, w / sum(w) OVER () AS weight FROM x)
SELECT e.src AS u, e.dst AS v, round(sum(CASE WHEN a.label = b.label THEN wt.weight ELSE 0 END), 5) AS score
FROM e JOIN projected a ON a.node = e.src JOIN projected b ON b.node = e.dst AND b.trial = a.trial JOIN wt ON wt.trial = a.trial GROUP BY 1, 2"""
)
def index_consensus(spark, sf):
    index = _followed(spark, sf)
    return _r(index.score_pairs(index.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))), "score", digits=5)
