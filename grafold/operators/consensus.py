"""Consensus over trials: weights, pair scores, thresholds and components, lazily on (trial, node, label)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafold.functions.errors import InvalidInput
from grafold.operators.components import components

WEIGHTINGS = ("uniform", "inverse_score", "score_softmax")
FLOOR = 1e-12
#: Nodes on a side of a tile of pairs, and scores that a worker gathers before it sends them.
TILE, ENTRIES = 2048, 2_000_000


def trial_weights(scores: DataFrame, weighting: str = "score_softmax", temperature: float | str | None = None) -> DataFrame:
    """scores(trial, total_score) -> (trial, total_score, weight), weights adding up to 1. Scores that the
    weighting cannot use, and weights whose total is not finite and above 0, fail the query."""
    name = weighting.lower().replace("-", "_")
    if name not in WEIGHTINGS:
        raise InvalidInput(f"unknown weighting {weighting!r}; one of {', '.join(WEIGHTINGS)}")
    if temperature is not None and temperature != "auto" and not (isinstance(temperature, int | float) and math.isfinite(temperature) and temperature > 0):
        raise InvalidInput("temperature must be finite and above zero, or 'auto'")
    s, every = F.col("total_score"), Window.partitionBy()  # a row for each trial
    if name == "uniform":
        raw = F.lit(1.0)
    elif name == "inverse_score":
        raw = 1 / F.greatest(s, F.lit(FLOOR))
    else:
        auto = temperature is None or temperature == "auto"
        t = F.greatest(F.stddev_pop(s).over(every), F.lit(FLOOR)) if auto else F.lit(float(temperature))
        raw = F.exp(-(s - F.min(s).over(every)) / t)
    if name != "uniform":
        raw = F.when(_finite(s), raw).otherwise(_fail("trial %d: the score is not finite"))
    if name == "inverse_score":
        raw = F.when(s > 0, raw).otherwise(_fail("trial %d: inverse_score needs scores above zero"))
    total = F.sum("raw").over(every)
    weight = F.when(_finite(total) & (total > 0), F.col("raw") / total).otherwise(_fail("trial %d: the weights have no finite total above zero"))
    return scores.withColumn("raw", raw).withColumn("weight", weight).drop("raw")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _fail(what: str) -> Column:
    return F.raise_error(F.format_string(what, F.col("trial"))).cast("double")


def check_scores(scores: DataFrame, weighting: str) -> None:
    """InvalidInput where a weighting cannot use the scores; there must be a trial."""
    rows = scores.collect()  # a row for each trial
    if not rows:
        raise InvalidInput("no trials")
    name = weighting.lower().replace("-", "_")
    for r in rows:
        s = r["total_score"]
        if name != "uniform" and (s is None or not math.isfinite(s)):
            raise InvalidInput(f"trial {r['trial']}: the score is not finite")
        if name == "inverse_score" and s <= 0:
            raise InvalidInput(f"trial {r['trial']}: inverse_score needs scores above zero")


def require_unique(query: DataFrame) -> None:
    row = query.groupBy("node").count().where("count > 1").first()
    if row is not None:
        raise InvalidInput(f"node {row['node']} occurs more than once")


def require_members(pairs: DataFrame, labels: DataFrame) -> None:
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    row = asked.join(labels.select("node").distinct(), "node", "left_anti").first()
    if row is not None:
        raise InvalidInput(f"node {row['node']} is not part of the consensus")


def score_pairs(pairs: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """pairs(u, v, ...) -> its columns and ``score``, the weight of the trials in which both have one label.

    A node's labels over all trials are one array, so a pair costs two look-ups, however many trials."""
    w = weights.select("trial", "weight")
    row = labels.join(F.broadcast(w), "trial").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("trial", "label", "weight"))).alias("l"))  # weights: a row a trial
    a, b = row.select(F.col("node").alias("u"), F.col("l").alias("lu")), row.select(F.col("node").alias("v"), F.col("l").alias("lv"))
    both = pairs.join(a, "u").join(b, "v")
    same = F.zip_with("lu", "lv", lambda x, y: F.when(x["label"] == y["label"], x["weight"]).otherwise(0.0))
    return both.withColumn("score", F.aggregate(same, F.lit(0.0), lambda acc, x: acc + x)).select(*pairs.columns, "score")


def flat_pairs(flat: DataFrame) -> DataFrame:
    """flat(pos, node) = u0, v0, u1, v1, ... -> (pair, u, v); an odd length is an error."""
    if flat.count() % 2:
        raise InvalidInput("a flat buffer of pairs must have an even length")
    at = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("node")))
    return flat.groupBy(F.floor(F.col("pos") / 2).alias("pair")).agg(at(0).alias("u"), at(1).alias("v"))


def _by_trial(nodes: DataFrame, labels: DataFrame, weights: list) -> DataFrame:
    """(node, l0, l1, ...): a row for each node given that has labels, null where a trial gave it none."""
    own = labels.join(nodes.select("node").distinct(), "node").where(F.col("trial").isin([w["trial"] for w in weights]) & F.col("label").isNotNull())
    return own.groupBy("node").agg(*(F.max(F.when(F.col("trial") == w["trial"], F.col("label"))).alias(f"l{k}") for k, w in enumerate(weights)))


def _weight_rows(weights: DataFrame) -> list:
    return weights.select("trial", "weight").orderBy("trial").collect()  # a row a trial


def _parts(df: DataFrame) -> int:
    """Partitions for work that is much larger than the rows it starts from; counts given by number stay as they are."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def score_matrix(nodes: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """All pairs of the nodes given: (u, v, score). Sparse: only pairs that some trial puts together, the
    rest being 0, so the work follows cluster sizes. Nodes with their labels of all trials meet in tiles of their
    clusters; a pair is kept in the first trial that puts it together and gets its whole score there, so pairs are
    neither shuffled nor held."""
    trials = _weight_rows(weights)
    if not trials:
        return nodes.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("score")).limit(0)
    every = [f"l{k}" for k in range(len(trials))]
    rows = _by_trial(nodes, labels, trials)
    in_each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("label")) for k, c in enumerate(every)))
    member = rows.select("node", *every, F.explode(in_each).alias("at")).select("node", *every, "at.k", "at.label").where("label is not null")
    tiles = member.groupBy("k", "label").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = member.join(tiles, ["k", "label"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    key = ["k", "label", "tu", "tv"]
    of = lambda node, side, mine, theirs: placed.select("k", "label", F.col("own").alias(mine), other.alias(theirs), F.col("node").alias(node), *(F.col(c).alias(side + c) for c in every)).repartition(_parts(rows), *key)
    both = of("u", "u", "tu", "tv").join(of("v", "v", "tv", "tu"), key)
    same = [F.coalesce(F.col("u" + c) == F.col("v" + c), F.lit(False)) for c in every]
    for k in range(len(every)):
        both = both.where((F.col("k") <= k) | ~same[k])
    score = F.lit(0.0)
    for w, agree in zip(trials, same, strict=True):
        score = score + F.when(agree, float(w["weight"])).otherwise(0.0)
    return both.select("u", "v", score.alias("score"))


def dense_matrix(nodes: DataFrame, labels: DataFrame, weights: DataFrame, fold: Callable[[np.ndarray], dict] | None = None, schema: str = "scores array<double>") -> DataFrame:
    """The matrix with its zeros: (node, scores), a row for each node given, once, with its scores against all of
    them in rising order of nodes. ``fold`` makes other columns, of that ``schema``, of a row's scores where they
    arise. A block of rows gets the labels of all nodes and sends one row after the other; a worker holds those
    labels and about ``ENTRIES`` scores, or one row."""
    trials = _weight_rows(weights)
    every = [f"l{k}" for k in range(len(trials))]
    found = _by_trial(nodes, labels, trials) if trials else nodes.select("node").limit(0)
    columns = nodes.select("node").distinct().where("node is not null").join(found, "node", "left")
    count = columns.count()
    blocks = max(1, -(-count // TILE), min(2 * _parts(columns), -(-count // 64)))
    wide = columns.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), "node", *every)
    rows = found.select(F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), "node", *every)
    dealt = wide.unionByName(rows).repartition(blocks, "block").sortWithinPartitions("block", "side", "node")
    return dealt.mapInArrow(_dense_rows([float(w["weight"]) for w in trials], fold or (lambda scores: {"scores": scores}), schema), f"node {dict(columns.dtypes)['node']}, {schema}")


def _dense_rows(weights: list[float], fold: Callable[[np.ndarray], dict], schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, columns, held, made = None, [], None, []

        def sent() -> pa.RecordBatch:
            names = [n for n in made[0][1]]
            out = pa.RecordBatch.from_arrays([pa.array([n for n, _ in made]), *(pa.array([d[c] for _, d in made]) for c in names)], ["node", *names])
            made.clear()
            return out

        for batch in batches:
            at, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "side"))
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at[a] != block:
                    block, columns, held = at[a], [], None
                if side[a] == 0:
                    columns.append(batch.slice(a, b - a))
                    continue
                if held is None:
                    table = pa.Table.from_batches(columns).combine_chunks()
                    held = table.column("node").to_numpy(), [_members(table.column(f"l{k}")) for k in range(len(weights))]
                    columns = []
                for node in batch.column("node").slice(a, b - a).to_pylist():
                    place = np.searchsorted(held[0], node)
                    scores = np.zeros(len(held[0]))
                    for weight, (code, order, start) in zip(weights, held[1], strict=True):
                        if code[place] >= 0:
                            scores[order[start[code[place]] : start[code[place] + 1]]] += weight
                    made.append((node, fold(scores)))
                    if len(made) * len(scores) >= ENTRIES:
                        yield sent()
        if made:
            yield sent()

    return run


def _members(labels: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a small number for each label, -1 for null; places in order of those numbers; where each number starts)."""
    code = pd.factorize(labels.to_pandas())[0]
    order = np.argsort(code, kind="stable").astype(np.int32)
    return code, order, np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))


def first_seen(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) -> (pos, node): the nodes that occur, once each, by their first place in the table."""
    at = pairs.select(F.monotonically_increasing_id().alias("row"), F.posexplode(F.array("u", "v")).alias("side", "node"))
    return at.groupBy("node").agg(F.min(F.col("row") * 2 + F.col("side")).alias("pos")).select("pos", "node")


def threshold_pairs(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of at least the threshold."""
    return scored.where(F.col("score") >= threshold)


def connected_components(scored: DataFrame, nodes: DataFrame, threshold: float = 0.8, include_singletons: bool = True) -> DataFrame:
    """(node, component) over the given pairs that reach the threshold; component is the smallest node.
    With singletons, every queried node without such a pair is a component of its own."""
    kept = threshold_pairs(scored, threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    found = components(kept).select(F.col("id").alias("node"), F.col("root").alias("component"))
    if not include_singletons:
        return found
    return nodes.select("node").distinct().join(found, "node", "full_outer").select("node", F.coalesce("component", "node").alias("component"))


def component_lists(found: DataFrame) -> DataFrame:
    """(members), sorted, one row for each component, by first member. For results that are shown."""
    return found.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members")).orderBy("component").select("members")
