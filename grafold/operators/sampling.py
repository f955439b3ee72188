"""The randomised node sample (coreset), for all trials at once.

Masses: f(v) = sigma + sigma * degree / largest degree at first; adding seed p sets f(p) = 0 and, for
each neighbour q, lowers f(q) to weight / degree(p) if that is smaller, p then owning q; unowned nodes
belong to the node of largest degree, the first seed. The second seed is a uniform node; the others are
drawn in proportion to the masses of the moment. Then ``size`` draws with replacement are made in
proportion to g = f / sum(f) + degree / (degree owned by the owner); a node's weight is the sum over its
draws of degree / (probability * size), so weights add up to the graph's volume on average.

The seeds depend on each other, but masses only fall. So candidates are drawn from the first masses, all
at once, and accepted with probability (mass now / first mass), which is a draw in proportion to the
mass now; where few are accepted, the masses of the moment become the first masses of another round.
The acceptance loop needs nothing but the edges among candidates: a small table for each trial,
whatever the size of the graph. What the seeds did to all other nodes is one join and one
aggregate at the end. Draws are inverse-CDF look-ups in two levels (ranges of nodes of about equal
numbers, as many as shuffle partitions, then within a range), as merges of two sorted sides, so no global
sort or single-partition scan is needed, however sparse the ids are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure, InvalidConfig
from grafold.functions.scalars import hash_long, trial_seed, uniform
from grafold.operators.components import cut
from grafold.operators.neighbours import max_degree_node
from grafold.operators.ordering import ranges
from grafold.operators.updates import symmetric


def check_sizes(live: int, size: int, seeds: int, trials: int) -> None:
    if live == 0:
        raise IndexFailure("no data")
    if min(size, seeds, trials) < 1:
        raise InvalidConfig("sizes and trials must be above zero")
    if not 2 <= seeds < size < live:
        raise IndexFailure(f"2 <= sampling_seeds ({seeds}) < coreset_size ({size}) < live nodes ({live}) must hold")


def trials_table(spark, seed: int, trials: int) -> DataFrame:
    """(trial, key): each trial's seed as text."""
    return spark.createDataFrame([(t, str(trial_seed(seed, t))) for t in range(trials)], "trial int, key string")


def base_mass(nodes: DataFrame, sigma: float) -> DataFrame:
    """(node, degree, f0), the ``block`` of the node's range, and on each row the first seed ``top`` and its
    degree ``top_degree``."""
    top = max_degree_node(nodes).select(F.col("node").alias("top"), F.col("degree").alias("top_degree"))
    return ranges(nodes.select("node", "degree"), "node").join(F.broadcast(top)).withColumn("f0", F.lit(sigma) + F.lit(sigma) / F.col("top_degree") * F.col("degree"))  # one row


def draw(mass: DataFrame, draws: DataFrame) -> DataFrame:
    """mass(trial, node, block, mass), draws(trial, i, u), 0 < u < 1 -> (trial, i, node, prob): with replacement,
    in proportion to the mass. A draw takes the first node whose cumulative mass reaches u * total."""
    inner = Window.partitionBy("trial", "block").orderBy("node")
    cum = mass.where("mass > 0").select("trial", "node", "mass", "block").withColumn("hi", F.sum("mass").over(inner))
    over = Window.partitionBy("trial").orderBy("block")
    blocks = cum.groupBy("trial", "block").agg(F.max("hi").alias("t")).withColumn("hi", F.sum("t").over(over))
    total = blocks.groupBy("trial").agg(F.max("hi").alias("total"))
    asked = draws.join(total, "trial").withColumn("at", F.col("u") * F.col("total"))
    # Level one: the block of each draw; level two: the node within it.
    first = _reach(blocks.select("trial", F.col("hi"), F.struct("block", (F.col("hi") - F.col("t")).alias("before"), "t").alias("found")), asked.select("trial", "at", F.struct("i", "total").alias("who")), ["trial"])
    placed = first.select("trial", "found.block", F.least(F.col("at") - F.col("found.before"), F.col("found.t")).alias("at"), "who")
    second = _reach(cum.select("trial", "block", "hi", F.struct("node", "mass").alias("found")), placed, ["trial", "block"])
    return second.select("trial", F.col("who.i").alias("i"), "found.node", (F.col("found.mass") / F.col("who.total")).alias("prob"))


def _reach(steps: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """steps(keys, hi, found), asked(keys, at, who) -> asked with the step of smallest hi >= at."""
    kinds = {c: dict(steps.dtypes).get(c) or dict(asked.dtypes)[c] for c in ("found", "who")}
    a = steps.select(*keys, F.col("hi").alias("at"), F.lit(1).alias("side"), "found", F.lit(None).cast(kinds["who"]).alias("who"))
    b = asked.select(*keys, "at", F.lit(0).alias("side"), F.lit(None).cast(kinds["found"]).alias("found"), "who")
    down = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("found", F.last("found", ignorenulls=True).over(down)).where("side = 0").drop("side")


def _accept(seeds: int):
    """One trial's next seeds from its candidates; rows of kind n (seeds so far), c (candidate, in order)
    and e (edge among candidates)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        trial = int(pdf["trial"].iloc[0])
        had = int(pdf.loc[pdf["kind"] == "n", "i"].iloc[0])
        edges: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in pdf.loc[pdf["kind"] == "e", ["node", "other", "value"]].itertuples(index=False):
            edges.setdefault(int(a), []).append((int(b), float(w)))
        cands = pdf[pdf["kind"] == "c"].sort_values("i")
        info = {int(n): (float(f), float(d)) for n, f, d in cands[["node", "value", "degree"]].itertuples(index=False)}
        mass = {n: f for n, (f, _) in info.items()}
        chosen: list[int] = []
        for i, n, u in cands[["i", "node", "u"]].itertuples(index=False):
            n = int(n)
            if had + len(chosen) == seeds:
                break
            if i < 2 or u * info[n][0] < mass[n]:
                chosen.append(n)
                mass[n] = 0.0
                for q, w in edges.get(n, ()):
                    mass[q] = min(mass[q], w / info[n][1])
        return pd.DataFrame({"trial": trial, "step": range(had, had + len(chosen)), "node": chosen})

    return run


def seed_schedule(edges: DataFrame, base: DataFrame, trials: DataFrame, seeds: int) -> DataFrame:
    """(trial, step, node): each trial's seeds in order; the second may repeat the first.

    A round draws 2 * seeds + 16 candidates from the masses at its start; where that was too few, the next
    one starts from the masses its seeds have left, so each round adds a seed at least, and usually all."""
    spark = edges.sparkSession
    sides = symmetric(edges)
    top = base.limit(1).select("top").join(trials).select("trial", F.lit(0).alias("i"), F.col("top").alias("node"))
    # A uniform node: the one of smallest hash. One aggregate over the nodes.
    leaf = trials.join(base.select("node")).groupBy("trial").agg(F.min(F.struct(hash_long("key", F.lit("leaf"), "node").alias("h"), "node")).alias("m")).select("trial", F.lit(1).alias("i"), F.col("m.node").alias("node"))
    mass = trials.select("trial").join(base.select("node", "block", "degree", "f0"))
    open_trials, had, chosen, at = trials, trials.select("trial", F.lit(0).alias("had")), None, 2
    while True:
        asks = open_trials.join(spark.range(at, at + 2 * seeds + 16)).select("trial", F.col("id").cast("int").alias("i"), uniform("key", F.lit("pick"), "id").alias("u"))
        cands = draw(mass.select("trial", "node", "block", F.col("f0").alias("mass")), asks).select("trial", "i", "node")
        cands = cut(cands if chosen is not None else top.unionByName(leaf).unionByName(cands))
        at += 2 * seeds + 16
        who = cands.select("trial", "node").distinct()
        other = who.select(F.col("trial").alias("t2"), F.col("node").alias("n2"))
        among = sides.join(F.broadcast(who), sides.src == who.node).select("trial", "src", "dst", "weight").join(F.broadcast(other), (F.col("t2") == F.col("trial")) & (F.col("n2") == F.col("dst")))
        rows = mass.join(F.broadcast(cands), ["trial", "node"]).join(F.broadcast(open_trials), "trial")
        none = lambda kind: F.lit(None).cast(kind)
        c = rows.select("trial", F.lit("c").alias("kind"), "i", "node", none("long").alias("other"), F.col("f0").alias("value"), "degree", uniform("key", F.lit("keep"), "i").alias("u"))
        e = among.select("trial", F.lit("e").alias("kind"), none("int").alias("i"), F.col("src").alias("node"), F.col("dst").alias("other"), F.col("weight").alias("value"), none("double").alias("degree"), none("double").alias("u"))
        n = had.join(open_trials.select("trial"), "trial").select("trial", F.lit("n").alias("kind"), F.col("had").alias("i"), none("long").alias("node"), none("long").alias("other"), none("double").alias("value"), none("double").alias("degree"), none("double").alias("u"))
        new = cut(c.unionByName(e).unionByName(n).groupBy("trial").applyInPandas(_accept(seeds), "trial int, step int, node long"))
        chosen = new if chosen is None else cut(chosen.unionByName(new))
        counts = {r["trial"]: r["count"] for r in chosen.groupBy("trial").count().collect()}  # a row for each trial
        short = [t for t, k in counts.items() if k < seeds]
        if not short:
            return chosen
        got = {r["trial"] for r in new.select("trial").distinct().collect()}
        if set(short) - got:
            raise IndexFailure("no mass is left to draw seeds from")
        open_trials = trials.where(F.col("trial").isin(short))
        had = spark.createDataFrame([(t, counts[t]) for t in short], "trial int, had int")
        mass = cut(seeded_state(edges, base, open_trials, chosen).select("trial", "node", "block", "degree", F.col("f").alias("f0")))


def seeded_state(edges: DataFrame, base: DataFrame, trials: DataFrame, schedule: DataFrame) -> DataFrame:
    """(trial, node, block, degree, f, owner) after all seeds: each node's smallest mass and the first seed that gave it."""
    seeds = schedule.groupBy("trial", F.col("node").alias("seed")).agg(F.min("step").alias("step"))
    # Seeds are as many as the configuration says: neither edges nor masses are shuffled to meet them.
    seeds = base.select(F.col("node").alias("seed"), F.col("degree").alias("seed_degree")).join(F.broadcast(seeds), "seed")
    offers = symmetric(edges).join(F.broadcast(seeds), F.col("src") == F.col("seed")).groupBy("trial", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("weight") / F.col("seed_degree")).alias("f"), "step", "seed")).alias("best"))
    own = seeds.select("trial", F.col("seed").alias("node"), F.lit(True).alias("is_seed"))
    state = trials.select("trial").join(base).join(offers, ["trial", "node"], "left").join(F.broadcast(own), ["trial", "node"], "left")
    better = F.coalesce(F.col("best.f") < F.col("f0"), F.lit(False))
    return state.select(
        "trial",
        "node",
        "block",
        "degree",
        F.when(F.col("is_seed"), 0.0).when(better, F.col("best.f")).otherwise(F.col("f0")).alias("f"),
        F.when(F.col("is_seed"), F.col("node")).when(better, F.col("best.seed")).otherwise(F.col("top")).alias("owner"),
    )


def smoothed_mass(state: DataFrame) -> DataFrame:
    """Adds g = f / sum(f) + degree / (degree owned by the owner)."""
    owned = state.groupBy("trial", "owner").agg(F.sum("degree").alias("owned"))
    total = state.groupBy("trial").agg(F.sum("f").alias("total"))
    return state.join(F.broadcast(owned), ["trial", "owner"]).join(F.broadcast(total), "trial").withColumn("g", F.when(F.col("total") > 0, F.col("f") / F.col("total")).otherwise(0.0) + F.col("degree") / F.col("owned"))


def coreset_draws(mass: DataFrame, trials: DataFrame, size: int) -> DataFrame:
    """mass(trial, node, block, degree, g) -> (trial, i, node, prob) of ``size`` draws a trial."""
    asks = trials.join(mass.sparkSession.range(size)).select("trial", F.col("id").cast("int").alias("i"), uniform("key", F.lit("draw"), "id").alias("u"))
    return draw(mass.select("trial", "node", "block", F.col("g").alias("mass")), asks)


def coreset_weights(draws: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(trial, ord, node, weight, degree): distinct nodes in the order of their first draws."""
    each = nodes.select("node", "degree").join(F.broadcast(draws), "node")
    total = each.groupBy("trial", "node", "degree").agg(F.sum(F.col("degree") / (F.col("prob") * size)).alias("weight"), F.min("i").alias("first"))
    return total.select("trial", (F.row_number().over(Window.partitionBy("trial").orderBy("first")) - 1).alias("ord"), "node", "weight", "degree")


def extract_coreset(edges: DataFrame, nodes: DataFrame, seed: int, size: int, seeds: int, trials: int, sigma: float) -> DataFrame:
    """The coresets of all trials: (trial, ord, node, weight, degree)."""
    spark = edges.sparkSession
    check_sizes(nodes.count(), size, seeds, trials)
    each = trials_table(spark, seed, trials)
    base = cut(base_mass(nodes, sigma))
    state = seeded_state(edges, base, each, seed_schedule(edges, base, each, seeds))
    draws = coreset_draws(smoothed_mass(state), each, size)
    return cut(coreset_weights(draws, nodes, size))


__all__ = ["base_mass", "check_sizes", "coreset_draws", "coreset_weights", "draw", "extract_coreset", "seed_schedule", "seeded_state", "smoothed_mass", "trials_table"]
