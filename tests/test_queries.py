"""Sampling, Leiden, projection, consensus and metrics."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grafold.functions.errors import GraphClusterError, IndexFailure, InvalidConfig, InvalidInput
from grafold.operators import community, consensus, coreset, metrics, projection, sampling, updates
from grafold.operators.components import components
from grafold.plans import catalog
from grafold.plans.index import GraphIndex, IndexConfig
from grafold.operators.ids import NamedIndex
from grafold.operators.metrics import default_sampling_seeds, expected_edges_per_node
from grafold.operators.ordering import running
from grafold.plans.replay import control_leiden, early_batches, replay, summary, trial_scaling, write_report
from grafold.sources import sbm
from grafold.sources.tables import ops_of
from grafold.streaming.updates import EdgeTable

TWO_BLOCKS = [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0), (2, 3, 0.01)]


def matrix(edges, diagonal=0.0, n=6):
    rows = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges] + [(i, i, diagonal) for i in range(n)]
    return tuple(np.array(c) for c in zip(*rows, strict=True))


def test_config():
    assert IndexConfig(2, coreset_size=5).seeds == 4 and IndexConfig(10).seeds == 40
    for bad in ({"num_clusters": 0}, {"num_clusters": 2, "sigma": 0.0}, {"num_clusters": 2, "coreset_size": 2, "sampling_seeds": 2}, {"num_clusters": 2, "num_trials": 0}):
        with pytest.raises(InvalidConfig):
            IndexConfig(**bad)
    with pytest.raises(InvalidConfig):
        community.LeidenConfig(quality="cpm")


@pytest.mark.parametrize("diagonal", [0.0, 1000.0])
def test_leiden_two_blocks(diagonal):
    assert community.leiden(6, *matrix(TWO_BLOCKS, diagonal)).tolist() == [0, 0, 0, 1, 1, 1]


def test_leiden_edges_of_the_domain():
    none = np.zeros(0)
    assert community.leiden(0, none, none, none).tolist() == [] and community.leiden(3, none, none, none).tolist() == [0, 1, 2]
    assert community.leiden(3, *matrix([(0, 1, 1.0), (1, 2, 0.0)], n=3)).tolist() == [0, 0, 1]
    plain = community.leiden(6, *matrix(TWO_BLOCKS), community.LeidenConfig(skip_refinement=True))
    assert plain.tolist() == [0, 0, 0, 1, 1, 1]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(IndexFailure):
            community.leiden(3, *matrix([(0, 1, bad)], n=3))
    capped = community.leiden(6, *matrix(TWO_BLOCKS), community.LeidenConfig(max_comm_size=2, max_levels=1))
    assert np.bincount(capped).max() <= 2


def brute_quality(edges, labels):
    m = sum(w for *_, w in edges)
    volume = {}
    for a, b, w in edges:
        volume[labels[a]] = volume.get(labels[a], 0) + w
        volume[labels[b]] = volume.get(labels[b], 0) + w
    return sum(w for a, b, w in edges if labels[a] == labels[b]) / m - sum((v / (2 * m)) ** 2 for v in volume.values())


def test_leiden_random_graphs_and_modularity(spark):
    rng = random.Random(7)
    for n in range(8, 20):
        edges = [(a, b, rng.uniform(0.05, 3)) for a in range(n) for b in range(a) if rng.random() < 0.35]
        labels = community.leiden(n, *matrix(edges, n=n))
        assert (labels == community.leiden(n, *matrix(edges, n=n))).all() and labels[0] == 0
        quality = brute_quality(edges, labels)
        assert quality >= brute_quality(edges, list(range(n))) and quality >= 0 - 1e-12
    df = spark.createDataFrame([(b, a, w) for a, b, w in edges], updates.EDGES)
    table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels)], "node long, label int")
    assert math.isclose(community.modularity(df, table).first()[0], quality, abs_tol=1e-12)
    both = community.aggregate_graph(df, table).agg(F.sum("weight")).first()[0]
    assert math.isclose(both, sum(w for *_, w in edges))


def test_projection_without_edges(spark):
    nodes = spark.createDataFrame([(1, 10.0), (2, 1.0)], updates.NODES)
    core = spark.createDataFrame([(0, 0, 1, 1.0, 10.0, 0), (0, 1, 2, 1.0, 1.0, 1)], "trial int, ord int, node long, weight double, degree double, label int")
    out = projection.project(spark.createDataFrame([(0, 2)], "pos int, node long"), core, updates.empty_edges(spark), nodes, 1.0).first()
    assert out["label"] == 0 and out["score"] == 2.0


def test_projection_ties_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        n, k = 12, 4
        edges = [(b, a, float(rng.choice([1, 1, 2]))) for a in range(n) for b in range(a) if rng.random() < 0.4]
        e = spark.createDataFrame(edges, updates.EDGES)
        deg = {}
        for a, b, w in edges:
            deg[a], deg[b] = deg.get(a, 0) + w, deg.get(b, 0) + w
        core = [(0, i, v, float(rng.choice([1, 2])), deg[v], rng.randrange(k)) for i, v in enumerate(sorted(deg)[:8])]
        table = spark.createDataFrame(core, "trial int, ord int, node long, weight double, degree double, label int")
        w_of = {(a, b): w for a, b, w in edges} | {(b, a): w for a, b, w in edges}
        labels = sorted({c[5] for c in core})
        denom = {c: sum(x[3] for x in core if x[5] == c) for c in labels}
        norm = {c: sum(x[3] * y[3] * w_of.get((x[2], y[2]), 0) / (x[4] * y[4]) for x in core for y in core if x[5] == c == y[5]) / denom[c] ** 2 for c in labels}
        s = min(labels, key=lambda c: (norm[c], c))
        got = {r["node"]: r for r in projection.project(spark.createDataFrame([(v, v) for v in deg], "pos long, node long"), table, e, updates.degrees(e), 3.0).collect()}
        for v in deg:
            best = (norm[s], s)
            for c in labels:
                ip = sum(x[3] * w_of.get((v, x[2]), 0) / (deg[v] * x[4]) for x in core if x[5] == c) / denom[c]
                if norm[c] - 2 * ip < best[0] - 1e-15:
                    best = (norm[c] - 2 * ip, c)
            assert math.isclose(got[v]["score"], best[0] + 1 / deg[v] ** 2 + 3.0 / deg[v], rel_tol=1e-9)


def test_coreset_weights_add_up_to_the_volume(spark):
    rng = random.Random(1)
    edges = spark.createDataFrame([(b, a, rng.uniform(0.5, 2)) for a in range(40) for b in range(a) if rng.random() < 0.2], updates.EDGES)
    nodes = updates.degrees(edges)
    volume = nodes.agg(F.sum("degree")).first()[0]
    core = sampling.extract_coreset(edges, nodes, 5, 20, 6, 40, 10.0)
    mean = core.groupBy("trial").agg(F.sum("weight").alias("w")).agg(F.avg("w")).first()[0]
    assert abs(mean / volume - 1) < 0.1
    again = sampling.extract_coreset(edges, nodes, 5, 20, 6, 40, 10.0)
    assert sorted(map(tuple, core.collect())) == sorted(map(tuple, again.collect()))
    assert core.where("trial = 0").select("node").collect() != core.where("trial = 1").select("node").collect()


def test_seed_loop_matches_sequential_masses(spark):
    """The masses after the schedule are those of adding its seeds one by one."""
    rng = random.Random(2)
    edges = [(b, a, rng.uniform(0.5, 9)) for a in range(30) for b in range(a) if rng.random() < 0.3]
    e = spark.createDataFrame(edges, updates.EDGES)
    nodes = updates.degrees(e)
    trials, base = sampling.trials_table(spark, 9, 2), sampling.base_mass(nodes, 0.5)
    schedule = sampling.seed_schedule(e, base, trials, 8)
    state = sampling.seeded_state(e, base, trials, schedule).collect()
    deg = {r["node"]: r["degree"] for r in nodes.collect()}
    top = max(deg, key=lambda v: (deg[v], -v))
    for t in range(2):
        f, owner = {v: 0.5 + 0.5 * deg[v] / deg[top] for v in deg}, dict.fromkeys(deg, top)
        order = [r["node"] for r in schedule.where(F.col("trial") == t).orderBy("step").collect()]
        assert len(order) == 8 and order[0] == top and len(set(order[2:])) == 6
        for p in order:
            f[p], owner[p] = 0.0, p
            for a, b, w in edges:
                q = b if a == p else a if b == p else None
                if q is not None and w / deg[p] < f[q]:
                    f[q], owner[q] = w / deg[p], p
        for r in state:
            if r["trial"] == t:
                assert math.isclose(r["f"], f[r["node"]], abs_tol=1e-12) and r["owner"] == owner[r["node"]]


def path4(spark, **more):
    g = GraphIndex(spark, IndexConfig(2, coreset_size=3, sampling_seeds=2, rng_seed=42, **more))
    g.update_edges([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)])
    return g


def test_query_keeps_order_and_repeats(spark):
    g = path4(spark)
    r = g.query([3, 1, 2, 3])
    got = r.in_order().collect()
    assert [x["node"] for x in got] == [3, 1, 2, 3] and got[0]["label"] == got[3]["label"] and r.trial_index == 0 and r.num_clusters > 0
    assert g.query_all().labels.count() == 4
    trials = g.query_all_trials()
    (only,) = trials.results()
    assert trials.labels.count() == 4 and only.trial_index == 0 and only.num_clusters > 0 and only.labels.columns == ["pos", "node", "label", "score"]
    assert math.isclose(only.total_score, sum(x["score"] for x in only.labels.collect()))
    assert g.timing["queries"] == 3 and g.timing["labels"] == 12 and g.timing["query_s"] >= g.timing["label_s"] > 0
    with pytest.raises(IndexFailure):
        g.query([1, 77])
    with pytest.raises(InvalidInput):
        g.query_consensus([1, 1, 2])
    g.clear()
    with pytest.raises(IndexFailure):
        g.query([1, 2])


def test_wrong_clusterer_is_an_error(spark):
    g = path4(spark)
    g.clusterer = lambda n, i, j, a, k: [0]
    with pytest.raises(Exception, match="labels"):
        g.query([1])
    assert issubclass(IndexFailure, GraphClusterError)


def test_consensus(spark):
    g = path4(spark, num_trials=3)
    c = g.query_consensus([1, 2, 3], "uniform")
    assert all(math.isclose(r["weight"], 1 / 3) for r in c.trials.collect()) and c.num_trials == 3 and c.num_nodes == 3 and c.trial_indices == [0, 1, 2]
    assert math.isclose(c.score_pair(2, 2), 1.0)
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    assert c.threshold_pairs(pairs, 0.0).count() == 2
    assert [r["members"] for r in consensus.component_lists(c.connected_components(pairs, 0.0)).collect()] == [[1, 2, 3]]
    with pytest.raises(InvalidInput):
        c.score_pair(1, 99)
    assert g.score_pairs([]).count() == 0 and g.score_pairs([(1, 2)]).count() == 1
    assert c.score_matrix().where("u = v").count() == 3
    dense = {r["node"]: r["scores"] for r in c.dense_matrix().collect()}
    assert sorted(dense) == [1, 2, 3] and all(len(x) == 3 for x in dense.values()) and math.isclose(dense[2][1], 1.0)
    sparse = {(r["u"], r["v"]): r["score"] for r in c.score_matrix().collect()}
    assert all(math.isclose(dense[u][v - 1], sparse.get((u, v), 0.0)) for u in dense for v in dense)
    assert set(c.num_clusters) == {0, 1, 2}
    seen = consensus.first_seen(spark.createDataFrame([(5, 3), (3, 9), (1, 5)], "u long, v long").coalesce(1)).orderBy("pos")
    assert [r["node"] for r in seen.collect()] == [5, 3, 9, 1]


def test_weightings(spark):
    scores = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "trial int, total_score double")
    w = [r["weight"] for r in consensus.trial_weights(scores, "inverse_score").orderBy("trial").collect()]
    assert np.allclose(w, np.array([1, 0.5, 0.25]) / 1.75)
    w = [r["weight"] for r in consensus.trial_weights(scores).orderBy("trial").collect()]
    x = np.exp(-np.array([0, 1, 3]) / np.std([1, 2, 4]))
    assert np.allclose(w, x / x.sum())
    for how in (("nope", None), ("score_softmax", 0.0), ("score_softmax", float("nan"))):
        with pytest.raises(InvalidInput):
            consensus.trial_weights(scores, *how)
    with pytest.raises(InvalidInput):
        consensus.check_scores(spark.createDataFrame([(0, -1.0)], "trial int, total_score double"), "inverse_score")
    with pytest.raises(InvalidInput):
        consensus.check_scores(scores.limit(0), "uniform")
    with pytest.raises(InvalidInput):
        consensus.flat_pairs(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "pos int, node long"))
    for how, score in (("inverse_score", -1.0), ("score_softmax", float("nan")), ("inverse_score", float("inf"))):
        with pytest.raises(Exception, match="trial 0"):
            consensus.trial_weights(spark.createDataFrame([(0, score), (1, 1.0)], "trial int, total_score double"), how).collect()
    only = spark.createDataFrame([(0, 5.0)], "trial int, total_score double")
    assert consensus.trial_weights(only).first()["weight"] == 1.0
    tie = spark.createDataFrame([(1, 2.0), (0, 2.0), (2, float("nan"))], "trial int, total_score double")
    assert projection.winner(tie).first()["trial"] == 0


@pytest.mark.parametrize(("truth", "pred", "want"), [([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], 0.24242424242424243), ([0, 1, 1], [5, 3, 3], 1.0), ([0], [1], 1.0), ([], [], 1.0), ([0, 0, 0], [0, 1, 2], 0.0)])
def test_ari(spark, truth, pred, want):
    df = spark.createDataFrame(list(zip(truth, pred, strict=True)), "truth int, pred int")
    assert math.isclose(metrics.adjusted_rand_index(df).first()[0], want, abs_tol=1e-12)


def test_auc_and_precision(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(6) / 5, rng.randrange(2)) for _ in range(60)]
    df = spark.createDataFrame(rows, "score double, truth int")
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert math.isclose(metrics.roc_auc(df).first()[0], auc)
    ap = last = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp, n = sum(t for x, t in rows if x >= s), sum(x >= s for x, _ in rows)
        ap, last = ap + (tp / len(pos) - last) * tp / n, tp / len(pos)
    assert math.isclose(metrics.average_precision(df).first()[0], ap)
    assert math.isnan(metrics.roc_auc(df.where("truth = 1")).first()[0])


def test_balanced_pairs(spark):
    labels = spark.createDataFrame([(i, i // 5) for i in range(20)], "node long, label int")
    rows = metrics.balanced_pairs(labels, 101, 3).collect()
    assert len(rows) == 101 and sum(r["truth"] for r in rows) == 50
    assert all(r["u"] != r["v"] and (r["u"] // 5 == r["v"] // 5) == bool(r["truth"]) for r in rows)
    assert metrics.balanced_pairs(labels.where("label = 0"), 10, 3).where("truth = 0").count() == 0


def test_components_random(spark):
    rng = random.Random(8)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sbm_stream_against_a_loop(spark):
    p = sbm.SbmParams(seed=42, nodes_per_cluster=8, clusters=3, p_internal=0.5, q_external=0.02)
    ops = sbm.sbm_ops(spark, p).orderBy("seq").collect()
    arrivals = {r["time"]: (r["u"], r["v"]) for r in sbm._arrivals(spark, p).collect()}
    held, want = {}, []
    for t in range(p.updates):
        for e, d in ((arrivals.get(t - p.ticks_alive), -1), (arrivals.get(t), 1)):
            if e:
                held[e] = held.get(e, 0) + d
                want.append((t, *e, float(held[e]) if held[e] else None))
    assert [(r["time"], r["u"], r["v"], r["weight"]) for r in ops] == want
    truth = {r["node"]: r["label"] for r in sbm.truth_labels(spark, p).collect()}
    assert len(truth) == 24 and (truth[0], truth[8], truth[16]) == (0, 1, 2)
    with pytest.raises(InvalidConfig):
        sbm.SbmParams(1, 0, 1, 0.1, 0.1)


def test_replay_finds_the_planted_clusters(spark, tmp_path):
    p = sbm.SbmParams(seed=3, nodes_per_cluster=24, clusters=4, p_internal=0.6, q_external=0.01)
    config = IndexConfig(4, coreset_size=48, sampling_seeds=12, num_trials=3, rng_seed=1)
    runs = replay(spark, p, config, step=0.5, fraction=0.8, pairs=400)
    last = runs.orderBy(F.desc("batch")).first()
    assert last["ari"] > 0.5 and last["roc_auc"] > 0.75
    assert summary(runs).count() == 1 and early_batches(runs).count() >= 1
    write_report(runs, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "batches")).count() == runs.count()


def test_streaming_replays_a_failed_batch(spark, tmp_path):
    table = EdgeTable(spark, str(tmp_path / "edges"))
    table.apply(ops_of(spark, [(1, 2, 1.0), (2, 3, 1.0)]), 0)
    for _ in range(2):  # the same batch twice
        table.apply(ops_of(spark, [(1, 2, None), (3, 4, 2.0)]), 1)
    assert sorted(map(tuple, table.edges().collect())) == [(2, 3, 1.0), (3, 4, 2.0)]
    assert sorted(map(tuple, table.edges(0).collect())) == [(1, 2, 1.0), (2, 3, 1.0)]
    newest = EdgeTable(spark, str(tmp_path / "newest"), newest_only=True)
    late = ops_of(spark, [(1, 2, 9.0)])
    newest.apply(ops_of(spark, [(1, 2, 1.0), (2, 1, None)]), 0)
    newest.apply(late, 1)  # seq 0 again: older than the delete
    assert newest.edges().count() == 0


def test_streaming_loses_no_op(spark, tmp_path):
    """An invalid op takes no other op along, or fails the query; either way it is on record."""
    ops = [(1, 2, 1.0), (3, 3, 1.0), (4, 5, 1.0), (6, 7, -1.0), (8, 9, 1.0)]
    table = EdgeTable(spark, str(tmp_path / "a"))
    table.apply(ops_of(spark, ops), 0)
    assert sorted(r["src"] for r in table.edges().collect()) == [1, 4, 8]
    assert sorted((r["seq"], r["reason"], r["batch"]) for r in table.rejected().collect()) == [(1, "loop", 0), (3, "weight", 0)]
    strict = EdgeTable(spark, str(tmp_path / "b"), on_invalid="fail")
    with pytest.raises(IndexFailure):
        strict.apply(ops_of(spark, ops), 0)
    assert [r["src"] for r in strict.edges().collect()] == [1]
    assert [(r["seq"], r["reason"]) for r in strict.rejected().orderBy("seq").collect()] == [(1, "loop"), (2, "after"), (3, "weight"), (4, "after")]


@pytest.mark.parametrize("newest", [False, True])
def test_streaming_compacts(spark, tmp_path, newest):
    rng = random.Random(6)
    table, want, seq = EdgeTable(spark, str(tmp_path / "t"), newest_only=newest, compact_every=3), {}, 0
    for batch in range(8):
        ops = [(seq + i, *sorted(rng.sample(range(6), 2)), rng.choice([None, 1.0, 2.0])) for i in range(5)]
        seq += 5
        want.update({(u, v): w for _, u, v, w in ops})
        table.apply(spark.createDataFrame(ops, updates.OPS), batch)
        assert sorted(map(tuple, table.edges().collect())) == sorted((u, v, w) for (u, v), w in want.items() if w)
    assert table._versions("base") == [2, 5] and table._versions("delta") == [3, 4, 5, 6, 7] and table.latest() == 7


def test_names(spark):
    g = NamedIndex(GraphIndex(spark, IndexConfig(2, coreset_size=3, sampling_seeds=2, rng_seed=42)))
    s = g.update_edges([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "a", None)])
    assert (s.total, s.set, s.deleted, s.missing_deletes) == (4, 3, 0, 1)
    assert sorted(r["name"] for r in g.names.collect()) == ["string:a", "string:b", "string:c", "string:d"]
    got = g.query(["d", "a", "d"]).in_order().collect()
    assert [r["node"] for r in got] == ["d", "a", "d"] and got[0]["label"] == got[2]["label"]
    assert g.score_pairs([("a", "b"), ("a", "a")]).where("u = v").first()["score"] == 1.0
    with pytest.raises(IndexFailure, match="zz"):
        g.query(["a", "zz"])
    g.update_edges([(1, 2, 1.0), ("1", "2", 2.0)][:1])
    assert g.names.where("name = 'long:1'").count() == 1 and g.names.select("node").distinct().count() == 6
    g.update_edges([(1, 2, None)])
    g.release()
    assert g.names.count() == 4


def test_index_reads_deltas(spark):
    g = path4(spark)
    g.COMPACT_DELTAS = 3
    g.update_edge(9, 1, 5.0)
    assert not g.delete_edge(7, 8) and g.delete_edge(2, 1) and len(g._deltas) < 3
    assert sorted(map(tuple, g.edges.collect())) == [(1, 9, 5.0), (2, 3, 1.0), (3, 4, 1.0)]
    assert g.volume == 14.0 and sorted(map(tuple, g.neighbours(3).collect())) == [(2, 1.0), (4, 1.0)] and not g._deltas
    assert g.neighbourhoods([3, 9]).count() == 3 and g.intersecting([3], [4, 9, 4]).first()["ord"] == 0
    for lost in (lambda: g.neighbourhoods([3, 77]), lambda: g.intersecting([77], [3])):
        with pytest.raises(IndexFailure, match="77"):
            lost()


def test_seeds_are_drawn_in_proportion_to_the_masses(spark):
    """The acceptance loop against the masses of sequential draws, by chi-square over many trials."""
    edges = [(0, 1, 4.0), (0, 2, 1.0), (1, 2, 0.1), (2, 3, 2.0), (3, 4, 0.2), (4, 5, 3.0), (0, 5, 0.3), (5, 6, 1.0)]
    e = spark.createDataFrame(edges, updates.EDGES)
    nodes, trials = updates.degrees(e), sampling.trials_table(spark, 3, 500)
    base = sampling.base_mass(nodes, 0.4)
    got = {}
    for r in sampling.seed_schedule(e, base, trials, 4).collect():
        got.setdefault(r["trial"], {})[r["step"]] = r["node"]
    deg = {r["node"]: r["degree"] for r in nodes.collect()}
    want, seen = [dict.fromkeys(deg, 0.0) for _ in range(2)], [dict.fromkeys(deg, 0) for _ in range(2)]
    for steps in got.values():
        f = {v: 0.4 + 0.4 * deg[v] / max(deg.values()) for v in deg}
        for k in range(4):
            if k >= 2:
                for v in deg:
                    want[k - 2][v] += f[v] / sum(f.values())
                seen[k - 2][steps[k]] += 1
            p = steps[k]
            f[p] = 0.0
            for a, b, w in edges:
                if p in (a, b):
                    q = a + b - p
                    f[q] = min(f[q], w / deg[p])
    for k in range(2):
        chi = sum((seen[k][v] - want[k][v]) ** 2 / want[k][v] for v in deg if want[k][v])
        assert chi < 22.5, (seen[k], want[k])  # 0.1 % of 6 degrees of freedom


def test_draws_over_sparse_ids(spark):
    """Ids far apart lie in few ranges; the draws are those of one cumulative sum in order."""
    rng = random.Random(3)
    mass = sorted((rng.randrange(1 << 60), rng.uniform(0.1, 2)) for _ in range(50))
    table = sampling.ranges(spark.createDataFrame([(0, n, m) for n, m in mass], "trial int, node long, mass double").repartition(4), "node")
    assert table.select("block").distinct().count() <= 2
    asks = [(0, i, (i + 0.5) / 40) for i in range(40)]
    total, want = sum(m for _, m in mass), []
    for _, _, u in asks:
        at, up = u * total, 0.0
        for n, m in mass:
            up += m
            if up >= at:
                want.append(n)
                break
    got = sampling.draw(table, spark.createDataFrame(asks, "trial int, i int, u double")).orderBy("i").collect()
    assert [r["node"] for r in got] == want


def test_running_sums_over_ranges(spark):
    rows = [(random.Random(i).random(), i) for i in range(200)]
    got = running(spark.createDataFrame(rows, "x double, n int").repartition(5), [F.desc("x")], {"s": "n"}).collect()
    assert {r["n"]: r["s"] for r in got} == {n: sum(m for y, m in rows if y >= x) for x, n in rows}


def test_scaling_and_control(spark):
    p = sbm.SbmParams(seed=3, nodes_per_cluster=12, clusters=3, p_internal=0.8, q_external=0.01)
    config = IndexConfig(3, coreset_size=16, sampling_seeds=default_sampling_seeds(1, 16), num_trials=1, rng_seed=1, expected_edges_per_node=expected_edges_per_node(12, 3, 0.8, 0.01))
    runs = trial_scaling(spark, p, config, [1, 2], step=1.0, fraction=1.0, pairs=50)
    assert sorted(r["num_trials"] for r in summary(runs).collect()) == [1, 2] and config.sampling_seeds == 8 and config.expected_edges_per_node == 9
    ops = sbm.sbm_ops(spark, p).select("seq", "u", "v", "weight")
    labels, quality = control_leiden(updates.merge(updates.empty_edges(spark), ops), sbm.truth_labels(spark, p))
    assert quality > 0.9 and labels.count() <= 36


def test_coreset_matrix_checks(spark):
    with pytest.raises(IndexFailure):
        coreset.check_matrix(spark.createDataFrame([(0, 0, 1, -1.0)], "trial int, i int, j int, a double"))


def test_seed_repair_against_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    lines = [(rng.randrange(1, 40), rng.randrange(1, 12)) for _ in range(300)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["seed_repair"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(catalog.ORACLES["seed_repair"])
    assert got.columns == [c[0] for c in want.description]
    key = lambda r: tuple(r)[:2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)
