"""The op log: merges, statistics, aborts, node ops; against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from grafold.functions.errors import IndexFailure, InvalidInput, InvalidWeight
from grafold.functions.scalars import trial_seed
from grafold.operators import neighbours, updates
from grafold.plans.index import GraphIndex, IndexConfig
from grafold.sources.tables import ops_of


def small(spark, **more):
    return GraphIndex(spark, IndexConfig(2, coreset_size=3, sampling_seeds=2, rng_seed=42, **more))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_trial_seed():
    assert [trial_seed(42, t) for t in range(3)] == [12058926934050108962, 13679457532755275413, 2949826092126892291]


def test_last_write_wins_and_degrees(spark):
    g = small(spark)
    g.update_edges([(1, 2, 1.5), (2, 1, 2.5)])
    assert rows(g.edges) == [(1, 2, 2.5)] and rows(g.nodes) == [(1, 2.5), (2, 2.5)]
    g.clear()
    g.update_edges([(1, 2, 1.0), (1, 2, 2.5), (1, 3, 1.5)])
    before = g.edges
    assert rows(g.nodes) == [(1, 4.0), (2, 2.5), (3, 1.5)]
    ops = ops_of(spark, [(1, 2, None)])
    after = updates.merge(before, ops)
    diff = updates.node_ops(before, after, ops)
    assert rows(diff)[0] == (1, 1.5) and (2, None) in rows(diff)
    assert rows(updates.apply_node_ops(updates.degrees(before), diff)) == [(1, 1.5), (3, 1.5)]


def test_stats_liveness_and_missing_deletes(spark):
    g = small(spark)
    s = g.update_edges([(1, 2, 1.0), (2, 3, 1.0), (1, 2, None), (1, 2, None)])
    assert (s.total, s.set, s.deleted, s.missing_deletes) == (4, 2, 1, 1)
    assert [r.node for r in g.live_nodes().collect()] == [2, 3] and not g.contains_node(1) and g.contains_node(2)
    assert g.delete_edge(8, 9) is False and g.delete_edge(3, 2) is True and g.live_node_count() == 0


@pytest.mark.parametrize(("bad", "error"), [((1, 1, 1.0), IndexFailure), ((5, 5, None), IndexFailure), ((1, 2, float("nan")), InvalidWeight), ((1, 2, 0.0), InvalidWeight), ((1, 2, float("inf")), InvalidWeight), ((-1, 2, 1.0), InvalidInput)])
def test_prefix_is_kept_when_an_op_fails(spark, bad, error):
    g = small(spark)
    with pytest.raises(error):
        g.update_edges([(1, 2, 1.0), bad, (3, 4, 1.0)])
    assert rows(g.edges) == [(1, 2, 1.0)]


def test_random_batches_against_replay(spark):
    rng = random.Random(3)
    for _ in range(3):
        held, g = {}, small(spark)
        for _ in range(2):
            ops, want = [], [0, 0, 0]
            for _ in range(60):
                u, v = rng.sample(range(6), 2)
                w = rng.choice([None, 1.0, 2.0])
                ops.append((u, v, w))
                k = (min(u, v), max(u, v))
                if w is None:
                    want[1 if k in held else 2] += 1
                    held.pop(k, None)
                else:
                    want[0] += 1
                    held[k] = w
            s = g.update_edges(ops)
            assert [s.set, s.deleted, s.missing_deletes] == want
            assert rows(g.edges) == sorted((*k, w) for k, w in held.items())


def test_duplicate_node_op_is_an_error(spark):
    nodes = spark.createDataFrame([(1, 1.0)], updates.NODES)
    with pytest.raises(IndexFailure):
        updates.apply_node_ops(nodes, spark.createDataFrame([(1, 2.0), (1, 3.0)], updates.NODES))


def test_look_ups(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (1, 4, 3.0)], updates.EDGES)
    sources = spark.createDataFrame([(0, 1), (1, 2)], "pos int, node long")
    targets = spark.createDataFrame([(0, 3), (1, 4), (2, 99), (3, 3)], "ord int, node long")
    assert rows(neighbours.intersecting(sources, targets, edges)) == [(0, 1, 3, 0, 2.0), (0, 1, 4, 1, 3.0)]
    triangle = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 3, 3.0)], updates.EDGES)
    batch = spark.createDataFrame([(0, 1), (1, 3)], "pos int, node long")
    assert rows(neighbours.induced(batch, triangle)) == [(0, 1, 3, 1, 2.0), (1, 3, 1, 0, 2.0)]
    assert rows(neighbours.fold(sources, targets, edges)) == [(1, 2, 5.0)]
    with pytest.raises(Exception, match="unknown node 9"):
        neighbours.neighbourhoods(spark.createDataFrame([(0, 1), (1, 9)], "pos int, node long"), edges).count()
    assert rows(neighbours.visit(sources, targets, edges, F.max("weight").alias("most"))) == [(1, 3.0)]
    assert rows(neighbours.neighbours_of(edges, 4)) and tuple(neighbours.size_volume(updates.degrees(edges)).first())[0] > 2
    assert neighbours.edge_weight(edges, 4, 1) == 3.0 and neighbours.edge_weight(edges, 2, 3) is None and neighbours.degree(edges, 1) == 6.0
    with pytest.raises(IndexFailure):
        neighbours.require_live(spark.createDataFrame([(9,)], "node long"), edges)
    assert neighbours.max_degree_node(updates.degrees(edges)).first()["node"] == 1


def test_six_nodes_and_mixed_batch(spark):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(1, 6)], updates.NODES)
    diff = spark.createDataFrame([(2, None), (3, 30.0), (4, None), (6, 6.0), (7, 7.0), (99, None)], updates.NODES)
    out = updates.apply_node_ops(nodes, diff).collect()
    assert len(out) == 5 and sum(r["degree"] for r in out) == 49
