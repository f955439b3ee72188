"""Score matrices in tiles, against a loop, and what their plans hold."""

import itertools

import pytest

from grafold.operators import consensus

LABELS = [(t, n, None if (t, n) == (1, 5) else (n * (t + 3) + n // 7) % (4, 3, 50)[t]) for t in range(3) for n in range(60) if (t, n) != (2, 9)]
WEIGHTS = {0: 0.5, 1: 0.0, 2: 0.5}


@pytest.fixture
def tables(spark, monkeypatch):
    monkeypatch.setattr(consensus, "TILE", 7, raising=False)
    nodes = spark.createDataFrame([(n,) for n in [*range(50), 3, 3, 99]], "node long")  # repeats, one without labels
    return nodes, spark.createDataFrame(LABELS, "trial int, node long, label int"), spark.createDataFrame(list(WEIGHTS.items()), "trial int, weight double")


def _want() -> dict:
    at = {(t, n): x for t, n, x in LABELS}
    out = {}
    for u, v, t in itertools.product(range(50), range(50), WEIGHTS):
        if at.get((t, u)) is not None and at[t, u] == at.get((t, v)):
            out[u, v] = out.get((u, v), 0.0) + WEIGHTS[t]
    return out


def test_sparse_matrix_in_tiles(tables):
    scored = consensus.score_matrix(*tables)
    got = scored.collect()
    assert len(got) == len({(r["u"], r["v"]) for r in got}) and {(r["u"], r["v"]): r["score"] for r in got} == _want()
    # Pairs must not be shuffled or held to be added up: the join of pairs is the last such step.
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [u#" not in plan


def test_dense_matrix_row_by_row(tables, monkeypatch):
    monkeypatch.setattr(consensus, "ENTRIES", 100, raising=False)
    want, nodes = _want(), [*range(50), 99]
    dense = consensus.dense_matrix(*tables)
    assert {r["node"]: r["scores"] for r in dense.collect()} == {u: [want.get((u, v), 0.0) for v in nodes] for u in range(50)}
    # A look-up of each entry among the entries of its row is a search through that row.
    assert "element_at" not in dense._jdf.queryExecution().optimizedPlan().toString()
    total = consensus.dense_matrix(*tables, lambda scores: {"total": float(scores.sum())}, "total double")
    assert {r["node"]: r["total"] for r in total.collect()} == pytest.approx({u: sum(want.get((u, v), 0.0) for v in nodes) for u in range(50)})


def test_matrices_without_trials(spark, tables):
    none = spark.createDataFrame([], "trial int, weight double")
    assert consensus.score_matrix(tables[0], tables[1], none).count() == 0 == consensus.dense_matrix(tables[0], tables[1], none).count()
