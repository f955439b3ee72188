"""Nearest neighbours against brute force; the pipeline's stages; the registry."""

import numpy as np
import pyarrow as pa
import pytest

from grafold.llm import additive_ann
from grafold.llm.queries import ORACLES, QUERIES


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 24))
    v[100:160] = v[100]  # copies
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    odd = [(5000, None, 1), (5050, [0.0] * 24, 1), (5100, [float("nan")] * 24, 1), (5150, [1.0] * 23 + [None], 1), (5200, [float("inf")] * 24, 1), (5250, [1.0, 2.0], 1)]
    df = spark.createDataFrame([*rows, *odd, rows[3]], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = {}
    for r in additive_ann.nearest(df, df.where("vec_id % 50 = 0"), train_rows=1000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 50))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hit = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -2
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hit += len({f[1] for f in found} & set(want.tolist()))
    assert hit / (5 * len(got)) >= 0.9
    assert [f[1] for f in got[100]] == [101, 102, 103, 104, 105]  # ties go to the smaller id
    few = additive_ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert len(few) == 2 and additive_ann.nearest(df.limit(0), df.limit(0)).count() == 0


def _recall(spark, v, k=5, **how):
    """(recall at k of 100 queries against brute force, share of the rows reranked at most)."""
    n = len(v)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), v.shape[1]).cast(pa.list_(pa.float64()))})).repartition(4)
    got = {}
    for r in additive_ann.nearest(df, df.where(f"vec_id % {n // 100} = 0"), k, **how).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    hit = 0
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -2
        hit += len(found & set(np.argsort(-s)[:k].tolist()))
    return hit / (k * len(got))


@pytest.mark.parametrize(("d", "words"), [(64, 20_000), (256, 20_000)])
def test_recall_where_few_rows_are_reranked(spark, d, words):
    """Vectors without any structure, the worst case, in more than one list; 4 % of a block are reranked."""
    assert additive_ann.SHARE <= 0.05 and additive_ann.RERANK <= 0.05 * words / 3
    v = np.random.default_rng(d).normal(size=(words, d))
    assert _recall(spark, v, train_rows=2048) >= 0.9


def test_recall_of_clustered_vectors_in_few_lists(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    x = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    centre, _ = additive_ann._centres(x, 30, np.random.default_rng(3), True)
    assert additive_ann._probes(x, centre, 5, 0.97) <= 6
    assert _recall(spark, v, lists=30, train_rows=2000) >= 0.9


@pytest.mark.parametrize(("groups", "noise"), [(4, 1e-3), (4, 1e-5), (1, 1e-3)])
def test_recall_within_groups_of_nearly_equal_vectors(spark, groups, noise):
    """More rows than are reranked at first lie nearer to each other than codes or single precision tell."""
    rng = np.random.default_rng(3)
    v = 10 * rng.normal(size=(groups, 32))[rng.integers(0, groups, 3000)] + 10 * noise * rng.normal(size=(3000, 32))
    assert _recall(spark, v, train_rows=1000) >= 0.99


def test_lists_and_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(1, 16)), 300, axis=0)])  # half are copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist())], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, additive_ann.nearest(df, df.where("vec_id % 10 = 0"), rerank=700, lists=4).collect()))
    monkeypatch.setattr(additive_ann, "BLOCK", 40)
    monkeypatch.setattr(additive_ann, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, additive_ann.nearest(df, df.where("vec_id % 10 = 0"), rerank=700, lists=4).collect())) == whole
    assert len(whole) == 300 and [r[2] for r in whole if r[0] == 400] == [300, 301, 302, 303, 304]
    # The queries' own commonest length does not count.
    mixed = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (50, [1.0]), (100, [1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in additive_ann.nearest(mixed, mixed.where("vec_id % 50 = 0")).collect()] == [1, 2]


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    q = additive_ann.Quantiser.train(x, books=4, words=16)
    error = lambda beam: ((q.decode(q.encode(x, beam)[0]) - x) ** 2).sum()
    assert error(8) <= error(1)
    codes, norm = q.encode(x)
    assert np.allclose(norm, (q.decode(codes) ** 2).sum(axis=1))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    words = "the of and to in is that it was for on are as with his they at be this have from".split()
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(rng.choice(words) + str(rng.integers(50)) for _ in range(n))
    item, copy, line = "seven brave foxes of the old mill ran past nine grey barns at dawn", prose(80), "This very line stands in a great many of the documents here"
    texts = [prose(60) for _ in range(30)] + [copy, copy, copy + " end"] + [f"{prose(30)} {item} {prose(3)}"] + [f"{line}\n{prose(40)}" for _ in range(8)] + [None, "", "123"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        left.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert set(left[0]) == set(range(42))
    assert sum(line in t for t in left[1].values()) == 1 and line in left[1][41]
    assert set(left[0]) - set(left[2]) == {31, 32} and set(left[2]) - set(left[3]) == {33}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(left[3]) and all(r["n_tokens"] > 2 for r in got)


def test_registry():
    assert {int(q[2:].split("_")[0]) for q in QUERIES if q.startswith("op")} == set(range(1, 11)) and "pipeline" in QUERIES
    assert set(ORACLES) <= set(QUERIES)


def test_stages_send_short_batches(spark):
    """What a worker holds at once follows the batch, not the table."""
    import corpus_pipeline

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([(i, "some words of text %d" % i, "en", "s", 20) for i in range(5000)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    before = spark.conf.get(rows)

    def sizes(batches):
        for batch in batches:
            yield batch.slice(0, 1).select(["doc_id"]).set_column(0, "doc_id", pa.array([batch.num_rows]))

    try:
        for setting, most in (("10000", 1000), ("0", 1000), ("70", 70)):
            for _, stage in corpus_pipeline.STAGES[1:4:2]:
                spark.conf.set(rows, setting)
                stage(spark, df, "/root/testdata/sf0.001")
                assert max(r[0] for r in df.mapInArrow(sizes, "doc_id long").collect()) == most
    finally:
        spark.conf.set(rows, before)
