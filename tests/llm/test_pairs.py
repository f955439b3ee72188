"""Jaccard join, line dedup and passages against brute force."""

import hashlib
import os
import random
import re
import string
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from grafold.llm import jaccard_join, line_dedup, passage_dedup
from grafold.llm import textwords as T
from grafold.operators import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_groups(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10), (2, 6, 10), (1, 1, 2)])
def test_jaccard_join_is_exact(odd_docs, odd_texts, k, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_groups(odd_docs, k, num, den).collect()}
    assert got == brute_groups(odd_texts, k, num, den)


def test_jaccard_join_in_tiles(odd_docs, odd_texts, monkeypatch):
    """Pools larger than a tile give the same."""
    monkeypatch.setattr(jaccard_join, "TILE_DOCS", 8)
    monkeypatch.setattr(jaccard_join, "TILE_SHINGLES", 700)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_groups(odd_docs, 3, 7, 10).collect()}
    assert got == brute_groups(odd_texts, 3, 7, 10)


def test_jaccard_join_of_repeated_rows_and_nothing(spark, odd_docs):
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_groups(twice, 3, 9, 10).collect()))
    assert got == [(1, 2, 1, 1), (2, 2, 1, 1), (3, 0, 3, 0)]
    assert jaccard_join.jaccard_groups(odd_docs.limit(0)).count() == 0


def test_signatures_meet_for_every_linked_pair():
    """The pigeonhole itself: probe and index share a key whenever the sets are similar enough."""
    rng = np.random.default_rng(3)
    for num, den in ((8, 10), (90, 100), (6, 10)):
        plan = jaccard_join.Plan(num, den)
        for _ in range(300):
            n = int(rng.integers(2, 400))
            a = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64))
            gone = int(rng.integers(0, n // 3 + 1))
            new = int(rng.integers(0, n // 3 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 1 << 56, new, dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if not len(b) or inter == len(a) == len(b) or not plan.linked(inter, len(a) + len(b)):
                continue
            doc = np.repeat([0, 1], [len(a), len(b)])
            rows, sig, role = jaccard_join.signatures(plan, doc, np.concatenate([a, b]), np.array([len(a), len(b)]))
            held = [set(sig[(rows == d) & (role & 1 > 0)].tolist()) for d in (0, 1)]
            asks = [set(sig[(rows == d) & (role & 2 > 0)].tolist()) for d in (0, 1)]
            assert held[0] & asks[1] or held[1] & asks[0]


def brute_lines(texts, least, docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= least and len(held[key(x)]) >= docs and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("batches", "adaptive"), [(1, "false"), (3, "true"), (9, "false")])
def test_line_dedup(spark, batches, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        _line_dedup(spark, batches)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")


def _line_dedup(spark, batches):
    rng = random.Random(5)
    pool = ["Line number %d with some forty characters in all" % i for i in range(30)] + ["short", "", "  É umlaut line that is exactly as long as need be  "]
    texts = [(i, None if i % 17 == 0 else "\n".join(rng.choice([x, x.upper(), f"\t{x} "]) for x in rng.choices(pool, k=rng.randrange(8)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, n_lines int").repartition(3)
    got = sorted(map(tuple, line_dedup.dedup_lines(docs, batches=batches, digest=True).collect()))
    assert got == brute_lines(texts, 40, 5)
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == ["doc_id", "text", "n_lines", "n_dropped"] and kept.count() == 60
    assert line_dedup.dedup_lines(docs.limit(0), digest=True).count() == 0


def test_line_runs_opened_again(spark, tmp_path):
    """Batches added by several openings sum to the same; the merge of a batch shuffles no run."""
    rng = random.Random(17)
    path, want = str(tmp_path / "runs"), {}
    for b in range(7):
        rows = [(h, -h, rng.randrange(1, 4), 100 * b + rng.randrange(100)) for h in rng.sample(range(60), 25)]
        for hi, lo, n, last in rows:
            old = want.get((hi, lo), (0, 0))
            want[hi, lo] = (old[0] + n, max(old[1], last))
        runs = line_dedup.LineRuns(spark, path, fanout=3, buckets=2)
        assert runs.version == b
        runs.add(spark.createDataFrame(rows, line_dedup._RUN))
    got = line_dedup.LineRuns(spark, path)
    assert {(r["hi"], r["lo"]): (r["n_docs"], r["last"]) for r in got.all().collect()} == want and got.buckets == 2
    assert [len(level) for level in got.levels] == [1, 2]
    a, b = (spark.table(level[0][0]) for level in got.levels)
    plan = a.join(b.select("hi", "lo").hint("merge"), ["hi", "lo"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_line_dedup_of_null_ids_and_long_lines(spark):
    line = "the same long line that stands in all of the documents"
    long = "word " * 200_000
    docs = spark.createDataFrame([(None, line), (None, line + "\n" + long)] + [(i, line + "\n" + long) for i in range(4)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(None, 1, 1), (None, 2, 2), (0, 2, 2), (1, 2, 2), (2, 2, 2), (3, 2, 0)], key=str)


def test_line_dedup_counts_a_repeated_document_once(spark):
    line = "a line of more than forty characters, surely so"
    docs = spark.createDataFrame([(1, line)] * 5 + [(2, line)], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()} == {0}


def test_compact_windows_are_the_large_nodes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n, least = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        h = rng.permutation(n).astype(np.uint64) << np.uint64(40)
        edge = np.sort(np.concatenate([[0], rng.integers(0, n + 1, 2), [n]]))
        got = sorted(zip(*(x.tolist() for x in passage_dedup.compact_windows(h, edge[:-1], edge[1:], least)), strict=True))
        want = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            for c in range(a, b):
                lo = hi = c
                while lo > a and h[lo - 1] > h[c]:
                    lo -= 1
                while hi + 1 < b and h[hi + 1] > h[c]:
                    hi += 1
                if hi - lo + 1 >= least:
                    want.append((lo, c, hi))
        assert got == sorted(want)


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "w%d" % rng.randrange(100000)
    fresh = lambda n: [word() for _ in range(n)]
    shared, near = fresh(80), fresh(120)
    changed = list(near)
    for at in (30, 80):
        changed[at] = word()
    docs = [(i, fresh(200)) for i in range(40)]
    for i in (3, 7, 21, 22):
        docs[i][1][50:50] = shared
    docs[10][1][20:20], docs[11][1][90:90] = near, changed
    docs[30][1][10:10], docs[31][1][10:10] = shared[:30], shared[:30]  # too short
    table = [(i, " ".join(w)) for i, w in docs] + [(90, None), (91, ""), (92, "for " * 5000), (93, "for " * 900)]
    df = spark.createDataFrame([(i, t, 1) for i, t in table], "doc_id long, text string, lead int").repartition(4)
    rows = passage_dedup.repeated_passages(df).collect()
    assert {r["doc_id"] for r in rows} == {3, 7, 21, 22, 10, 11, 92, 93}
    for i in (3, 7, 21, 22):
        assert any(r["start_word"] <= 50 and r["start_word"] + r["n_words"] >= 130 for r in rows if r["doc_id"] == i)
    best = max(r["similarity"] for r in rows if r["doc_id"] == 10)
    a, b = (frozenset(zip(*(x[j:] for j in range(5)), strict=False)) for x in (near, changed))
    assert best >= len(a & b) / len(a | b) - 1e-9 >= 0.8
    assert passage_dedup.repeated_passages(df.limit(0)).count() == 0


def _holds_passage(a, b, least=46, most=58):
    """Whether some window of each has a Jaccard similarity of 0.8 or more, by trying all."""
    for i in range(len(a) - least + 1):
        for end in range(i + least, min(i + most, len(a)) + 1):
            x = set(a[i:end].tolist())
            for j in range(len(b) - least + 1):
                for stop in range(j + least, min(j + most, len(b)) + 1):
                    y = set(b[j:stop].tolist())
                    if len(x & y) * 10 >= len(x | y) * 8:
                        return True
    return False


def _verified(a, b):
    order = np.argsort(b, kind="stable")
    return passage_dedup.common_passages(a, b, b[order], order, 46, 8, 10)


def test_passage_inside_a_weak_chain():
    a = np.arange(1, 151, dtype=np.uint64)
    b = a + np.uint64(1000)
    for at, n in ((0, 30), (35, 30), (80, 1)):
        b[at : at + n] = a[at : at + n]
    assert [p[:4] for p in _verified(a, b)] == [(0, 65, 0, 65)]


def test_uneven_edits_against_all_windows():
    rng = np.random.default_rng(4)
    fresh = lambda n: rng.integers(0, 1 << 60, n).astype(np.uint64)
    outcomes = set()
    for case in range(24):
        base = fresh(50)
        near = base.copy()
        for _ in range(case % 4):
            at, n = rng.integers(0, 48), int(rng.integers(1, 6))
            near[at : at + n] = fresh(len(near[at : at + n]))
        if case % 5 == 4:
            near = np.concatenate([near[24:], near[:24]])
        a, b = np.concatenate([fresh(4), base, fresh(3)]), np.concatenate([fresh(2), near, fresh(4)])
        b[-1] = base[rng.integers(0, 50)]
        got = _verified(a, b)
        for i, n, j, m, s in got:
            x, y = set(a[i : i + n].tolist()), set(b[j : j + m].tolist())
            assert min(n, m) >= 46 and s >= 0.8 and abs(len(x & y) / len(x | y) - s) < 1e-9
        assert bool(got) == _holds_passage(a, b)
        outcomes.add(bool(got))
    assert outcomes == {True, False}


def test_periodic_passages_against_all_windows():
    """Repeated blocks, edited, cut and continued: a passage is found where there is one."""
    rng = np.random.default_rng(14)
    outcomes = []
    for case in range(60):
        block = rng.integers(0, 6 if case % 2 else 1 << 50, int(rng.integers(1, 20))).astype(np.uint64)
        sides = []
        for _ in range(2):
            own = block.copy()
            for _ in range(case % 4):
                own[rng.integers(0, len(own))] = rng.integers(0, 1 << 50)
            x = np.tile(own, 60)[: int(rng.integers(46, 58))]
            if case % 3:
                x[rng.integers(0, len(x))] = rng.integers(0, 1 << 50)
            sides.append(np.concatenate([rng.integers(0, 1 << 50, int(rng.integers(0, 5))).astype(np.uint64), x, rng.integers(0, 1 << 50, int(rng.integers(0, 5))).astype(np.uint64)]))
        a, b = sides
        got = _verified(a, b)
        for i, n, j, m, s in got:
            x, y = set(a[i : i + n].tolist()), set(b[j : j + m].tolist())
            assert min(n, m) >= 46 and s >= 0.8 and abs(len(x & y) / len(x | y) - s) < 1e-9
        outcomes.append(bool(got))
        assert bool(got) == _holds_passage(a, b, most=70), case
    assert 10 < sum(outcomes) < 55


def test_very_common_shingles():
    """Beyond the seeds that are all tried: long runs of one word, alone on both sides or shared in no run."""
    a = np.concatenate([np.full(400, 7), np.arange(100, 160)]).astype(np.uint64)
    b = np.concatenate([np.arange(300, 360), np.full(500, 7)]).astype(np.uint64)
    (found,) = _verified(a, b)
    assert found[4] >= 0.8 and found[1] >= 46 and found[3] >= 46
    order = np.arange(2)
    assert passage_dedup._runs(a, np.array([1, 2], np.uint64), np.array([1, 2], np.uint64), order) == []


def test_runs_do_not_depend_on_the_number_of_equal_shingles(monkeypatch):
    """All runs that lie within no other, against all pairs, and the same ones beside stretches of one shingle."""
    rng = np.random.default_rng(8)

    def runs(a, b):
        order = np.argsort(b, kind="stable")
        return passage_dedup._runs(a, b, b[order], order)

    def longest(a, b, i, j):
        n = 0
        while max(i, j) + n < 60 and a[i + n] == b[j + n]:
            n += 1
        return n

    for few in (256, 0):
        monkeypatch.setattr(passage_dedup, "FEW", few, raising=False)
        for values in (1, 2, 5, 40):
            a, b = (rng.integers(0, values, 60).astype(np.uint64) for _ in range(2))
            every = [(i, j, longest(a, b, i, j)) for i in range(60) for j in range(60) if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1])]
            x = np.array([(i, j, -i - n, -j - n) for i, j, n in every])
            want = [r for r, y in zip(every, x, strict=True) if ((x <= y).all(1)).sum() == 1]
            assert runs(a, b) == sorted(want)
            same = np.full(300, 99)
            wide = [np.concatenate([side, np.arange(k, k + 5), same]).astype(np.uint64) for side, k in ((a, 100), (b, 200))]
            assert [r for r in runs(*wide) if r[0] < 60 and r[1] < 60] == sorted(want)


def test_recall_of_near_copies_and_of_repeats_with_shared_phrases(spark):
    rng = random.Random(12)
    fresh = lambda n: ["w%d" % rng.randrange(10**7) for _ in range(n)]
    docs, near, exact = [], [], []
    for i in range(150):  # similarity 41 / 51
        passage = fresh(50)
        changed = list(passage)
        changed[rng.randrange(10, 40)] = "changed%d" % i
        near.append((len(docs), len(docs) + 1))
        docs += [fresh(20) + passage + fresh(20), fresh(9) + changed + fresh(30)]
    for _ in range(60):  # half of the passage in documents before, between and after
        passage = fresh(52)
        phrases = [passage[:13], passage[26:39]]
        at = len(docs)
        exact.append((at + 4, at + 9))
        docs += [fresh(10) + (passage if x in (4, 9) else phrases[x % 2]) + fresh(10) for x in range(12)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    pairs = {(r["doc_id"], r["match_doc_id"]) for r in passage_dedup.repeated_passages(df).collect()}
    assert all(p in pairs for p in exact)
    assert sum(p not in pairs for p in near) <= 2


def test_copies_stand_behind_the_smallest_document_of_their_text(spark):
    rng = random.Random(31)
    fresh = lambda n: ["w%d" % rng.randrange(10**7) for _ in range(n)]
    passage, quoted, other = fresh(80), fresh(60), fresh(70)
    text = " ".join(passage + quoted)
    docs = [(i, text) for i in range(40)]
    docs += [(40, text.replace(" ", "\n").upper()), (41, " ".join(fresh(20) + quoted + fresh(20))), (42, text + " more")]
    # A document of several texts counts by the largest, so the copies of one of them do not stand behind it.
    docs += [(50, "a " + " ".join(other)), (50, "b " + " ".join(fresh(60))), (51, "a " + " ".join(other)), (52, "a " + " ".join(other)), (60, "alone " + " ".join(fresh(60)))]
    rows = passage_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    places = {tuple(r)[:6] for r in rows}
    assert len(places) == len(rows)
    assert {r[:2] + r[3:] for r in ((r["doc_id"], r["start_word"], r["n_words"], r["match_doc_id"], r["match_start"]) for r in rows if r["doc_id"] in range(1, 41))} == {(i, 0, 0, 0) for i in range(1, 41)}
    assert {p for p in places if p[0] == 0 and p[3] in range(1, 41)} == {(0, 0, 140, i, 0, 140) for i in range(1, 41)}
    assert {p[0] for p in places if p[3] == 0} == set(range(1, 43)) and (41, 20, 60, 0, 80, 60) in places
    assert {p[:4:3] for p in places if p[0] >= 50} == {(51, 52), (52, 51)}


def test_no_shuffle_files_of_the_windows_stay(spark):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(_slices(random.Random(5), 60, 0))], "doc_id long, text string").repartition(4)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getPath() for i in range(found.size()) if "shuffle_" in found.apply(i).getName()}

    earlier = files()
    passages = passage_dedup.repeated_passages(df)
    kept = spark.range(100).repartition(2).groupBy("id").count()
    assert kept.count() == 100
    for _ in range(50):
        size = sum(os.path.getsize(f) for f in files() - earlier if os.path.exists(f))
        if size < 200_000:
            break
        time.sleep(0.1)
    assert size < 200_000  # 60 documents have 14,000 windows and runs: 330,000 bytes and more
    assert spark.conf.get(components.CLEANUP) == "false"
    assert passages.count() and passages.count()


def test_long_document_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(passage_dedup, "BLOCK", 512)
    monkeypatch.setattr(passage_dedup, "OVERLAP", 128)
    rng = random.Random(2)
    long = ["v%d" % rng.randrange(10**6) for _ in range(3000)]
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[1500:1580]))], "doc_id long, text string")
    # The setting is read where the rows are made; workers import their own, so the cut is tested directly.
    edge = np.array([0, 2996, 3072])
    covered = np.zeros(3072, bool)
    for a, b, bounds in passage_dedup._blocks(edge):
        assert b - a <= 4 * 512 and bounds[0] == a and bounds[-1] == b
        covered[a:b] = True
    assert covered.all()
    assert {r["doc_id"] for r in passage_dedup.repeated_passages(df).collect()} == {1, 2}


def test_words_and_sets():
    texts = ["A b a b a b", "", "one", "\x00 \x0b x\x00y é", "a b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    w = T.words(data, offsets)
    assert w.counts().tolist() == [6, 0, 1, 3, 2]
    _, _, n = T.shingle_sets(w, 3)
    assert n.tolist() == [2, 0, 1, 1, 1]
    loose = T.words(np.frombuffer("É,b".encode(), np.uint8), np.array([0, 4]), loose=True)
    assert loose.hash.tolist() == T.words(np.frombuffer("é b".encode(), np.uint8), np.array([0, 4])).hash.tolist()


def test_every_repeat_shares_a_chosen_run():
    """Whatever stands around a repeated stretch, and however it repeats itself, both sides choose one run of it."""
    rng = np.random.default_rng(6)
    for case in range(200):
        least = int(rng.integers(6, 50))
        run = passage_dedup.shared_run(least, 8, 10)
        assert run * 10 >= (2 * least - run) * 8 and (run - 1) * 10 < (2 * least - run + 1) * 8
        few = int(rng.choice([1, 2, 3, 8, 10**6]))
        fresh = lambda n: T.mix64(rng.integers(0, few, n).astype(np.uint64) + np.uint64(case % 7))  # noqa: B023, E731
        if case % 3 == 0:  # of one period
            shared = np.tile(fresh(int(rng.integers(1, 9))), 50)[:least]
        else:
            shared = fresh(least)
        parts = [np.concatenate([fresh(int(rng.integers(0, 60))), shared, fresh(int(rng.integers(0, 60)))]) for _ in range(2)]
        edge = np.cumsum([0, *map(len, parts)])
        at, key = passage_dedup.chosen_runs(np.concatenate(parts), edge[:-1], edge[1:], least, run)
        for e in edge[1:]:
            assert not ((at < e) & (at + run > e)).any()
        assert set(key[at < edge[1]].tolist()) & set(key[at >= edge[1]].tolist())
        # One of all least neighbours.
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            for i in range(a, b - least + 1):
                assert ((at >= i) & (at + run <= i + least)).any()


def _slices(rng, n, edits):
    """Documents that quote slices of 50 to 70 words of one source, between words of their own."""
    source = ["s%d" % i for i in range(2000)]
    out = []
    for i in range(n):
        at, size = rng.randrange(1930), rng.randrange(50, 71)
        quoted = source[at : at + size]
        for _ in range(edits):
            quoted[rng.randrange(size)] = "e%d" % rng.randrange(10**8)
        out.append(["o%d" % rng.randrange(10**8) for _ in range(40)] + quoted + ["o%d" % rng.randrange(10**8) for _ in range(40)])
    return out


def test_overlapping_slices_against_all_windows(spark):
    """Exact repeats: every document that has one is found, and nearly all its repeated windows are covered."""
    texts = _slices(random.Random(21), 400, 0)
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for j in range(len(t) - 49):
            held[tuple(t[j : j + 50])].add(i)
    repeated = {i for docs in held.values() if len(docs) > 1 for i in docs}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = passage_dedup.repeated_passages(df).collect()
    found = {r["doc_id"] for r in rows}
    assert repeated <= found
    spans = defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
    windows = [(i, j) for i in repeated for j in range(len(texts[i]) - 49) if len(held[tuple(texts[i][j : j + 50])]) > 1]
    covered = sum(any(a <= j and j + 50 <= b for a, b in spans[i]) for i, j in windows)
    assert covered / len(windows) >= 0.95


def test_slices_with_edits_against_all_pairs(spark):
    texts = _slices(random.Random(22), 150, 1)
    hashed = [T.shingles(T.words(np.frombuffer(" ".join(t).encode(), np.uint8), np.array([0, len(" ".join(t))])), 5, whole=False)[1] for t in texts]
    want = set()
    for i, a in enumerate(hashed):
        for j in range(i):
            if len(np.intersect1d(a, hashed[j])) >= 36 and _verified(a, hashed[j]):
                want |= {i, j}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r["doc_id"] for r in passage_dedup.repeated_passages(df).collect()}
    assert found <= want and len(found) >= 0.9 * len(want) > 40, (len(found), len(want))


def test_crowded_chunks_change_no_document(spark, monkeypatch):
    rng = random.Random(23)
    texts = [" ".join(t) for t in _slices(rng, 80, 0)] + [" ".join(["c%d" % i for i in range(70)] + ["o%d" % rng.randrange(10**8) for _ in range(30)]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r["doc_id"] for r in passage_dedup.repeated_passages(df.coalesce(1)).collect()}
    many = {r["doc_id"] for r in passage_dedup.repeated_passages(df.repartition(30)).collect()}
    assert one == many and set(range(80, 200)) <= one


def test_pages_of_one_template_part_before_the_tiles(spark, monkeypatch):
    """Unlinked sets that share half of their shingles give no pool of many tiles; linked ones stay together."""
    rng = random.Random(31)
    template = ["t%d" % i for i in range(120)]
    texts = [" ".join(template + ["o%d" % rng.randrange(10**8) for _ in range(rng.randrange(50, 100))]) for _ in range(150)]
    texts += [edit(rng, texts[i]) for i in range(0, 40) for _ in range(2)]
    monkeypatch.setattr(jaccard_join, "TILE_DOCS", 16)
    pools = []
    inner = jaccard_join._smaller_pools
    monkeypatch.setattr(jaccard_join, "_smaller_pools", lambda members, *rest: pools.append((members.count(), inner(members, *rest))) or pools[-1][1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_groups(df, 5, 8, 10).collect()}
    assert got == brute_groups(list(enumerate(texts)), 5, 8, 10)
    (before, after), = pools
    assert before > 100 and max(r["count"] for r in after.groupBy("pool").count().collect()) <= 3


def edit(rng, text):
    w = text.split()
    w[rng.randrange(len(w))] = "e%d" % rng.randrange(10**8)
    return " ".join(w)


def test_crowded_signatures_are_linked_within_a_chunk():
    sig = np.array([5] * 12 + [6] * 12 + [7] * 3, np.uint64)
    of, role = np.arange(27), np.array([3] * 12 + [1] * 12 + [3] * 3)
    stays, near, far = jaccard_join._crowded(sig, of, role)
    assert stays.tolist() == [True] + [False] * 11 + [True] * 15 and near.tolist() == list(range(1, 12)) and set(far.tolist()) == {0}
