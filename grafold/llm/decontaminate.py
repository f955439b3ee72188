"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of loose words (ASCII punctuation parts words, case is
folded). A document and an item meet by seeds, equal runs of ``MIN_MATCH`` words. A pair whose seeds
could cover enough of the item is tiled: the longest matches that overlap no earlier tile are marked
first, found at a falling search length by running Karp-Rabin hashes, down to ``MIN_MATCH`` words. The
pair is contaminated if the tiles cover at least ``threshold`` of the item's words. As tiles need not
be in order, a passage whose sentences were moved about is still covered.

Documents and items meet in a join on seeds, which is complete. A pair that covers enough of an item has
``threshold * words / MIN_MATCH`` of its seed places, so all but that number (less one) of an item's places
are indexed, those of the seeds that the most items share being left out: a stem that thousands of items
begin with forms no pairs, it only confirms them. A Bloom filter of the indexed seeds (16 MB at
most) keeps other seeds of the documents from the shuffle. Pairs are then tiled, ``GROUP`` items of
one document at a time. An item shorter than ``MIN_MATCH`` words must occur entirely; its seed is the whole.

Results on odd input: null or empty texts and items without words match nothing; repeated documents
each match (one result for a doc_id and item, the best; rows of null doc_id are one document); items
without item_id or text are left out, repeated ones count once; a very long text is tiled whole, where its
seeds are; of equal matches the first in the document is marked; extra columns are ignored by
``contamination`` and kept by ``clean``; an empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafold.llm import textwords as T
from grafold.operators.components import cut

MIN_MATCH, THRESHOLD = 5, 0.5
GROUP = 64
_B = np.uint64(0xA24BAED4963EE407)


class _Rolling:
    """Hashes of all windows of any length over a word sequence."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power, inverse = np.full(n + 1, _B, np.uint64), np.full(n + 1, np.uint64(pow(int(_B), -1, 1 << 64)), np.uint64)
        power[0] = inverse[0] = 1
        self.words, self.inverse = words, np.multiply.accumulate(inverse)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(power)[:n], out=self.prefix[1:])

    def windows(self, length: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of this length without a marked word."""
        m = len(self.words) - length + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        run = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(run[length:] - run[:-length] == length)
        return at, T.mix64((self.prefix[at + length] - self.prefix[at]) * self.inverse[at])


def tiles(doc: np.ndarray, item: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in doc, place in item, length)."""
    least = max(1, min(least, len(item)))
    a, b = _Rolling(doc), _Rolling(item)
    free_a, free_b = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    length = max(least, min(len(item), len(doc)))
    while True:
        at_b, h_b = b.windows(length, free_b)
        at_a, h_a = a.windows(length, free_a)
        order = np.argsort(h_b, kind="stable")
        lo, hi = np.searchsorted(h_b[order], h_a, "left"), np.searchsorted(h_b[order], h_a, "right")
        found: list[tuple[int, int, int]] = []
        # No free match is longer than the last length, so a hit is extended below twice this one.
        for i in np.flatnonzero(hi > lo):
            for j in order[lo[i] : hi[i]]:
                p, q, k = int(at_a[i]), int(at_b[j]), 0
                if p and q and free_a[p - 1] and free_b[q - 1] and doc[p - 1] == item[q - 1]:
                    continue  # part of a match that starts before
                while p + k < len(doc) and q + k < len(item) and free_a[p + k] and free_b[q + k] and doc[p + k] == item[q + k]:
                    k += 1
                if k >= length:
                    found.append((-k, q, p))
        while found:
            found.sort()
            k, q, p = found.pop(0)
            k = -k
            blocked = np.flatnonzero(~(free_a[p : p + k] & free_b[q : q + k]))
            if not len(blocked):
                free_a[p : p + k] = free_b[q : q + k] = False
                out.append((p, q, k))
                continue
            # What earlier tiles leave of it competes again, if it is long enough.
            edge = [-1, *blocked.tolist(), k]
            found += [(-(y - x - 1), q + x + 1, p + x + 1) for x, y in zip(edge, edge[1:], strict=False) if y - x - 1 >= length]
        if length == least:
            return sorted(out)
        length = max(least, length // 2)


def _item_seeds(least: int):
    """A row for each seed place of an item: runs of `least` words, the whole of a shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in T.spans(batch.column("text")):
                w = T.words(data, offsets, loose=True)
                n = w.counts()
                for k in range(1, least + 1):
                    doc, h, at = T.shingles(w, k, whole=False)
                    own = (n == k) if k < least else (n >= k)
                    at = at - np.searchsorted(w.doc, doc)
                    doc, h, at = doc[own[doc]], h[own[doc]], at[own[doc]]
                    yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(doc + first)), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(n[doc].astype(np.int32)), pa.array(np.full(len(h), k, np.int32))], ["item", "seed", "place", "words", "k"])

    return run


def _doc_seeds(lengths: list[int], bits: np.ndarray):
    """The distinct seeds of each document that the filter knows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in T.spans(batch.column("text")):
                w = T.words(data, offsets, loose=True)
                for k in lengths:
                    doc, h, _ = T.shingles(w, k, whole=False)
                    hit = T.in_bloom(bits, h)
                    pairs = np.unique(np.stack([doc[hit].astype(np.uint64), h[hit]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(pairs[:, 0].astype(np.int64) + first)), pa.array(pairs[:, 1].view(np.int64))], ["doc_id", "seed"])

    return run


def _tiled(least: int, threshold: float):
    """The contaminated ones of a document and some items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                w = _sequence(row.column("text")[0].as_py())
                rows = []
                for item_id, text in ((x["item_id"], x["text"]) for x in row.column("items")[0].as_py()):
                    item = _sequence(text)
                    k = min(least, len(item))
                    seeds, own = (T.shingles(T.Words(1, np.zeros(len(x), np.int64), x, *[np.zeros(0, np.int64)] * 3), k, whole=False)[1] for x in (item, w))
                    starts = np.flatnonzero(np.isin(own, seeds))
                    # Could the seeds cover enough? Distinct places of the item, each seed covering `k`.
                    places = np.flatnonzero(np.isin(seeds, own))
                    if not len(starts) or np.minimum(np.diff(places, append=len(item)), k).sum() < threshold * len(item):
                        continue
                    found = tiles(_seeded_part(w, starts, k), item, least)
                    covered = sum(x[2] for x in found)
                    if covered >= threshold * len(item) and (len(item) >= least or covered == len(item)):
                        rows.append((item_id, covered, len(item), len(found), max(x[2] for x in found), [x[1] for x in found] != sorted(x[1] for x in found)))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.bool_()], strict=True)]
                    yield pa.RecordBatch.from_arrays([row.column("doc_id").take(pa.array([0] * len(rows))), *columns], ["doc_id", "item_id", "covered", "item_words", "n_tiles", "longest", "reordered"])

    return run


def _sequence(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return T.words(raw, np.array([0, len(raw)]), loose=True).hash


def _seeded_part(words: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """The stretches of a document that seeds cover, parted by words that occur nowhere."""
    starts = np.unique(starts)
    cuts = np.flatnonzero(np.diff(starts) > least)
    begins, ends = starts[np.concatenate([[0], cuts + 1])], starts[np.concatenate([cuts, [len(starts) - 1]])] + least
    out = []
    for k, (a, b) in enumerate(zip(begins, ends, strict=True)):
        out += [words[a:b], np.array([T.seeded(900_001 + k)])]
    return np.concatenate(out)


_RESULT = "doc_id long, item_id long, covered long, item_words long, n_tiles long, longest long, reordered boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_MATCH) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> the contaminated pairs (doc_id, item_id, covered,
    item_words, n_tiles, longest, reordered)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    items = items.dropDuplicates().withColumn("item", F.xxhash64("item_id", "text"))
    seeds = cut(items.mapInArrow(_item_seeds(least), "item long, seed long, place int, words int, k int"))
    lengths = sorted(r["k"] for r in seeds.select("k").distinct().collect())  # `least` numbers at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], _RESULT)
    shared = seeds.groupBy("seed").agg(F.count_distinct("item").alias("held"))
    by_rarity = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("held"), "seed", "place"))
    needed = F.ceil(F.lit(float(threshold)) * F.col("words") / F.col("k") - 1e-9)
    index = cut(seeds.join(shared, "seed").withColumn("rank", by_rarity).where(F.col("rank") >= needed).select("seed", "item").distinct())
    met = docs.mapInArrow(_doc_seeds(lengths, T.bloom(index.select("seed").distinct())), "doc_id long, seed long").join(index, "seed")
    pairs = cut(met.select("doc_id", "item").distinct())
    of_doc = F.count("*").over(Window.partitionBy("doc_id"))
    pairs = pairs.withColumn("g", F.pmod(F.xxhash64("item"), F.ceil(of_doc / GROUP)))
    asked = pairs.join(items, "item").groupBy("doc_id", "g").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    asked = asked.select(F.col("doc_id").alias("of"), "items")
    out = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text", "items").mapInArrow(_tiled(least, threshold), _RESULT)
    best = F.max(F.struct("covered", "item_words", "n_tiles", "longest", "reordered"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = MIN_MATCH) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    dirty = contamination(docs, benchmark, threshold, least).select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(dirty, F.col("doc_id").cast("long").eqNullSafe(F.col("_dirty")), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
