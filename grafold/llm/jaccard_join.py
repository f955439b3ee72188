"""N-gram Jaccard join by partitioning the universe of shingles (exact).

Method
------
A document is the set of its k-word shingles. Sizes fall into bands of ratio ``BAND``. For each band
the universe is cut, by hash, into ``m`` segments, one more than the largest symmetric difference that
two linked sets can have (plus slack). The smaller set of a pair is indexed in its own band; the larger
one probes its own band and each lower band that may hold a partner.

* The index holds each segment's subset, and for the first ``DELETABLE`` segments also the subset with
  any one shingle deleted.
* A probe of size n must place thresholds v (-1 skip, 0 equal, 1 differs by one) on the segments with
  sum(v + 1) = H + 1, H being the largest difference that a partner no larger than n can have; by the
  pigeonhole principle some segment then differs by at most its v. The probe chooses by cost: the
  dearest segments (empty, then one or two shingles) are skipped while there is slack, then in
  exchange for a deletion neighbourhood elsewhere when that is cheaper.
* Equal signatures join. Only stars (member to one opposite member of its bucket) leave a bucket,
  whatever its size; a bucket crowded within one chunk of documents is linked there, before the shuffle.
  Their components are pools, a superset of the true components.
* A pool of more than one tile, as of pages of one template, is joined once more by a complete filter:
  two linked sets share one of their first n - ceil(n * num / den) + 1 shingles in any order of all
  shingles. The order puts the frequent ones last (counted over all sets of such pools), so sets that
  share a template alone part here. What links remain gives smaller pools.
* A pool is cut to tiles of bounded size by set size and hash; each tile is verified exactly, all against
  all, as products of 0/1 matrices, and returns a spanning forest of its links and each member's number
  of links.

Equal sets meet by their hash before all this: a class counts once, however many copies it has. A
document of the same 64-bit hash as a class whose second hash differs is no member of it (it stays alone,
as a few of 10**11 documents would).

Results on odd input: null text or text without words has n_shingles 0 and is linked with nothing; a
text with fewer than k words is one shingle; repeated rows of one doc_id count as one document (the
one of most shingles, then of the largest hash), rows of null doc_id as one that only its copies link;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafold.llm import textwords as T
from grafold.operators.components import components, cut

BAND, SLACK, DELETABLE = 1.5, 0.1, 2
#: A tile holds at most about this many documents and shingles of either side.
TILE_DOCS, TILE_SHINGLES = 512, 1 << 19
#: Classes of equal sets that a task remembers to sign them once.
SEEN_CLASSES = 200_000
#: Rows of a signature within one chunk that are linked there.
CROWD = 8
#: Shingles that are known as frequent, for the order of the second filter (any order gives right results).
FREQUENT = 1 << 17
_INDEX, _PROBE = 1, 2
#: Relative cost of a bucket by the number of shingles in the segment.
_COST = np.array([4000, 400, 40, 8, 4, 3, 2, 1])


class Plan:
    """Bands and segment counts of a similarity of num / den at least."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))
        self.edges = np.array(self.starts, np.int64)
        self.m = np.array([self._segments(b) for b in range(len(self.starts) - 1)], np.int64)

    def difference(self, n: np.ndarray | int):
        """Largest symmetric difference of a set of size n with a linked set no larger."""
        return (2 * n * (self.den - self.num)) // (self.den + self.num)

    def largest_partner(self, n):
        return n * self.den // self.num

    def smallest_partner(self, n):
        return -(-n * self.num // self.den)

    def overlap(self, n):
        """Shingles that a set of size n shares with any linked set."""
        return -(-n * self.num // self.den)

    def _segments(self, b: int) -> int:
        most = self.difference(self.largest_partner(self.starts[b + 1] - 1))
        return 0 if not most else int(most * (1 + SLACK)) + 1 + DELETABLE // 2

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def linked(self, inter, size):
        return inter * self.den >= (size - inter) * self.num


def _segment_rows(plan: Plan, doc, h, n, docs: np.ndarray, band: np.ndarray, index: bool):
    """Signature rows (document, signature, role) of some documents in the bands given."""
    m, n_all = plan.m[band], len(n)
    live = m > 0
    docs, band, m = docs[live], band[live], m[live]
    if not len(docs):
        return []
    slot = np.full(n_all, -1, np.int64)
    slot[docs] = np.arange(len(docs))
    own = slot[doc] >= 0
    d, x = slot[doc[own]], h[own]
    base = np.concatenate([[0], np.cumsum(m)])
    seg = base[d] + (((x >> np.uint64(24)) * m[d].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    mixed = T.mix64(x * np.uint64(0xD1342543DE82EF95) + np.uint64(plan.den))
    prefix = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mixed, out=prefix[1:])
    total = int(base[-1])
    size = np.bincount(seg, minlength=total)
    edge = np.concatenate([[0], np.cumsum(size)])
    subset = prefix[edge[1:]] - prefix[edge[:-1]]
    of = np.repeat(np.arange(len(docs)), m)
    part = np.arange(total) - base[of]
    place = T.mix64((band[of] * 0x10001).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
    gone = T.mix64(place + np.uint64(1))
    exact = T.mix64(subset ^ place)
    # Costs and the allocation. rank 0 is the dearest segment of a document.
    cost = _COST[np.minimum(size, len(_COST) - 1)]
    order = np.lexsort((part, -cost, of))
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total) - base[of[order]]
    spare = m - (plan.difference(n[docs]) + 1)  # may be below 0 in no case: m covers the largest partner
    deletable = (part < DELETABLE) & (size >= 3)
    # What the deletion neighbourhood of a segment costs beyond its own: its one-deletions and the shared key.
    extra = (size + 1) * _COST[np.minimum(np.maximum(size - 1, 0), len(_COST) - 1)]
    deletable &= rank >= (spare + DELETABLE)[of]  # never one that may be skipped
    upgraded = np.zeros(total, bool)
    skips = spare.copy()
    by_rank = np.full((len(docs), DELETABLE), -1, np.int64)  # the segments to skip next
    for j in range(DELETABLE):
        pos = spare + j
        ok = pos < m
        by_rank[ok, j] = order[(base[:-1] + pos)[ok]]
    for j in range(DELETABLE):
        can = np.flatnonzero(deletable & (part == j))
        who = of[can]
        nxt = by_rank[who, np.minimum(skips[who] - spare[who], DELETABLE - 1)]
        better = (nxt >= 0) & (cost[nxt] > extra[can]) & (nxt != can)
        upgraded[can[better]] = True
        skips[who[better]] += 1
    probes = rank >= skips[of]
    rows = []
    role = np.where(probes, _PROBE, 0) + (_INDEX if index else 0)
    keep = role > 0
    rows.append((docs[of[keep]], exact[keep], role[keep]))
    # One-deletion neighbourhoods: of the index under the key of deletions, of a probe under the exact key.
    up = np.flatnonzero(upgraded)
    if len(up):
        rows.append((docs[of[up]], T.mix64(subset[up] ^ gone[up]), np.full(len(up), _PROBE)))
        member = upgraded[seg]
        rows.append((docs[d[member]], T.mix64((subset[seg[member]] - mixed[member]) ^ place[seg[member]]), np.full(member.sum(), _PROBE)))
    if index:
        member = part[seg] < DELETABLE
        rows.append((docs[d[member]], T.mix64((subset[seg[member]] - mixed[member]) ^ gone[seg[member]]), np.full(member.sum(), _INDEX)))
    return rows


def signatures(plan: Plan, doc, h, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, signature, role) rows of shingle sets sorted by document and hash."""
    docs = np.flatnonzero(n)
    band = plan.band(n[docs])
    rows = _segment_rows(plan, doc, h, n, docs, band, True)
    lower, at = band - 1, docs
    while len(at):  # lower bands that can hold a smaller partner
        fits = (lower >= 0) & (plan.edges[np.maximum(lower, 0) + 1] - 1 >= plan.smallest_partner(n[at]))
        at, lower = at[fits], lower[fits]
        rows += _segment_rows(plan, doc, h, n, at, lower, False)
        lower = lower - 1
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def _batches(batches: Iterator[pa.RecordBatch], text: str):
    for batch in batches:
        for first, last, data, offsets in T.spans(batch.column(text)):
            yield batch.slice(first, last - first), T.words(data, offsets)


def _sizes(k: int):
    def run(batches):
        for part, w in _batches(batches, "text"):
            doc, h, n = T.shingle_sets(w, k)
            other = T.distinct_hash(doc, T.mix64(h + T.seeded(78)), w.n_docs)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(T.distinct_hash(doc, h, w.n_docs).view(np.int64)), pa.array(other.view(np.int64))], ["doc_id", "n_shingles", "set_id", "other"])

    return run


def _signed(k: int, plan: Plan):
    def run(batches):
        seen: set[int] = set()
        for _, w in _batches(batches, "text"):
            doc, h, n = T.shingle_sets(w, k)
            of = T.distinct_hash(doc, h, w.n_docs).view(np.int64)
            # Copies within a task count once (as far as a bounded memory goes; more of them do no harm).
            first = np.zeros(w.n_docs, bool)
            first[np.unique(of, return_index=True)[1]] = True
            first &= np.array([x not in seen for x in of.tolist()], bool)
            if len(seen) > SEEN_CLASSES:
                seen.clear()
            seen.update(of.tolist())
            mine = first[doc]
            rows, sig, role = signatures(plan, doc[mine], h[mine], np.where(first, n, 0))
            stays, near, far = _crowded(sig, of[rows], role)
            # A link is a bucket of its own.
            own = T.mix64(T.mix64(near.view(np.uint64)) + far.view(np.uint64))
            sig, role = np.concatenate([sig[stays], own, own]), np.concatenate([role[stays], np.full(2 * len(own), _INDEX + _PROBE)])
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.concatenate([of[rows][stays], near, far])), pa.array(role.astype(np.int8))], ["sig", "set_id", "role"])

    return run


def _crowded(sig: np.ndarray, of: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a signature of many rows, one of both roles meets all others whatever comes: (rows that go on,
    and the links made here, from and to)."""
    stays = np.ones(len(sig), bool)
    order = np.lexsort((of, role != _INDEX + _PROBE, sig))
    begin = np.flatnonzero(np.concatenate([[True], sig[order[1:]] != sig[order[:-1]]])) if len(sig) else order
    size = np.diff(np.append(begin, len(sig)))
    lead = np.repeat(order[begin], size)
    link = (np.repeat(size, size) > CROWD) & (role[lead] == _INDEX + _PROBE) & (order != lead)
    stays[order[link]] = False
    pairs = np.unique(np.stack([of[order[link]], of[lead[link]]], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return stays, pairs[:, 0], pairs[:, 1]


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, size of each row's set) of a column of sets."""
    sets = [np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    return np.repeat(np.arange(len(n)), n), np.concatenate([*sets, np.zeros(0, np.uint64)]), n


def _token_counts(batches):
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            token, n = np.unique(_sets(part)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])


def _prefixes(plan: Plan, frequent: np.ndarray):
    """Rows (pool, token, set_id) of the shingles of which linked sets share one, and links (set_id, to) of
    those that meet within a chunk. ``frequent`` lists shingles by falling number."""
    by_hash = np.argsort(frequent)
    held = frequent[by_hash]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                doc, h, n = _sets(part)
                of, pool = part.column("set_id").to_numpy(), part.column("pool").to_numpy()
                rank = np.zeros(len(h), np.int64)
                if len(held):
                    at = np.minimum(np.searchsorted(held, h), len(held) - 1)
                    rank = np.where(held[at] == h, len(held) - by_hash[at], 0)
                order = np.lexsort((h, rank, doc))
                first = np.concatenate([[0], np.cumsum(n)])[doc]
                keep = order[np.arange(len(h)) - first < (n - plan.overlap(n) + 1)[doc]]
                d, token = doc[keep], h[keep]
                order = np.lexsort((of[d], token, pool[d]))
                d, token = d[order], token[order]
                begins = np.concatenate([[True], (token[1:] != token[:-1]) | (pool[d[1:]] != pool[d[:-1]])]) if len(d) else np.zeros(0, bool)
                lead = d[np.flatnonzero(begins)][np.cumsum(begins) - 1] if len(d) else d
                pairs = np.unique(np.stack([of[d], of[lead]], axis=1), axis=0)
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                d, token = d[begins], token[begins]
                none = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pool[d]), pa.array(token.view(np.int64)), pa.array(of[d]), none], ["pool", "token", "set_id", "to"])
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pool", "token", "set_id", "to"])

    return run


def _smaller_pools(members: DataFrame, tokens: DataFrame, plan: Plan) -> DataFrame:
    """members(set_id, pool) of large pools -> (set_id, pool): the pools that the second filter leaves."""
    sets = members.select("set_id", "pool").join(tokens, "set_id").select("set_id", "pool", "tokens")
    counts = sets.select("tokens").mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    frequent = np.array([r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").collect()], np.int64).view(np.uint64)
    rows = sets.mapInArrow(_prefixes(plan, frequent), "pool long, token long, set_id long, to long")
    rows = rows.withColumn("to", F.coalesce("to", F.min("set_id").over(Window.partitionBy("pool", "token"))))
    stars = rows.where("to <> set_id").select(F.col("set_id").alias("a"), F.col("to").alias("b")).distinct()
    return components(cut(stars)).select(F.col("id").alias("set_id"), F.col("root").alias("pool"))


def _with_tokens(k: int):
    def run(batches):
        for part, w in _batches(batches, "text"):
            doc, h, n = T.shingle_sets(w, k)
            tokens, edge = h.tobytes(), np.concatenate([[0], np.cumsum(n)]) * 8
            col = pa.array([tokens[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(T.distinct_hash(doc, h, w.n_docs).view(np.int64)), col], ["doc_id", "set_id", "tokens"])

    return run


def _verify(plan: Plan):
    """One tile: the members of two blocks (side 0 and 1) against each other, or of one block among themselves."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if table.num_rows > 1:
            table = table.take(pc.sort_indices(table, [("set_id", "ascending")]))
        ids, side = table["set_id"].to_numpy(), table["side"].to_numpy()
        copies = table["copies"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        n = np.array([len(x) for x in sets], np.int64)
        _, lo, i, hi, j = (x.as_py() for x in key)
        both = (lo, i) != (hi, j)
        row = np.repeat(np.arange(len(n)), n)
        _, token = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
        df = np.bincount(token, minlength=1)
        shared = df[token] > 1
        row, token = row[shared], (np.cumsum(df > 1) - 1)[token[shared]]
        wide = int((df > 1).sum())
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if both else (np.arange(len(n)),) * 2
        inter = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(token, kind="stable")
        row, token = row[order], token[order]
        width = 4096
        for a in range(0, wide, width):
            lo, hi = np.searchsorted(token, [a, a + width])
            block = np.zeros((len(n), min(width, wide - a)), np.float32)
            block[row[lo:hi], token[lo:hi] - a] = 1
            inter += block[left] @ block[right].T
        common = np.rint(inter).astype(np.int64)  # exact: below 2**24
        links = plan.linked(common, n[left][:, None] + n[right][None, :])
        if not both:
            np.fill_diagonal(links, False)
        degree = np.zeros(len(n), np.int64)
        np.add.at(degree, left, links @ copies[right])
        if both:
            np.add.at(degree, right, links.T @ copies[left])
        # A spanning forest by whole rows at a time.
        where_left = np.full(len(n), -1)
        where_left[left] = np.arange(len(left))
        where_right = np.full(len(n), -1)
        where_right[right] = np.arange(len(right))
        root = np.arange(len(n))
        seen = np.zeros(len(n), bool)
        for i in np.flatnonzero(degree):
            if seen[i]:
                continue
            front = np.array([i])
            seen[i] = True
            root[i] = i
            while len(front):
                hit = np.zeros(len(n), bool)
                if len(a := where_left[front][where_left[front] >= 0]):
                    hit[right] |= links[a].any(axis=0)
                if both and len(a := where_right[front][where_right[front] >= 0]):
                    hit[left] |= links[:, a].any(axis=1)
                front = np.flatnonzero(hit & ~seen)
                seen[front] = True
                root[front] = i
        return pa.table({"set_id": ids, "root": ids[root], "links": degree}, schema=pa.schema([("set_id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())]))

    return run


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, n_links), one row per document.

    Documents link when |A & B| / |A | B| >= num / den over distinct k-word shingles; component_id is
    the smallest doc_id that links reach; n_links counts linked documents, copies included.
    """
    plan = Plan(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = docs.mapInArrow(_sizes(k), "doc_id long, n_shingles long, set_id long, other long")
    sized = cut(sized.groupBy("doc_id").agg(F.max(F.struct("n_shingles", "set_id", "other")).alias("s")).select("doc_id", "s.*"))
    classes = sized.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "other")).alias("s"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    classes = cut(classes.select("set_id", "s.doc_id", "s.other", "copies", "n"))

    rows = docs.mapInArrow(_signed(k, plan), "sig long, set_id long, role byte")
    bucket = Window.partitionBy("sig")
    of = lambda bit: F.col("role").bitwiseAND(bit) > 0
    rows = rows.withColumns({"held": F.min(F.when(of(_INDEX), F.col("set_id"))).over(bucket), "asks": F.min(F.when(of(_PROBE), F.col("set_id"))).over(bucket)})
    stars = rows.where("held is not null and asks is not null").select("set_id", F.explode(F.array(F.when(of(_PROBE), F.col("held")), F.when(of(_INDEX), F.col("asks")))).alias("to"))
    stars = cut(stars.where("to <> set_id").select(F.col("set_id").alias("a"), F.col("to").alias("b")).distinct())
    maybe = components(stars).select(F.col("id").alias("set_id"), F.col("root").alias("pool"))
    members = cut(maybe.join(classes, "set_id").drop("other"))
    # The sets of all members, once; a class is read from its smallest document.
    texts = docs.join(members.select("doc_id"), "doc_id", "left_semi").mapInArrow(_with_tokens(k), "doc_id long, set_id long, tokens binary")
    tokens = cut(members.select("doc_id", "set_id").join(texts.dropDuplicates(["doc_id", "set_id"]), ["doc_id", "set_id"]).select("set_id", "tokens"))
    sizes = members.groupBy("pool").agg(((F.count("*") > TILE_DOCS) | (F.sum("n") > TILE_SHINGLES)).alias("large"))
    large = cut(members.join(sizes.where("large"), "pool", "left_semi"))
    if not large.isEmpty():
        parted = _smaller_pools(large, tokens, plan).join(classes, "set_id").drop("other")
        members = cut(members.join(sizes.where("large"), "pool", "left_anti").unionByName(parted))

    # Tiles: by size class (a partner is in the same class or the next), then by hash.
    step = np.log(den / num)
    members = cut(members.withColumn("sc", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(step)) + 1e-9).cast("int")))
    blocks = members.groupBy("pool", "sc").agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("nb"), F.count("*").alias("c"), F.sum("n").alias("sn"))
    blocks = cut(blocks)
    small = blocks.groupBy("pool").agg(((F.sum("c") <= TILE_DOCS) & (F.sum("sn") <= TILE_SHINGLES)).alias("small"))
    near = blocks.select("pool", F.col("sc"), "nb")
    info = (
        near.join(small, "pool")
        .join(near.select("pool", (F.col("sc") - 1).alias("sc"), F.col("nb").alias("above")), ["pool", "sc"], "left")
        .join(near.select("pool", (F.col("sc") + 1).alias("sc"), F.col("nb").alias("below")), ["pool", "sc"], "left")
    )
    placed = members.join(info, ["pool", "sc"]).withColumn("i", F.pmod(F.xxhash64("set_id"), F.col("nb")).cast("int"))
    tile = lambda lo, i, hi, j, side: F.struct(lo.alias("lo"), i.alias("i"), hi.alias("hi"), j.alias("j"), F.lit(side).cast("byte").alias("side"))
    sc, i, each = F.col("sc"), F.col("i"), lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    one = F.array(tile(F.lit(-1), F.lit(0), F.lit(-1), F.lit(0), 0))
    many = F.concat(
        F.transform(each("nb"), lambda j: F.when(j >= i, tile(sc, i, sc, j, 0)).otherwise(tile(sc, j, sc, i, 1))),
        F.transform(each("above"), lambda j: tile(sc, i, sc + 1, j, 0)),
        F.transform(each("below"), lambda j: tile(sc - 1, j, sc, i, 1)),
    )
    tiles = placed.select("doc_id", "set_id", "copies", "pool", F.explode(F.when(F.col("small"), one).otherwise(many)).alias("t")).select("doc_id", "set_id", "copies", "pool", "t.*")
    found = cut(tiles.join(tokens, "set_id").select("pool", "lo", "i", "hi", "j", "side", "set_id", "copies", "tokens").groupBy("pool", "lo", "i", "hi", "j").applyInArrow(_verify(plan), "set_id long, root long, links long"))

    groups = components(found.where("set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    # Hashes stand for classes; a component's id is its smallest doc_id.
    joined = classes.join(groups.select(F.col("id").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    ids = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    degree = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    by_class = joined.join(ids, "root").join(degree, "set_id", "left").select("set_id", F.col("other").alias("same"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sized.join(by_class, "set_id", "left")
    lone = (F.col("n_shingles") == 0) | (F.col("other") != F.col("same"))
    return out.select("doc_id", "n_shingles", F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)


#: DuckDB. Words as lists, shingles as texts; intersections by a join on shingles, components by reach.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), meets AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT u, v FROM meets JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)
), ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT k.v, r.root FROM reach r JOIN ways k ON k.u = r.doc_id)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.root) AS component_id, (SELECT count(*) FROM ways w WHERE w.u = d.doc_id) AS n_links
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
