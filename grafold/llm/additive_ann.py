"""Approximate nearest neighbours by additive quantisation.

A vector (scaled to length 1, less the sample's mean) is approximated by a sum of codewords, one from each codebook; all codewords
have the full dimension. Codebooks start as k-means of successive residuals, or of the parts of a random
rotation where the sample has fewer rows than residual codebooks have words or where that has the smaller
error on held-out rows. They are refined on the bounded sample: beam-search encoding, then least squares
for the codewords, in sweeps over the codebooks. There is one codebook for 8 dimensions (``LEAST_BOOKS``
at least), so a code has a bit a dimension or more. Every row is encoded by beam search and stored with its
codes, the squared norm of its approximation and the length of what that leaves of it.

Rows lie in inverted lists by their nearest of a bounded number of centres, lists in blocks of about
``BLOCK`` rows. A query visits the ``probes`` nearest lists, a number measured on the sample: so many that
``REACHED`` of the true neighbours there lie in them (for vectors without any structure these are all
lists). Queries and blocks meet in a cogroup by (list, block, block of queries); no query goes through the
driver, and the plan is the same for any number of them. There a query scores the rows by table look-ups,
<q, x~> being a sum of one table entry per code; |q - x~|**2 less the squared error of the row estimates the
squared distance. The best ``SHARE`` of the block (``RERANK`` rows at least) are reranked by exact cosine on the
original vectors, and with them every row whose estimate is not farther from the k-th best distance found than
the codes may be wrong: twice distance times error times ``lean``, the cosine between an error and the way to
the query that ``LEANING`` of the near pairs of the sample stay below. So rows that the codes cannot tell apart
are all reranked, however many. The best few are merged over the blocks.

Copies of one vector have one code, and ties keep the smallest vec_id, so any number of copies does no
harm.

Results on odd input: vectors that are null, zero, or hold a null or a non-finite component take no
part, nor do those, queries too, whose length differs from the table's commonest length (the larger one,
of two as common): cosine is not defined between lengths; rows of null vec_id take no part;
rows repeated whole count once, and of different vectors with one vec_id the largest; with fewer than k
candidates all are returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grafold.operators.components import cut

LEAST_BOOKS, WORDS, BEAM, TRAIN_ROWS, REFINE, RIDGE, SWEEPS = 12, 256, 4, 8192, 1, 0.05, 8
#: Rows of a block of a list, queries that meet it at once, lists at most.
BLOCK, QUERY_BLOCK, LISTS = 8192, 8192, 1024
#: Rows reranked of each block for each query: a share, and the least number.
SHARE, RERANK = 0.04, 64
#: Share of the sample's true neighbours that the visited lists hold.
REACHED = 0.97
#: Share of the sample's near pairs that bounds how far an error leans towards a query, and near rows of each.
LEANING, NEAR = 0.999, 64
#: Rounding of an estimated squared distance, as a share of the squared lengths in it (single precision).
ROUNDING = 4e-6


class Quantiser:
    """Codebooks of shape (books, words, dimension)."""

    def __init__(self, books: np.ndarray):
        self.books = np.ascontiguousarray(books, np.float32)
        m, k, d = books.shape
        flat = self.books.reshape(m * k, d)
        self.cross = flat @ flat.T  # inner products of all codewords
        self.norms = np.diag(self.cross).reshape(m, k).copy()

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norm of the approximation) of each row, by beam search over the codebooks."""
        m, k, d = self.books.shape
        codes = np.zeros((len(x), m), np.uint8)
        for a in range(0, len(x), 512):
            codes[a : a + 512] = self._beam(np.ascontiguousarray(x[a : a + 512], np.float32), beam)
        approx = self.decode(codes)
        return codes, (approx * approx).sum(axis=1)

    def _beam(self, x: np.ndarray, beam: int) -> np.ndarray:
        m, k, d = self.books.shape
        n = len(x)
        dots = (x @ self.books.reshape(m * k, d).T).reshape(n, m, k)
        error = np.zeros((n, 1), np.float32)  # less the constant |x|**2
        chosen = np.zeros((n, 1, 0), np.int64)
        for j in range(m):
            width = chosen.shape[1]
            step = error[:, :, None] + (self.norms[j] - 2 * dots[:, j])[:, None, :]
            block = self.cross[:, j * k : (j + 1) * k]
            for i in range(j):
                step = step + 2 * block[i * k + chosen[:, :, i]]
            flat = step.reshape(n, width * k)
            keep = min(beam, width * k)
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(flat, best, axis=1)
            parent = best // k
            chosen = np.concatenate([np.take_along_axis(chosen, parent[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
        return np.take_along_axis(chosen, error.argmin(axis=1)[:, None, None], axis=1)[:, 0].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.books.shape[2]), np.float32)
        for j in range(self.books.shape[0]):
            out += self.books[j][codes[:, j]]
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries and codewords: (queries, books, words)."""
        m, k, d = self.books.shape
        return (q.astype(np.float32) @ self.books.reshape(m * k, d).T).reshape(len(q), m, k)

    @classmethod
    def train(cls, x: np.ndarray, books: int | None = None, words: int = WORDS, refine: int = REFINE, seed: int = 5) -> Quantiser:
        """Of two beginnings and their refinements the codebooks of least error on a quarter of the sample that
        takes no part in the fit."""
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        fitted, held = (x[np.arange(len(x)) % 4 > 0], x[::4][:1024]) if len(x) >= 64 else (x, x)
        books = books or max(LEAST_BOOKS, -(-x.shape[1] // 8))
        words = max(1, min(words, len(fitted), 256))
        tried = []
        for begin in (_residual_books, _rotated_books):
            if begin is _residual_books and len(fitted) < books * words and books <= x.shape[1]:
                continue
            if (found := begin(fitted, books, words, rng)) is None:
                continue
            tried.append(cls(found))
            for _ in range(refine):
                tried.append(cls(tried[-1]._refined(fitted)))
        return min(tried, key=lambda q: float(((q.decode(q.encode(held)[0]) - held) ** 2).sum()))

    def _refined(self, x: np.ndarray) -> np.ndarray:
        """Least squares for the codewords under the codes of a sample: Gauss-Seidel sweeps, one codebook at a time."""
        m, k, _ = self.books.shape
        codes = self.encode(x)[0].astype(np.int64)
        fitted = self.books.copy()
        rest = x - sum(fitted[j][codes[:, j]] for j in range(m))
        for _ in range(SWEEPS):
            for j in range(m):
                rest += fitted[j][codes[:, j]]
                total, count = _sums(rest, codes[:, j], k)
                fitted[j] = (total + RIDGE * self.books[j]) / (count + RIDGE)[:, None]
                rest -= fitted[j][codes[:, j]]
        return fitted


def _residual_books(x: np.ndarray, books: int, words: int, rng: np.random.Generator) -> np.ndarray:
    """k-means of successive residuals."""
    rest, found = x, []
    for _ in range(books):
        centre, near = _centres(rest, words, rng, False)
        rest = rest - centre[near]
        found.append(centre)
    return np.stack(found)


def _rotated_books(x: np.ndarray, books: int, words: int, rng: np.random.Generator) -> np.ndarray | None:
    """k-means within the parts of a random rotation, turned back: each codeword has the full dimension. They
    need fewer rows than residuals do where vectors of many dimensions have little structure."""
    d = x.shape[1]
    if books > d:
        return None
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
    turned, found = x @ turn, []
    for part in np.array_split(np.arange(d), books):
        found.append(_centres(np.ascontiguousarray(turned[:, part]), words, rng, False)[0] @ turn[:, part].T)
    return np.stack(found)


def _sums(x: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the rows of each group."""
    member = np.zeros((groups, len(x)), np.float32)
    member[group, np.arange(len(x))] = 1
    return member @ x, np.bincount(group, minlength=groups).astype(np.float32)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(k-means centres, of length 1 if ``unit``; the nearest centre of each row)."""
    centre = x[rng.choice(len(x), k, replace=False)].astype(np.float32)

    def nearest_of() -> np.ndarray:
        return ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)

    for _ in range(steps):
        total, count = _sums(x, nearest_of(), k)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
        if unit:
            centre /= np.maximum(np.sqrt((centre * centre).sum(axis=1)), 1e-12)[:, None]
    return centre, nearest_of()


def _probes(x: np.ndarray, centre: np.ndarray, k: int, share: float) -> int:
    """The least number of lists, nearest first, that hold this share of the true k neighbours within a sample."""
    asked = np.arange(0, len(x), max(1, len(x) // 256))
    home = (x @ centre.T).argmax(axis=1)
    place = np.empty((len(asked), len(centre)), np.int64)
    np.put_along_axis(place, np.argsort(-(x[asked] @ centre.T), axis=1, kind="stable"), np.arange(len(centre))[None, :], axis=1)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    found = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    ranks = np.sort(np.take_along_axis(place, home[found], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(share * len(ranks)))]) + 1 if len(ranks) else len(centre)


def _lean(x: np.ndarray, approx: np.ndarray) -> float:
    """The cosine between the error of a row's approximation and the way from the row to a query near it that
    ``LEANING`` of the pairs within a sample stay below; 1, which always holds, without pairs."""
    rest = x - approx
    error, found = np.sqrt((rest * rest).sum(axis=1)), []
    norm = (x * x).sum(axis=1)
    for i in range(0, len(x), max(1, len(x) // 256)):
        at = np.argsort(norm - 2 * (x @ x[i]), kind="stable")[: NEAR + 1]
        way = x[i] - x[at]
        size = np.sqrt((way * way).sum(axis=1)) * error[at]
        found.append((way * rest[at]).sum(axis=1)[size > 0] / size[size > 0])
    found = np.concatenate(found)
    return float(min(1.0, max(0.0, np.quantile(found, LEANING)))) if len(found) else 1.0


def _finite(v: Column) -> Column:
    big = float("inf")
    return v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < big)) & F.exists(v, lambda e: e != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _length(v: np.ndarray) -> np.ndarray:
    """Lengths of vectors, of extreme ones as well; sums run in one order for every row."""
    top = np.abs(v).max(axis=-1)
    return top * np.sqrt(((v / top[..., None]) ** 2).sum(axis=-1))


def _encoded(books: np.ndarray, centre: np.ndarray, mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(books)
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                v = _matrix(part.column("v"))
                unit = v / _length(v)[:, None]
                x, y = unit.astype(np.float32), (unit - mean).astype(np.float32)
                codes, norm = q.encode(y)
                error = np.sqrt(((y - q.decode(codes)) ** 2).sum(axis=1))
                raw = codes.tobytes()
                m = codes.shape[1]
                home = (x @ centre.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("v"), pa.array([raw[i * m : (i + 1) * m] for i in range(len(codes))], pa.binary()), pa.array(norm, pa.float32()), pa.array(error, pa.float32()), pa.array(home, pa.int32())],
                    ["vec_id", "v", "codes", "norm", "error", "list"],
                )

    return run


def _asking(centre: np.ndarray, probes: int):
    """A row for each query and list that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                v = _matrix(part.column("v"))
                x = (v / _length(v)[:, None]).astype(np.float32)
                lists = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(v)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(at), part.column("v").take(at), pa.array(lists.ravel(), pa.int32())], ["query_id", "q", "list"])

    return run


def _search(books: np.ndarray, mean: np.ndarray, lean: float, k: int, share: float, rerank: int):
    m = len(books)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if rows.num_rows and asked.num_rows:
            quantiser = Quantiser(books)
            rows = rows.take(pc.sort_indices(rows.column("vec_id"))).combine_chunks()
            vec, ids = (t.to_numpy() for t in (rows.column("vec_id"), asked.column("query_id")))
            v, queries = _matrix(rows.column("v").combine_chunks()), _matrix(asked.column("q").combine_chunks())
            length, size = _length(v), _length(queries)
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(-1, m).astype(np.int64)
            norm, error = (rows.column(c).to_numpy() for c in ("norm", "error"))
            take = max(rerank, int(np.ceil(share * len(vec))))
            for a in range(0, len(ids), 64):
                part = (queries[a : a + 64] / size[a : a + 64, None] - mean).astype(np.float32)
                tables = np.ascontiguousarray(quantiser.tables(part).transpose(1, 2, 0))
                dots = tables[0][codes[:, 0]]
                for j in range(1, m):
                    dots += tables[j][codes[:, j]]
                lengths = (part * part).sum(axis=1)[:, None] + norm
                far = lengths - 2 * dots.T - error**2  # estimates of squared distances
                far[vec[None, :] == ids[a : a + 64, None]] = np.inf
                for i in range(len(far)):
                    q = a + i

                    def exact_of(at: np.ndarray) -> np.ndarray:
                        # One row at a time is summed alike, wherever it stands, so equal vectors tie exactly.
                        exact = (v[at] * queries[q]).sum(axis=1) / (length[at] * size[q])
                        exact[vec[at] == ids[q]] = -np.inf
                        return exact

                    at = _top(-far[i], take)
                    exact = exact_of(at)
                    if len(at) < len(vec):
                        kth = max(-1.0, np.sort(exact)[-k]) if len(at) >= k else -1.0
                        reach = max(0.0, 2 - 2 * kth)
                        near = far[i] <= reach + 2 * lean * np.sqrt(reach) * error + ROUNDING * (lengths[i] + error**2)
                        near[at] = False
                        more = np.flatnonzero(near)
                        at, exact = np.concatenate([at, more]), np.concatenate([exact, exact_of(more)])
                    best = np.lexsort((vec[at], -exact))[:k]
                    best = best[np.isfinite(exact[best])]
                    for column, value in zip(out, (np.full(len(best), ids[q]), vec[at][best], exact[best]), strict=True):
                        column.append(value)
        query_id, vec_id, score = (np.concatenate([*c, np.zeros(0, t)]) for c, t in zip(out, (np.int64, np.int64, np.float64), strict=True))
        return pa.table({"query_id": query_id, "vec_id": vec_id, "score": score})

    return run


def _top(score: np.ndarray, r: int) -> np.ndarray:
    """Places of the r largest, of equal ones the first."""
    if len(score) <= r:
        return np.arange(len(score))
    limit = np.partition(score, len(score) - r)[len(score) - r]
    above, equal = np.flatnonzero(score > limit), np.flatnonzero(score == limit)
    return np.concatenate([above, equal[: r - len(above)]])


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, v) of those that take part, a row for each vec_id; ``length`` is
    the number of components, the commonest of the table if not given."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _finite(F.col("v")))
    if length is None:
        common = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
        if common is None:
            return v
        length = common["n"]
    return v.where(F.size("v") == length).groupBy("vec_id").agg(F.max("v").alias("v"))


def _blocks(sizes: dict[int, int], lists: int, most: int) -> Column:
    """The number of blocks of a row's list, 0 for one without rows."""
    return F.element_at(F.lit([-(-sizes.get(i, 0) // most) for i in range(lists)]), F.col("list") + 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, rerank: int = RERANK, train_rows: int = TRAIN_ROWS, lists: int | None = None) -> DataFrame:
    """vectors and queries (vec_id, embedding) -> (query_id, rank, vec_id, score): for each query the k
    rows of largest cosine found, its own vec_id excepted."""
    schema = "query_id long, vec_id long, score double"
    rows = cut(usable(vectors))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    x = np.array([r["v"] for r in sample], np.float64)
    x = x / _length(x)[:, None]
    lists = max(1, min(lists or -(-rows.count() // BLOCK), LISTS, len(x) // 8))
    centre, _ = _centres(x.astype(np.float32), lists, np.random.default_rng(3), True)
    probes = _probes(x.astype(np.float32), centre, k, REACHED)
    mean = x.mean(axis=0)
    y = (x - mean).astype(np.float32)
    quantiser = Quantiser.train(y)
    books, lean = quantiser.books, _lean(y, quantiser.decode(quantiser.encode(y)[0]))
    index = cut(rows.mapInArrow(_encoded(books, centre, mean), "vec_id long, v array<double>, codes binary, norm float, error float, list int"))
    asked = cut(usable(queries, x.shape[1]).mapInArrow(_asking(centre, probes), "query_id long, q array<double>, list int"))
    held, wanted = ({r["list"]: r["count"] for r in t.groupBy("list").count().collect()} for t in (index, asked))  # a row a list
    if not wanted:
        return rows.sparkSession.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    every = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))
    of_rows, of_queries = _blocks(held, lists, BLOCK), _blocks(wanted, lists, QUERY_BLOCK)
    index = index.withColumn("rb", F.pmod(F.xxhash64("vec_id"), of_rows).cast("int")).withColumn("qb", every(of_queries))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), of_queries).cast("int")).withColumn("rb", every(of_rows))
    key = ["list", "rb", "qb"]
    out = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(books, mean, lean, k, share, rerank), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_additive_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
