"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes a space, and its 1-, 2- and 3-grams are hashed to
``BUCKETS`` features. A feature's value is its share of the text's n-grams times its inverse document
frequency in the training sample. Weights are learned by follow-the-regularised-leader (per-coordinate
rates, L1 and L2 penalties, so most are exactly 0); then one temperature is fitted on a part of the
sample that training did not see. Since a share divides by one count, a score is a sum over positions,
and whole texts are scored by array look-ups, in blocks, however long.

Every labelled language is learned. Training reads a bounded sample: of each language the ``take``
documents of smallest keyed hash among those whose crc32(doc_id) mod 5 is not 0, ``take`` being
``per_lang``, or ``SAMPLE_DOCS`` / languages where that is less, ``LEAST_DOCS`` at least. Only text and
lang are read; the features are taken on the executors, and only they go to the driver.

``accepted`` rejects what no learned language explains: a text is kept if its calibrated score and the
share of its n-grams that training has seen reach the bars of the model, each the ``REJECT`` quantile of
what held-out sample texts of right prediction have.

Results on odd input: null text, or text without letters, is ``und`` with score 0; so is every text if
there is nothing to learn from. Of languages of equal score the first in order of names is predicted, and
of sample documents of equal hash the smaller doc_id, then text, is read first. Repeated rows are each predicted; a null doc_id is not held out. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grafold.llm import textwords as T

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PER_LANG, LEAST_DOCS, SAMPLE_DOCS, EPOCHS = 400, 20, 8000, 3
UND = "und"
#: Share of held-out texts that may fall below the bars of ``accepted``, each.
REJECT = 0.001
#: Lengths of the pieces that a sample text counts as, beside the whole.
PIECES = (40, 120)
_ORDERS = (1, 2, 3)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        for i in [*range(0xD800), *range(0xE000, 0x32000)]:
            table[i] = chr(i).isalpha()
        _letters.append(table)
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Code points of a text, lower case, with one space code for all but letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_is_letter()[c], c, np.uint32(32))


def _grams(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: where n-grams that hold a letter start, and their buckets."""
    wide = c.astype(np.uint64)
    for n in _ORDERS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        h = np.full(m, n, np.uint64)
        some = np.zeros(m, bool)
        for j in range(n):
            h = (h ^ wide[j : m + j]) * np.uint64(0x9E3779B97F4A7C15)
            some |= c[j : m + j] != 32
        at = np.flatnonzero(some)
        h = h[at]
        h ^= h >> np.uint64(32)
        yield at, ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    found = [b for _, b in _grams(_codes(text))]
    if not found or not sum(map(len, found)):
        return np.zeros(0, np.int64), np.zeros(0)
    idx, n = np.unique(np.concatenate(found), return_counts=True)
    return idx, n / n.sum()


def _pieces(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of a sample text and, against long-text habits, of a few short pieces of it."""
    found = [_features(text)]
    for size in PIECES:
        if len(text) > 2 * size:
            at = zlib.crc32(text.encode("utf-8", "surrogatepass"), size) % (len(text) - size)
            found.append(_features(text[at : at + size]))
    return found


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # of idf times weight, (BUCKETS, langs), float32
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # whether training saw a bucket, as float32
    least_score: float = 0.0
    least_known: float = 0.0

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def score(self, texts: list[str], known: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, number of n-grams, share of them that training saw; 0 unless ``known``)."""
        table = np.concatenate([self.weights, self.seen[:, None]], axis=1) if known else self.weights
        sums, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
        step = 1 << 20
        for i, text in enumerate(texts):
            if len(text) <= step:
                continue
            for a in range(0, len(text), step):  # n-grams over a cut are counted by the two letters shared
                self._add(table, text[max(0, a - 2) : a + step], sums, n, i, 2 if a else 0)
        short = [i for i, t in enumerate(texts) if len(t) <= step]
        for a in range(0, len(short), 64):
            self._add_many(table, [texts[i] for i in short[a : a + 64]], short[a : a + 64], sums, n)
        k = len(self.langs)
        return self.probabilities(sums[:, :k], n), n, sums[:, k:].sum(axis=1) / np.maximum(n, 1)

    @staticmethod
    def _add(table: np.ndarray, text: str, sums: np.ndarray, n: np.ndarray, i: int, skip: int) -> None:
        c = _codes(text)
        for order, (at, b) in zip(_ORDERS, _grams(c), strict=False):
            new = at >= max(0, skip - order + 1)
            sums[i] += table[b[new]].sum(axis=0, dtype=np.float64)
            n[i] += int(new.sum())

    @staticmethod
    def _add_many(table: np.ndarray, texts: list[str], where: list[int], sums: np.ndarray, n: np.ndarray) -> None:
        """Texts joined by two spaces: an n-gram over a join begins with spaces of the first or ends with them."""
        parts = [_codes(f"  {t}  ")[2:-2] if t else np.zeros(0, np.uint32) for t in texts]
        edge = np.cumsum([0, *(len(p) + 2 for p in parts)])
        gap = np.full(2, 32, np.uint32)
        c = np.concatenate([x for p in parts for x in (p, gap)])
        last = edge[1:] - 2  # the end of each text
        for order, (at, b) in zip(_ORDERS, _grams(c), strict=False):
            doc = np.searchsorted(edge, at, "right") - 1
            own = at + order <= last[doc]
            doc, b = doc[own], b[own]
            value = table[b]
            run = np.zeros((len(b) + 1, value.shape[1]))
            np.cumsum(value, axis=0, out=run[1:])
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            sums[where] += run[cut[1:]] - run[cut[:-1]]
            n[where] += np.diff(cut)


def fit(texts: list[str], langs: list[str], **how) -> Model:
    """Trains on a bounded sample of texts."""
    seen: dict[str, int] = {}
    rows = []
    for text, lang in zip(texts, langs, strict=True):
        seen[lang] = seen.get(lang, 0) + 1
        rows.append((lang, seen[lang], _pieces(text)))
    return fit_features(rows, **how)


def fit_features(sample: list[tuple[str, int, list]], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.001, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Trains on the driver on (lang, rank, features of the pieces); of each language every fifth is held out."""
    names = sorted({s[0] for s in sample})
    number = {x: i for i, x in enumerate(names)}
    k, rng = len(names), np.random.default_rng(seed)
    rows: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
    df = np.zeros(BUCKETS)
    for lang, rank, pieces in sample:
        for idx, x in pieces:
            if len(idx):
                rows.append((idx, x, number[lang], rank % 5 == 1))
                if rank % 5 != 1:
                    df[idx] += 1
    total = sum(not r[3] for r in rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    z, q = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, qb = np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, q: np.ndarray, l1: float = l1) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(q)) / alpha + l2))

    scale = 30.0  # shares are small numbers
    train = [i for i, r in enumerate(rows) if not r[3]]
    for _ in range(epochs):
        for i in rng.permutation(train):
            idx, x, y, _ = rows[i]
            x = x * idf[idx] * scale
            w, wb = weights(z[idx], q[idx]), weights(zb, qb, 0.0)
            s = x @ w + wb
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[idx] += g - (np.sqrt(q[idx] + g * g) - np.sqrt(q[idx])) / alpha * w
            q[idx] += g * g
            zb += p - (np.sqrt(qb + p * p) - np.sqrt(qb)) / alpha * wb
            qb += p * p
    model = Model(names, (weights(z, q) * idf[:, None] * scale).astype(np.float32), weights(zb, qb, 0.0), 1.0, (df > 0).astype(np.float32))
    logits = [(x @ model.weights[idx] + model.bias, y) for idx, x, y, out in rows if out]

    def loss(t: float) -> float:
        total = 0.0
        for s, y in logits:
            v = s / t
            total += np.log(np.exp(v - v.max()).sum()) + v.max() - v[y]
        return total

    if logits and k > 1:
        grid = np.exp(np.linspace(np.log(0.1), np.log(10), 81))
        model.temperature = float(min(grid, key=loss))
    right = [(idx, x, s) for (idx, x, y, out), s in zip((r for r in rows if r[3]), (s for s, _ in logits), strict=True) if s.argmax() == y]
    if right:
        score = [1 / np.exp((s - s.max()) / model.temperature).sum() for _, _, s in right]
        known = [(x * model.seen[idx]).sum() for idx, x, _ in right]
        model.least_score, model.least_known = (float(np.quantile(v, REJECT, method="lower")) for v in (score, known))
    return model


def fold(doc_id: Column) -> Column:
    """Whether a document is held out of training: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """A model of docs(doc_id, text, lang); None if no row is labelled."""
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = {r["lang"]: r["n"] for r in ok.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    take = max(LEAST_DOCS, min(per_lang, SAMPLE_DOCS // len(counts)))
    h = F.abs((F.xxhash64(F.lit("sample"), F.col("doc_id")) % (1 << 30)).cast("double") / float(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.5, 1.3 * take / n + 20 / n)))), F.col("lang"))
    drawn = ok.withColumn("h", h).where(F.col("h") < share)  # before texts are shuffled
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    drawn = drawn.select("lang", "text", first.alias("rank")).where(F.col("rank") <= take)
    found = drawn.mapInArrow(_sampled, "lang string, rank int, idx array<int>, share array<double>").collect()
    sample: dict[tuple[str, int], list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rank"], len(r["idx"]), r["idx"])):
        sample.setdefault((r["lang"], r["rank"]), []).append((np.array(r["idx"], np.int64), np.array(r["share"])))
    return fit_features([(lang, rank, pieces) for (lang, rank), pieces in sample.items()])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of the pieces of sample texts."""
    for batch in batches:
        for lang, rank, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "rank", "text")), strict=True):
            pieces = _pieces(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(pieces)), pa.array([rank] * len(pieces), pa.int32()), pa.array([p[0].astype(np.int32) for p in pieces], pa.list_(pa.int32())), pa.array([p[1] for p in pieces], pa.list_(pa.float64()))],
                ["lang", "rank", "idx", "share"],
            )


def _predict(model: Model | None, known: bool = False):
    """The classifier of a column text, or of the text within a column row where there is none."""
    sent = None
    if model is not None:  # only what is not 0 travels
        at = np.flatnonzero(np.abs(model.weights).max(axis=1))
        sent = (model.langs, at, model.weights[at], model.bias, model.temperature, np.packbits(model.seen > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent:
            langs, at, w, bias, temperature, seen = sent
            full = np.zeros((BUCKETS, len(langs)), np.float32)
            full[at] = w
            here = Model(langs, full, bias, temperature, np.unpackbits(seen).astype(np.float32))
        for batch in batches:
            texts = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("row"), "text")
            for first, last, _, _ in T.spans(texts):
                part = batch.slice(first, last - first)
                rest = [c for c in part.schema.names if c != "text"]
                lang, score, share = [UND] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                if sent:
                    p, n, share = here.score([t or "" for t in texts.slice(first, last - first).to_pylist()], known)
                    best = p.argmax(axis=1)
                    lang = [langs[b] if s else UND for b, s in zip(best, n, strict=True)]
                    score = np.where(n > 0, p[np.arange(len(best)), best], 0.0)
                more = [pa.array(share)] if known else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(lang, pa.string()), pa.array(score), *more], [*rest, "lang_pred", "score", *(["known"] if known else [])])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, held_out, lang_pred, score)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows whose text has letters and reaches the model's bars, with all their columns; none without a
    model. The whole row goes through the classifier, its text once, so nothing is joined."""
    least, known = (model.least_score, model.least_known) if model else (1.0, 1.0)
    names = docs.columns
    kind = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in names)
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    plain = "text" in names and docs.schema["text"].dataType == StringType()
    rows = docs.select(row) if plain else docs.select(row, F.col("text").cast("string").alias("text"))
    judged = rows.mapInArrow(_predict(model, True), f"row struct<{kind}>, lang_pred string, score double, known double")
    return judged.where((F.col("lang_pred") != UND) & (F.col("score") >= least) & (F.col("known") >= known)).select("row.*")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
