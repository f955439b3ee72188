"""Vectorised word and shingle hashing over Arrow string columns.

Words are the runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``, with A-Z lower-cased; both rules
touch ASCII bytes only, so they can be applied to UTF-8 without decoding. Whole batches are handled
by array arithmetic: no Python loop runs over documents or words.

A word's hash is a prefix-sum polynomial (modulo 2**64, odd base) of its bytes, finalised with a
64-bit mixer; a shingle's hash chains its words' hashes and keeps 56 bits, which leaves room for a
document ordinal when one sort has to order the shingles of many documents.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text and documents handled at once; a longer document is a chunk of its own.
CHUNK_BYTES, CHUNK_DOCS = 1 << 20, 256
HASH_BITS = 56
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)  # so that NUL bytes count
#: For loose words, every ASCII byte but letters and digits parts words.
_LOOSE = np.zeros(256, dtype=bool)
_LOOSE[:128] = [not chr(i).isalnum() for i in range(128)]
#: Bytes of text after which a worker gives freed memory back: workers live on from stage to stage.
GIVEN_BACK = 1 << 24
_since = [0]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeded(seed: int) -> np.uint64:
    """A well-spread 64-bit constant for a small integer."""
    return mix64(np.array([seed], np.uint64) * _BASE + _K)[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n."""
    if len(_powers[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """The words of a run of documents. ``doc`` is the ordinal of a word's document in the run."""

    n_docs: int
    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray  # byte offsets in data
    end: np.ndarray
    data: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def spans(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES, chunk_docs: int = CHUNK_DOCS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column to runs of documents: (first, last, bytes, offsets in them). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1
        last = min(max(last, first + 1), first + chunk_docs, len(texts))
        a, b = offsets[first], offsets[last]
        yield first, last, data[a:b], offsets[first : last + 1] - a
        first = last
    _give_back(int(offsets[-1] - offsets[0]))


def _give_back(size: int) -> None:
    _since[0] += size
    if _since[0] >= GIVEN_BACK:
        _since[0] = 0
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)


def _folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 with the Latin-1 capitals (U+00C0 to U+00DE) in lower case."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out = data.copy()
    out[at] += 0x20
    return out


def words(data: np.ndarray, offsets: np.ndarray, loose: bool = False) -> Words:
    """Words and their hashes of the documents data[offsets[i]:offsets[i + 1]]. Loose words are parted by
    ASCII punctuation too and have Latin-1 capitals folded."""
    n_docs = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(n_docs, none, none.astype(np.uint64), none, none, data)
    if loose:
        data = _folded(data)
    inner = ~(_LOOSE if loose else _SPACE)[data]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inner[cut]
    ends[cut - 1] = inner[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = powers(len(data))
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_LOWER[data] * power[: len(data)], out=prefix[1:])
    h = mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _K)
    return Words(n_docs, np.searchsorted(offsets, start, "right") - 1, h, start, end, data)


def shingles(w: Words, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, first word) of every k-word shingle. A document of 1..k-1 words has one, its
    whole sequence, if ``whole``; a document without words has none."""
    n = len(w.hash)
    if not n:
        return w.doc, w.hash, np.zeros(0, np.int64)
    at = np.arange(n)
    left = np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :]) if n >= k else at[:0]
    h = np.full(len(left), seeded(k), np.uint64)
    for j in range(k):
        h = mix64((h ^ w.hash[left + j]) * _K)
    doc = w.doc[left]
    if whole and len(short := np.flatnonzero((c := w.counts()) * (c < k))):
        first = np.searchsorted(w.doc, short)
        hs = np.full(len(short), seeded(k), np.uint64)
        for j in range(k - 1):
            live = c[short] > j
            hs[live] = mix64((hs[live] ^ w.hash[first[live] + j]) * _K)
        hs = mix64(hs ^ c[short].astype(np.uint64))
        doc, h, left = np.concatenate([doc, short]), np.concatenate([h, hs]), np.concatenate([left, first])
    return doc, h >> np.uint64(64 - HASH_BITS), left


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles sorted by (document, hash): (document, hash, set size of each document)."""
    assert w.n_docs <= 1 << (64 - HASH_BITS)
    doc, h, _ = shingles(w, k)
    key = np.sort((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | h)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    doc = (key >> np.uint64(HASH_BITS)).astype(np.int64)
    return doc, key & np.uint64((1 << HASH_BITS) - 1), np.bincount(doc, minlength=w.n_docs)


def distinct_hash(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """A 64-bit hash of each document's set, from an order-free sum."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix64(h * _K + seeded(77)), out=total[1:])
    edge = np.searchsorted(doc, np.arange(n_docs + 1))
    size = np.diff(edge).astype(np.uint64)
    return mix64((total[edge[1:]] - total[edge[:-1]]) ^ mix64(size * _BASE + _K))


#: Bits of a Bloom filter at most: 16 MB. A larger set makes it less selective, never wrong.
FILTER_BITS = 1 << 27


def bloom(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter of a table(seed) of 64-bit hashes, as 64-bit words; made on the executors."""
    n = seeds.count()
    size = 1 << 16
    while size < min(16 * n, FILTER_BITS):
        size *= 2
    at = F.explode(F.array(F.col("seed").bitwiseAND(size - 1), F.shiftright("seed", 28).bitwiseAND(size - 1)))
    marked = seeds.select(at.alias("x")).groupBy(F.shiftright("x", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits"))
    out = np.zeros(size >> 6, np.uint64)
    for r in marked.toLocalIterator():
        out[r["word"]] = np.int64(r["bits"]).view(np.uint64)
    return out


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each of some hashes."""
    mask = np.uint64(len(bits) * 64 - 1)
    out = np.ones(len(h), bool)
    for x in (h & mask, (h >> np.uint64(28)) & mask):
        out &= (bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) > 0
    return out
