"""Token counts as an exact length histogram with suffix sums.

Every whole text is encoded once with a byte-level BPE; documents are then only their lengths, added up
to (length, documents). With the sums over all longer lengths,

    documents of at least L tokens, tokens in them, and sum(min(length, L)) = the total truncated to L

hold for every context limit L, as do exact quantiles. The sums are taken in two levels (blocks of
lengths, then within a block), so no task sees the whole histogram. The histogram is checkpointed (a row
a length), as both levels read it.

Results on odd input: null or empty text has length 0; special strings are ordinary text; repeated rows
count each; a very long text is encoded whole; extra columns are ignored; an empty table gives an empty histogram and an empty report.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grafold.operators.components import cut

#: Lengths of one block of the histogram.
BLOCK = 1024
_counters: dict[int, Callable[[str | None], int]] = {}
#: The library's pattern matcher overflows its stack on longer runs of white space.
_LONG_SPACE = re.compile(r"\s{2000}")


def counter(ranks: bytes, pattern: str) -> Callable[[str | None], int]:
    """The function from a text to its number of tokens, one in each Python process."""
    key = hash((ranks, pattern))
    if key not in _counters:
        _counters.clear()
        parsed = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parsed, special_tokens={})
        split = regex.compile(pattern)

        def count(text: str | None) -> int:
            if not text:
                return 0
            if len(text) >= 2000 and _LONG_SPACE.search(text):  # the same pieces, cut here
                return sum(len(encoding._encode_single_piece(m[0].encode())) for m in split.finditer(text))
            return len(encoding.encode_ordinary(text))

        _counters[key] = count
    return _counters[key]


def _lengths(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks, pattern)
        total: dict[int, int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n = count(text)
                total[n] = total.get(n, 0) + 1
            if len(total) > 1 << 16:
                yield _counted(total)
                total = {}
        yield _counted(total)

    return run


def _counted(total: dict[int, int]) -> pa.RecordBatch:
    keys = np.array(sorted(total), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([total[k] for k in keys.tolist()], pa.int64())], ["n_tokens", "n_docs"])


def _document_lengths(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks, pattern)
        for batch in batches:
            n = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def lengths(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_tokens)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_document_lengths(ranks, pattern), "doc_id long, n_tokens long")


def histogram(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """docs(text) -> (n_tokens, n_docs), a row for each length that occurs."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_lengths(ranks, pattern), "n_tokens long, n_docs long")
    return cut(counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) -> and docs_at_least, tokens_at_least, docs_at_most, truncated_total: the number of
    documents of n_tokens or more, their tokens, the documents of n_tokens or fewer, and the corpus total
    with every document cut to n_tokens."""
    hist = hist.withColumns({"block": F.floor(F.col("n_tokens") / BLOCK), "tokens": F.col("n_tokens") * F.col("n_docs")})
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # over blocks alone
    every = Window.partitionBy()
    all_of = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("all_docs"),
        F.sum("t").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(all_of, "block").withColumns({"docs_at_least": F.sum("n_docs").over(within) + F.col("d_after"), "tokens_at_least": F.sum("tokens").over(within) + F.col("t_after")})
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
    )


def report(sums: DataFrame, limits: list[int], quantiles: list[float]) -> dict:
    """From suffix_sums(): totals, the total cut to each limit, and exact quantiles (the smallest length
    that at least that share of documents does not exceed). An empty table gives zeros and None."""
    aggs = [F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens")]
    # sum(min(length, L)) = tokens of documents no longer than L, and L for each longer one.
    aggs += [F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs") * F.col("n_tokens")).otherwise(F.col("n_docs") * x)).alias(f"cut{i}") for i, x in enumerate(limits)]
    row = sums.agg(*aggs).first()
    docs = row["docs"] or 0
    found = sums.agg(*(F.min(F.when(F.col("docs_at_most") >= q * docs, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(quantiles))).first() if quantiles else ()
    return {"docs": docs, "tokens": row["tokens"] or 0, "truncated": {x: row[f"cut{i}"] or 0 for i, x in enumerate(limits)}, "quantiles": dict(zip(quantiles, found, strict=True))}


def default_vocabulary() -> tuple[bytes, str]:
    """The byte-level BPE of 50,256 ranks and its pattern, read on the driver; 0.8 MB go out with the code."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_vocabulary()))
