"""Quality selection by importance resampling (operator 3).

Two generative models of hashed word n-grams (n = 1, 2) are counted: one of the target, the
documents labelled good (and not toxic), one of all raw documents. A document's
importance is the log of the ratio of its probability under both. Documents are drawn without
replacement with probabilities in proportion to that ratio: each gets a Gumbel number of its
id's hash, and the k largest sums of the two stay (Gumbel top-k).

Counting sums bounded arrays (one count a bucket) from all tasks. The k-th
largest key is found by counting keys in ranges, then in ranges of the
range that holds it, so no sort of the corpus and no large collect takes place;
equal keys at the edge go to the smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import pieces, prepare, save, shingles, small_side, text_buffer, words

BITS = 14
#: Share of the documents that are drawn.
SHARE = 0.5
#: Ranges of one step of the search for the k-th key.
RANGES = 4096


def _buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bucket of each n-gram, its row)."""
    buf, off = text_buffer(column)
    shift = np.uint64(64 - BITS)
    for a, b in pieces(off):
        h, row, _, _ = words(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        pair, at = shingles(h, row, b - a, 2)
        yield a, b - a, np.concatenate([h >> shift, pair >> shift]).astype(np.int64), np.concatenate([row, at])


def counts(docs: DataFrame, target: Column) -> np.ndarray:
    """N-gram counts (raw and target x buckets) of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            for first, n, bucket, row in _buckets(batch.column(0)):
                total[0] += np.bincount(bucket, minlength=1 << BITS)
                total[1] += np.bincount(bucket[good[first : first + n][row]], minlength=1 << BITS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    found = docs.select("text", F.coalesce(target, F.lit(False)).alias("target")).mapInArrow(work, "bucket int, raw long, target long")
    out = np.zeros((2, 1 << BITS), dtype=np.int64)
    for r in found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def ratios(n: np.ndarray) -> np.ndarray:
    """log of target probability over raw probability, by bucket; zeros without a target."""
    if not n[1].sum():
        return np.zeros(n.shape[1])
    p = (n + 1) / (n + 1).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_grams``, ``log_ratio`` (of the document) and ``mean_ratio`` (of one n-gram)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, bucket, row in _buckets(batch.column(1)):
                size = np.bincount(row, minlength=n)
                total = np.bincount(row, ratio[bucket], minlength=n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(size, pa.int64()), pa.array(total), pa.array(total / np.maximum(1, size))], names=["doc_id", "n_grams", "log_ratio", "mean_ratio"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_grams long, log_ratio double, mean_ratio double")


def top_k(rows: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    """``rows`` with ``selected``: the k largest keys, ties to the smaller ``tie``, then all equals.

    Ranges are counted and narrowed until the range of the k-th key is small
    or a single value; then only the rows at the edge are ranked.
    """
    ends = rows.agg(F.min(key), F.max(key)).first()
    low, high = ends[0], ends[1]
    if low is None or k <= 0:
        return rows.withColumn("selected", F.lit(False))
    above = 0
    while True:
        inside = rows.where(F.col(key).between(low, high))
        width = (high - low) / RANGES
        if not width or low + width == low:
            break
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(RANGES - 1)).cast("int")
        found = sorted(((r["place"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()), reverse=True)
        if above + sum(n for _, n, _, _ in found) <= k:
            return rows.withColumn("selected", F.col(key) >= low)
        for _, n, a, b in found:
            if above + n >= k:
                (size, low, high) = (n, a, b)
                break
            above += n
        if low == high or size <= 100_000:
            break
    edge = rows.where(F.col(key).between(low, high)).orderBy(F.desc(key), tie).limit(k - above)
    last = edge.agg(F.min_by(F.struct(key, tie), F.struct(F.col(key), -F.col(tie))).alias("last")).first()["last"]
    return rows.withColumn("selected", (F.col(key) > last[0]) | (F.col(key) == last[0]) & (F.col(tie) <= last[1]))


def resample(docs: DataFrame, target: Column, share: float = SHARE, seed: int = 17) -> DataFrame:
    """Log importance ratios of all documents, and which of them are drawn.

    ``docs`` has ``doc_id`` and ``text``; ``target`` is true for rows of the target.
    Returns ``doc_id``, ``n_grams``, ``log_ratio``, ``mean_ratio``, ``gumbel_key`` (the log
    ratio and a Gumbel number) and ``selected``, true for ``ceil(share * documents)`` rows of the largest keys.
    A null or empty text has no n-gram and a log ratio of 0. Repeated rows have
    equal keys and are drawn or left together, by ties a few beyond the share; a null id's key is made as
    if it were 0. Without any target row all ratios are 0 and the draw is uniform.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(target, F.lit(False)).alias("target"))
    ratio = ratios(counts(source, F.col("target")))
    id_or_0 = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), id_or_0), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weights(source, ratio).withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform)))
    keyed = save(keyed.withColumn("_tie", id_or_0))
    k = int(np.ceil(share * keyed.count()))
    return top_k(keyed, "gumbel_key", k, "_tie").drop("_tie")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (id and text) with ``target``: labelled quality 1 and not toxic."""
    fine = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    fine = save(fine.select(F.col("doc_id").alias("_id"), F.lit(True).alias("target")))
    return docs.select("doc_id", "text").join(small_side(fine), F.col("doc_id") == F.col("_id"), "left").drop("_id")
