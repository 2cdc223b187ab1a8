"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Hashed n-gram counts of corpus and target give one gain per bucket, an array of fixed size. A document's weight is the
sum of its features' gains, looked up in that array batch by batch, and its score adds noise that depends on the id
alone. The best scores are drawn.

Ranks come from a least-significant-digit radix sort over (score, id). Rows stand in blocks of bounded size; a pass
counts each block's digits, turns the counts into the place where each (digit, block) starts, and moves every row there,
in its old order. Starts are sums over blocks within a digit plus the total of all smaller digits, so no step sees more
than one block's rows, one digit's blocks, or ``2 ** RADIX_BITS`` totals. Digits that all rows share are not passed.

Edge cases: a null text has no features and weight 0, like an empty one. Rows are documents: repeated rows, and rows that
share an id, each count and each get a rank; where score and id are equal they follow each other in the table's order.
A null id is hashed as an empty string and comes after all other ids of its score. Scores of documents with fewer than
``min_words`` words are returned, but never drawn. An empty target or corpus counts nothing; an empty table gives no
rows. Other columns are ignored. Texts are read whole, of any length.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
RADIX_BITS = 11
BLOCK_ROWS = 1 << 16
CACHED_WORDS = 1 << 18

# Digits, small letters and everything beyond ASCII make words; capitals become small, all else separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class _Buckets(dict):
    """Bucket of each feature, remembered for as many features as ``CACHED_WORDS``."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[feature] = b = zlib.crc32(feature) % self.n
        return b


def _features(text: str | None, max_n: int, buckets: _Buckets) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``max_n`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    found = [buckets[w] for w in words]
    for n in range(2, max_n + 1):
        found += [buckets[b" ".join(words[i:i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", max_n: int = 1, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks send counts; ``n_buckets`` rows reach the driver."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, buckets = np.zeros(n_buckets, np.int64), _Buckets(n_buckets)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(_features(text, max_n, buckets)[1], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(text_col).mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) per bucket, every bucket counted once more than it was seen."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    n = float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(len(gain))
        for batch in batches:
            words, features, weights = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = _features(text, max_n, buckets)
                words.append(n)
                features.append(len(found))
                weights.append(int(gain[found].sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(weights, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def counting_pass(rows: DataFrame, digit: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One stable pass: ``place`` and ``block`` of every row after sorting by ``digit``, rows of a digit in their old order.

    Rows are moved once, to the task of their (block, digit); counts, starts and places are all found there or from
    one row per (block, digit).
    """
    dealt = rows.withColumn("digit", digit).repartition("block", "digit")
    counts = dealt.groupBy("block", "digit").agg(F.count("*").alias("n"))
    totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    smaller = F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("digit", F.coalesce(smaller, F.lit(0)).alias("opens"))
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(totals), "digit").select(
        "block", "digit", (F.col("opens") + F.col("earlier")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
    moved = dealt.withColumn("nth", nth).join(starts, ["block", "digit"])
    moved = moved.withColumn("place", F.col("start") + F.col("nth"))
    return moved.withColumn("block", F.floor(F.col("place") / block_rows).cast("long")).select(*rows.columns)


def _digits(value: Column, differing: int) -> list[Column]:
    """Digits of an unsigned value whose lowest ``differing`` bits are not the same everywhere, least significant first."""
    return [F.shiftrightunsigned(value, shift).bitwiseAND((1 << RADIX_BITS) - 1).cast("int")
            for shift in range(0, differing, RADIX_BITS)]


def radix_sorted(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (doc_id, score, ..., block, place) with ``place`` from 0 in the order of score, largest first, then id.

    Needs (block, place) to tell all rows apart. What all rows' digits agree on is known from the extremes.
    """
    low, high, first, last, missing = rows.agg(
        F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id"), F.max(F.col("doc_id").isNull())).first()
    if low is None:
        return rows
    flip = -(1 << 63)
    unsigned = F.coalesce(F.col("doc_id").bitwiseXOR(F.lit(flip)), F.lit(0).cast("long"))
    ends = [0] * bool(missing) + [(v ^ flip) & (1 << 64) - 1 for v in (first, last) if v is not None]
    passes = _digits(unsigned, (min(ends) ^ max(ends)).bit_length())
    passes += [F.col("doc_id").isNull().cast("int")] if missing else []
    passes += _digits(F.lit(high) - F.col("score"), (high - low).bit_length())
    for digit in passes or [F.lit(0)]:  # one pass at least turns the first places into numbers without gaps
        rows = written(counting_pass(rows, digit, block_rows), "sorted")
    return rows


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 1, seed: int = 2024,
             n_buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` is null where a document was not drawn.

    Drawn are ``percent`` of the documents with at least ``min_words`` words, rounded down.
    """
    gain = gains(bucket_counts(docs, text_col, max_n, n_buckets), bucket_counts(target, text_col, max_n, n_buckets))
    scored = weighted(docs, gain, id_col, text_col, max_n).withColumn(
        "score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Stored with their places, so that a task that runs again finds every row where it was.
    scored = written(scored.withColumns({"block": F.spark_partition_id().cast("long"),
                                         "place": F.monotonically_increasing_id()}), "scored")
    able = F.col("n_words") >= min_words
    ranked = radix_sorted(scored.where(able), block_rows)
    drawn = percent * ranked.count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ("doc_id", "n_features", "weight", "score")
    return ranked.select(*columns, rank.alias("rank")).unionByName(
        scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
