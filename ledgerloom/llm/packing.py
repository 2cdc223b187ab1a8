"""Batches of documents of similar length, with bucket boundaries that minimise padding.

The histogram of lengths of all documents is one aggregation. Dynamic programming over it picks at most ``buckets``
boundaries so that padding every document to its bucket's boundary costs least. Inside a bucket, documents are dealt to
slices of bounded size, numbered there, and put into batches whose padded size stays within the token budget.

Lengths above ``exact_to`` are rounded up to steps of a 1/64 of their size for the choice of boundaries, so that the
histogram on the driver stays under exact_to + 64 * 40 cells whatever the documents; boundaries remain real lengths'
upper bounds and the chosen padding is optimal among boundaries on those cells.

Edge cases: null and empty texts have length 0 and form batches of padded length 0, of at most ``slice_rows`` documents.
A document longer than the budget is a batch of its own. Ties in length are ordered by id. No rows give no rows. Every
row is packed as a document of its own, also where ids are null or shared. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 12
TOKEN_BUDGET = 16_384
EXACT_TO = 2048
SLICE_ROWS = 4096


def word_count(text_col: str = "text") -> Column:
    """Default length: runs of anything but blanks."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cell_of(length: Column, exact_to: int = EXACT_TO) -> Column:
    """The length, or for long ones the next multiple of a 64th of the power of two below."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 6).cast("long")
    return F.when(length <= exact_to, length).otherwise(F.ceil(length / step).cast("long") * step)


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the lengths (ascending), the last among them, with the least total padding.

    cost[k][j]: least padding of the first j lengths with k buckets. The padding of a bucket i..j is
    lengths[j] * count - tokens, from prefix sums.
    """
    n = len(lengths)
    if not n:
        return []
    x = np.array(lengths, np.float64)
    count, tokens = (np.concatenate([[0.0], np.cumsum(v)]) for v in (np.array(counts, np.float64), x * counts))
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    choice = np.zeros((min(buckets, n), n + 1), np.int64)
    best_k, best = 0, np.inf
    for k in range(min(buckets, n)):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            total = cost[:j] + x[j - 1] * (count[j] - count[:j]) - (tokens[j] - tokens[:j])
            choice[k, j] = np.argmin(total)
            new[j] = total[choice[k, j]]
        cost = new
        if cost[n] < best:
            best_k, best = k, cost[n]
    ends, j = [], n
    for k in range(best_k, -1, -1):
        ends.append(int(lengths[j - 1]))
        j = int(choice[k, j])
    return ends[::-1]


def boundaries(docs: DataFrame, length: Column, buckets: int = BUCKETS, exact_to: int = EXACT_TO) -> list[tuple[int, int]]:
    """(boundary, number of documents) of the best buckets; the driver sees the histogram only."""
    cells = docs.groupBy(cell_of(length, exact_to).alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect()
    lengths, counts = [r["cell"] for r in cells], [r["n"] for r in cells]
    ends = best_boundaries(lengths, counts, buckets)
    held = [0] * len(ends)
    for cell, n in zip(lengths, counts):
        held[int(np.searchsorted(ends, cell))] += n
    return list(zip(ends, held))


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET,
         exact_to: int = EXACT_TO, slice_rows: int = SLICE_ROWS, id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_tokens, boundary (padded length), batch_id and place in the batch."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (word_count() if length is None else length).alias("n_tokens"))
    found = boundaries(rows, F.col("n_tokens"), buckets, exact_to)
    boundary, slices = F.lit(0).cast("long"), F.lit(1)
    for end, n in reversed(found):
        fits = F.col("n_tokens") <= end
        boundary = F.when(fits, F.lit(end).cast("long")).otherwise(boundary)
        slices = F.when(fits, F.lit(-(-n // slice_rows))).otherwise(slices)
    rows = rows.select("doc_id", "n_tokens", boundary.alias("boundary"), F.pmod(F.xxhash64("doc_id"), slices).alias("slice"))
    order = Window.partitionBy("boundary", "slice").orderBy("n_tokens", "doc_id")
    fit = F.greatest(F.lit(1), F.when(F.col("boundary") > 0, F.floor(F.lit(token_budget) / F.col("boundary"))).otherwise(
        F.lit(slice_rows))).cast("long")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1).withColumn("fit", fit)
    return numbered.select(
        "doc_id", "n_tokens", "boundary",
        F.concat_ws("-", "boundary", "slice", F.floor(F.col("at") / F.col("fit"))).alias("batch_id"),
        F.pmod(F.col("at"), F.col("fit")).cast("long").alias("place"))
