"""Exact group medians by radix selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.sources.scratch import cut

RADIX_DIGITS = 6
LEVELS = 3


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values, median) of a decimal(18,2) column, NULLs left out.

    The middle ranks are located digit block by digit block: each level keeps at most a million counters per
    block of the level before, whatever the number of rows or distinct amounts, so even a key with a third of all
    rows never fills one task. All levels but the last read the rows once, as counts per block, which combine before
    the shuffle; the last reads only the rows of the blocks that hold a middle rank.
    """
    base = 10 ** RADIX_DIGITS
    blocks = [F.floor(F.col("cents") / F.lit(base ** (LEVELS - 1 - i)).cast("decimal(20,0)")).cast("bigint")
              for i in range(LEVELS)]
    rows = (df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
            .select(F.col(key).alias("k"), (F.col(value) * 100).cast("bigint").alias("cents"))
            .withColumns({f"b{i}": b for i, b in enumerate(blocks)}).withColumn("c", F.lit(1).cast("bigint")))
    upper = [f"b{i}" for i in range(LEVELS - 1)]
    coarse = cut(rows.groupBy("k", *upper).agg(F.sum("c").alias("c")))
    sizes = coarse.groupBy("k").agg(F.sum("c").alias("n_values"))
    targets = sizes.select("k", "n_values", F.explode(F.array_distinct(F.array(
        F.floor((F.col("n_values") + 1) / 2), F.floor(F.col("n_values") / 2) + 1))).alias("rank"))

    def descend(state: DataFrame, level: int) -> DataFrame:
        """Replace each target by the block that holds it and its rank inside that block."""
        within = ["k"] + [f"b{level - 1}"] if level else ["k"]
        block = f"b{level}"
        wanted = state.select(*within).distinct()
        counted = coarse if level < LEVELS - 1 else rows
        hist = counted.join(wanted, within, "left_semi").groupBy(*within, block).agg(F.sum("c").alias("c"))
        upto = hist.withColumn("upto", F.sum("c").over(
            Window.partitionBy(*within).orderBy(block).rowsBetween(Window.unboundedPreceding, 0)))
        return (state.join(upto, within)
                .where("rank > upto - c and rank <= upto")
                .select("k", "n_values", block, (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank")))

    found = reduce(descend, range(LEVELS), targets)
    return found.groupBy(F.col("k").alias(key)).agg(
        F.max("n_values").alias("n_values"),
        ((F.min(f"b{LEVELS - 1}") + F.max(f"b{LEVELS - 1}")).cast("decimal(20,0)") / 200)
        .cast("decimal(18,3)").alias("median"))
