"""Numbers in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sources.scratch import written

Order = str | Column
ROW_BITS = 33  # monotonically_increasing_id counts a partition's rows in its low 33 bits


def sliced(df: DataFrame, order: list[Order], name: str = "sliced") -> DataFrame:
    """The rows, stored in ranges of ``order``, with ``slice`` (number of the range) and ``at`` (place in it, from 0).

    Ranges are cut by Spark from a sample of the whole order, so equal leading values do not fill one of them.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return written(ranged.withColumns({"slice": F.spark_partition_id().cast("bigint"),
                                       "at": place.bitwiseAND((1 << ROW_BITS) - 1)}), name)


def slice_starts(rows: DataFrame) -> DataFrame:
    """(slice, start): how many rows stand before each slice; one row per slice takes part."""
    counts = rows.groupBy("slice").agg(F.count("*").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def numbered(df: DataFrame, order: list[Order], name: str) -> DataFrame:
    """The rows with ``name``: 0, 1, 2, ... in ``order``.

    The starts of the slices are at most as many rows as the shuffle has partitions. Rows that ``order`` does not
    tell apart follow each other in any order; numbers are stored, so they never change afterwards.
    """
    rows = sliced(df, order, "numbered")
    out = rows.join(F.broadcast(slice_starts(rows)), "slice").withColumn("at", F.col("start") + F.col("at"))
    columns = [F.col(f"`{c}`") for c in df.columns if c != name]
    return out.select(*columns, F.col("at").alias(name))
