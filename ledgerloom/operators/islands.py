"""Runs of adjacent items with equal keys, counted and numbered over ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.numbering import sliced


def _in_slices(df: DataFrame, part: list[str], order: list[str], first: Column, last: Column | None,
               inner: Column | None) -> DataFrame:
    """Items in ranges of the order, with ``inside``: another run begins here, as its slice alone can tell.

    ``leads`` marks the first item of a part in its slice, which only the slice before can judge.
    """
    last, inner = first if last is None else last, F.lit(0) if inner is None else inner
    rows = sliced(df.withColumns({"run_first": first, "run_last": last, "run_inner": inner.cast("bigint")}),
                  [*part, *order], "runs")
    before = F.lag(F.struct("run_last")).over(Window.partitionBy("slice", *part).orderBy("at"))
    return rows.withColumns({"leads": before.isNull(), "inside": before.isNotNull() & ~F.col("run_first").eqNullSafe(
        before["run_last"])}).withColumn("inside", F.coalesce("inside", F.lit(False)))


def _edges(rows: DataFrame, part: list[str]) -> DataFrame:
    """One row per part and slice; ``opens`` tells whether its first item begins a run."""
    edges = rows.groupBy("slice", *part).agg(
        F.min_by("run_first", "at").alias("run_first"), F.max_by("run_last", "at").alias("run_last"),
        F.sum(F.col("inside").cast("bigint") + F.col("run_inner")).alias("n"), F.count("*").alias("n_items"))
    before = F.lag(F.struct("run_last")).over(Window.partitionBy(*part).orderBy("slice"))
    return edges.withColumn("opens", before.isNull() | ~F.col("run_first").eqNullSafe(before["run_last"]))


def count_runs(df: DataFrame, part: list[str], order: list[str], first: Column, last: Column | None = None,
               inner: Column | None = None) -> DataFrame:
    """Per ``part``: n_items, n_runs, and the keys at both ends as ``first_key`` and ``last_key``.

    An item may stand for several adjacent rows: ``first`` and ``last`` are the keys of its ends, ``inner`` counts the
    changes of key inside it.
    """
    edges = _edges(_in_slices(df, part, order, first, last, inner), part)
    return edges.groupBy(*part).agg(
        F.sum("n_items").alias("n_items"), F.sum(F.col("n") + F.col("opens").cast("bigint")).alias("n_runs"),
        F.min_by("run_first", "slice").alias("first_key"), F.max_by("run_last", "slice").alias("last_key"))


def number_runs(df: DataFrame, part: list[str], order: list[str], first: Column, last: Column | None = None,
                inner: Column | None = None) -> DataFrame:
    """Adds ``starts_run`` and ``run_no`` (from 1 within each ``part``) of the first row that each item stands for.

    Slices are ranges of the order itself, however sparse or skewed its values are. Runs are found inside each slice,
    and one summary row per slice and part takes part in stitching the slices together.
    """
    rows = _in_slices(df, part, order, first, last, inner)
    edges = _edges(rows, part)
    e = Window.partitionBy(*part).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    base = F.sum(F.col("n") + F.col("opens").cast("bigint")).over(e) - F.col("n")
    so_far = F.sum(F.col("inside").cast("bigint") + F.col("run_inner")).over(
        Window.partitionBy("slice", *part).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.select(F.col("slice").alias("edge_slice"), *[F.col(p).alias(f"edge_{p}") for p in part], "opens",
                         base.alias("base"))
    same = F.col("slice") == F.col("edge_slice")
    for p in part:
        same = same & F.col(p).eqNullSafe(F.col(f"edge_{p}"))
    return rows.withColumn("so_far", so_far).join(edges, same).withColumns({
        "starts_run": F.col("inside") | (F.col("leads") & F.col("opens")),
        "run_no": F.col("base") + F.col("so_far") - F.col("run_inner")}).drop(
        "run_first", "run_last", "run_inner", "leads", "inside", "slice", "at", "so_far", "opens", "base",
        *[c for c in edges.columns if c.startswith("edge_")])
