"""Keys for tables whose ids are missing or shared, so that operators can rely on unique ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.numbering import numbered


def keyed_rows(rows: DataFrame, id_col: str, tie: Column, nulls_first: bool = False) -> DataFrame | None:
    """(key, of): every row under a key of its own, or None where ids are unique and not null already.

    Keys are 0, 1, 2, ... in the order of the ids, so the smallest key has the smallest id; rows of one id follow each
    other by ``tie``, and rows equal in both in any order. Null ids come last, or first with ``nulls_first``. Looking
    for such ids takes one aggregation over the id column alone. ``of`` holds the row.
    """
    same = rows.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    if same.where("id is null or n > 1").limit(1).count() == 0:
        return None
    i = F.col(id_col)
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("of"), i.alias("id"), tie.alias("tie"))
    order = F.asc_nulls_first("id") if nulls_first else F.asc_nulls_last("id")
    return numbered(packed, [order, "tie"], "key").select("key", "of")


def ids_back(out: DataFrame, keyed: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``out`` with the keys in ``columns`` replaced by ids; null keys stay null. Keys are unique on one side of each join."""
    ids = keyed.select("key", F.col(f"of.`{id_col}`").cast("long").alias("id"))
    for c in columns:
        of = ids.select(F.col("key").alias(f"key_of_{c}"), F.col("id").alias(f"id_of_{c}"))
        out = out.join(of, out[c] == of[f"key_of_{c}"], "left").withColumn(c, F.col(f"id_of_{c}")).drop(f"key_of_{c}", f"id_of_{c}")
    return out
