"""Ledger cleaning: supplier names, keys, amounts, and the split into reconcilable and pending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.keys import document_key, spread_null, strip, supplier_key
from ledgerloom.functions.values import MONEY

# Separators of the brand list, the full-width comma included.
BRAND_SEPARATORS = "[,，/]"


def vendor_aliases(vendors: DataFrame) -> DataFrame:
    """(alias_key, canonical): one row per supplier or brand name that stands for a vendor.

    A vendor's own name outranks any brand. Among vendors of one key the last row counts, among brands
    the first. Names that leave no key are dropped.
    """
    named = vendors.where(F.length(strip(F.col("vendor"))) > 0).select(
        strip(F.col("vendor")).alias("canonical"), "brands", F.col("row_no").cast("bigint").alias("row_no"))
    own = named.select(
        supplier_key(F.col("canonical")).alias("alias_key"), "canonical",
        F.struct(F.lit(0).alias("tier"), (-F.col("row_no")).alias("row_no"), F.lit(0).alias("pos")).alias("rank"))
    brands = named.select(
        "canonical", "row_no", F.posexplode(F.split("brands", BRAND_SEPARATORS)).alias("pos", "brand")).select(
        supplier_key(F.col("brand")).alias("alias_key"), "canonical",
        F.struct(F.lit(1).alias("tier"), "row_no", "pos").alias("rank"))
    return (own.unionByName(brands).where("alias_key is not null")
            .groupBy("alias_key").agg(F.min_by("canonical", "rank").alias("canonical")))


def due_date_from_notes(notes: Column, invoice_date: Column) -> Column:
    days = F.regexp_extract(notes, r"(?iU)(\d+)\s*Days", 1).try_cast("int")
    return F.when(F.length(F.regexp_extract(notes, r"(?iU)(\d+)\s*Days", 1)) > 0,
                  F.date_add(invoice_date, days))


def clean_ledger(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Raw rows with a status -> ledger rows with keys and the amount trio.

    The alias lookup is a plain left join: Spark broadcasts the alias table when its measured size
    allows and otherwise shuffles, with suppliers lacking a key spread over all partitions.
    """
    named = raw.where(F.col("status").isNotNull()).withColumn(
        "own_name", F.coalesce("ordered_from", "brand"))
    keyed = named.withColumn("alias_probe", spread_null(supplier_key(F.col("own_name")), F.col("row_no")))
    resolved = keyed.join(aliases, keyed.alias_probe == aliases.alias_key, "left").withColumn(
        "supplier", F.coalesce("canonical", "own_name"))
    excl = F.col("unit_cost") * F.col("units")
    return resolved.select(
        "invoice_number", "po_number", "supplier", "invoice_date",
        due_date_from_notes(F.col("notes"), F.col("invoice_date")).alias("due_date"),
        F.col("item_description").alias("description"), F.col("units").alias("unit_no"),
        F.lit(None).cast("string").alias("currency"), F.col("unit_cost").alias("unit_price"),
        F.round(excl, 2).try_cast(MONEY).alias("excl"),
        F.round(F.col("total_cost") - excl, 2).try_cast(MONEY).alias("gst"),
        F.round("total_cost", 2).try_cast(MONEY).alias("incl"),
        document_key(F.col("invoice_number")).alias("invoice_key"),
        document_key(F.col("po_number")).alias("po_key"),
        supplier_key(F.col("supplier")).alias("supplier_key"),
        "status", "row_no")


def reconcilable(ledger: DataFrame) -> DataFrame:
    return ledger.where("invoice_key is not null or po_key is not null")


def without_keys(ledger: DataFrame) -> DataFrame:
    return ledger.where("invoice_key is null and po_key is null")
