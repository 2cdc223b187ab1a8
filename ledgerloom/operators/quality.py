"""Data-quality reasons of an invoice against its supplier's history in the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import Config
from ledgerloom.functions.keys import (
    CONFUSABLE_PAIRS, confusion_class, number_shape, spread_null, strip, supplier_key)
from ledgerloom.functions.values import number_text
from ledgerloom.operators.median import exact_median
from ledgerloom.operators.similar import similar_names
from ledgerloom.sources.scratch import cut

# Wording of the reasons.
NO_TOTAL = "Invoice total not extracted"
NO_DATE = "Invoice date not extracted"
UNEQUAL = "excl. GST + GST != incl. GST"
BY_MODEL = "Read by the vision model — figures need manual review"
BY_OCR = "Scanned document read via OCR — figures need manual review"
NO_SUPPLIER = "Supplier not extracted"
MISREAD = "Possible OCR character misread — the ledger has "
TRUNCATED = "Possibly truncated — the ledger has "


def _first_sorted(df: DataFrame, group: list[str], value: str, limit: int, name: str) -> DataFrame:
    """Per group, the array of its ``limit`` smallest values. Ranking is cut before the shuffle, so a hot
    group sends only ``limit`` rows from each task."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(value)))
    return (ranked.where(F.col("rn") <= limit).groupBy(*group)
            .agg(F.array_sort(F.collect_list(value)).alias(name)))


def supplier_amounts(ledger: DataFrame) -> DataFrame:
    """(supplier_key, n_values, median) of the ledger amounts."""
    return exact_median(ledger, "supplier_key", "incl")


def supplier_shapes(ledger: DataFrame) -> DataFrame:
    return (ledger.where("supplier_key is not null")
            .select("supplier_key", number_shape(F.col("invoice_number")).alias("shape")).distinct())


def supplier_numbers(ledger: DataFrame) -> DataFrame:
    return (ledger.where("supplier_key is not null and invoice_number is not null")
            .select("supplier_key", strip(F.col("invoice_number")).alias("number")).distinct())


def supplier_baseline(ledger: DataFrame, cfg: Config) -> DataFrame:
    """One row per ledger supplier: first row, sample count, median, number of shapes and the first few."""
    shapes = supplier_shapes(ledger)
    seen = ledger.where("supplier_key is not null").groupBy("supplier_key").agg(F.min("row_no").alias("first_row"))
    return (seen.join(supplier_amounts(ledger), "supplier_key", "left")
            .join(shapes.groupBy("supplier_key").agg(F.count("*").alias("n_shapes")), "supplier_key", "left")
            .join(_first_sorted(shapes, ["supplier_key"], "shape", cfg.suggestion_limit, "first_shapes"),
                  "supplier_key", "left"))


def first_similar_supplier(names: DataFrame, seen: DataFrame, cfg: Config) -> DataFrame:
    """(name, baseline_key): for each invoice supplier the ledger supplier seen first among the similar ones."""
    pairs = similar_names(names, seen.select(F.col("supplier_key").alias("name")), cfg)
    return (pairs.join(seen, pairs.right_name == seen.supplier_key)
            .groupBy(F.col("left_name").alias("name"))
            .agg(F.min_by("supplier_key", "first_row").alias("baseline_key")))


def misread_numbers(wanted: DataFrame, numbers: DataFrame, cfg: Config) -> DataFrame:
    """(supplier_key, number, hits): ledger numbers that differ only in up to three confusable characters.

    Such numbers have equal confusion classes, which makes this an equi-join.
    """
    pairs = sorted({p for a, b in CONFUSABLE_PAIRS for p in (a + b, b + a)})
    w = wanted.withColumn("cls", confusion_class(F.col("number")))
    c = numbers.select("supplier_key", F.col("number").alias("other"), confusion_class(F.col("number")).alias("cls"))
    diffs = F.filter(F.zip_with(F.split(F.upper("number"), ""), F.split(F.upper("other"), ""), lambda a, b: F.concat(a, b)),
                     lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    hits = (w.join(c, ["supplier_key", "cls"]).where("number <> other and length(number) = length(other)")
            .withColumn("diffs", diffs)
            .where((F.size("diffs") > 0) & (F.size("diffs") <= 3)
                   & F.forall("diffs", lambda p: p.isin(*pairs)))
            .select("supplier_key", "number", "other"))
    return _first_sorted(hits, ["supplier_key", "number"], "other", cfg.suggestion_limit, "hits")


def longer_numbers(wanted: DataFrame, numbers: DataFrame, cfg: Config) -> DataFrame:
    """(supplier_key, number, longer): ledger numbers that continue the reading, one more than is shown.

    Ledger numbers meet a reading on their prefix of its length; only prefixes somebody asks for survive
    the semi-join.
    """
    asked = wanted.where("length(number) >= 4").select("supplier_key", "number").distinct()
    lengths = asked.groupBy("supplier_key").agg(F.collect_set(F.length("number")).alias("lengths"))
    prefixes = numbers.join(lengths, "supplier_key").select(
        "supplier_key", F.col("number").alias("other"),
        F.explode(F.filter("lengths", lambda n: n < F.length("number"))).alias("n")).select(
        "supplier_key", "other", F.expr("substring(other, 1, n)").alias("number"))
    found = prefixes.join(asked, ["supplier_key", "number"], "left_semi")
    return _first_sorted(found, ["supplier_key", "number"], "other", cfg.suggestion_limit + 1, "longer")


def repair_suggestions(wanted: DataFrame, numbers: DataFrame, cfg: Config) -> DataFrame:
    """(supplier_key, number, suggestion) for readings that look misread or cut off."""
    n = cfg.suggestion_limit
    shown = F.concat(F.array_join(F.slice("longer", 1, n), " / "),
                     F.when(F.size("longer") > n, F.lit("...")).otherwise(F.lit("")))
    return (misread_numbers(wanted, numbers, cfg)
            .join(longer_numbers(wanted, numbers, cfg), ["supplier_key", "number"], "full")
            .select("supplier_key", "number", F.coalesce(
                F.concat(F.lit(MISREAD), F.array_join("hits", " / ")),
                F.concat(F.lit(TRUNCATED), shown)).alias("suggestion")))


def quality_input(documents: DataFrame, invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """Live documents with the fields the checks read, scanned numbers already corrected by the ledger."""
    fixes = documents.where("first_corrected_row is not null").select(
        "doc_id", F.col("first_corrected_row").alias("row_no")).join(
        ledger.select("row_no", strip(F.col("invoice_number")).alias("corrected_no")), "row_no").drop("row_no")
    return (documents.join(invoices.select(
        "doc_id", "invoice_no", "supplier", "invoice_date", "subtotal", "second_reader"), "doc_id")
        .join(fixes, "doc_id", "left")
        .withColumn("final_no", F.coalesce("corrected_no", "invoice_no")))


def quality_flags(docs: DataFrame, ledger: DataFrame, cfg: Config) -> DataFrame:
    """(doc_id, quality_flags): the ordered reasons; ``docs`` as laid out by ``quality_input``."""
    seen = ledger.where("supplier_key is not null").groupBy("supplier_key").agg(F.min("row_no").alias("first_row"))
    d = docs.select(
        "doc_id", "final_no", "is_proforma", "ocr", "second_reader", "invoice_date", "supplier",
        F.col("subtotal.amount_excl").alias("e"), F.col("subtotal.gst").alias("g"),
        F.col("subtotal.amount_incl").alias("i"),
        supplier_key(F.col("supplier")).alias("name"), number_shape(F.col("final_no")).alias("shape"))
    matches = first_similar_supplier(d.select("name"), seen, cfg)
    base = supplier_baseline(ledger, cfg).drop("first_row")
    history = matches.join(base, matches.baseline_key == base.supplier_key).drop("supplier_key").withColumnRenamed(
        "name", "history_name")
    d = d.withColumn("probe", spread_null(F.col("name"), F.col("doc_id")))
    d = d.join(history, d.probe == history.history_name, "left").drop("probe", "history_name")

    known = supplier_shapes(ledger).select(
        F.col("supplier_key").alias("known_key"), F.col("shape").alias("known_shape"))
    d = d.withColumn("probe", spread_null(F.col("baseline_key"), F.col("doc_id")))
    d = d.join(known, (d.probe == known.known_key) & (d["shape"] == known.known_shape), "left").drop("probe", "known_key")
    odd = (F.coalesce("n_shapes", F.lit(0)) > 0) & F.col("known_shape").isNull() & ~F.col("is_proforma")
    # The odd ones are looked up below and everything is reported after that: stored, not computed twice.
    d = cut(d.withColumn("odd_shape", odd).drop("probe", "known_key", "known_shape", "n_shapes"))

    wanted = d.where("odd_shape and final_no is not null").select(
        F.col("baseline_key").alias("supplier_key"), strip(F.col("final_no")).alias("number")).distinct()
    repairs = repair_suggestions(wanted, supplier_numbers(ledger), cfg).select(
        F.col("supplier_key").alias("repair_key"), F.col("number").alias("repair_no"), "suggestion")
    probe = spread_null(F.when(F.col("odd_shape"), strip(F.col("final_no"))), F.col("doc_id"))
    d = d.withColumn("probe", probe)
    d = d.join(repairs, (d.probe == repairs.repair_no) & (d.baseline_key == repairs.repair_key), "left")
    return d.select("doc_id", _reasons(cfg).alias("quality_flags"))


def _reasons(cfg: Config) -> Column:
    e, g, i = F.col("e"), F.col("g"), F.col("i")
    median = F.col("median")
    off = ((F.coalesce("n_values", F.lit(0)) >= cfg.outlier_min_samples) & (median > 0)
           & ((i * cfg.outlier_factor < median) | (i > median * cfg.outlier_factor)))
    share = (i - e) / i
    odd_tax = (i > 0) & (e != 0) & ~((i - e >= 0) & (i - e < i * F.lit(cfg.tax_share_limit)))
    shape_text = F.concat(
        F.lit("Invoice number format "), F.col("shape"), F.lit(" doesn't match this supplier's ledger formats ("),
        F.array_join("first_shapes", "/"), F.lit(")"),
        F.coalesce(F.concat(F.lit("; "), F.col("suggestion")), F.lit("")))
    checks = [
        F.when(i.isNull(), F.lit(NO_TOTAL)).when(off, F.concat(
            F.lit("Amount "), number_text(i), F.lit(" is more than 10x off this supplier's median of "),
            number_text(F.round(median, 2)))),
        F.when(F.col("odd_shape"), shape_text),
        F.when(F.col("invoice_date").isNull(), F.lit(NO_DATE)),
        F.when(F.abs(e + g - i) > F.lit(cfg.tolerance), F.lit(UNEQUAL)),
        F.when(odd_tax, F.concat(F.lit("Unusual tax rate: "), F.round(share * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))),
        F.when(F.col("second_reader"), F.lit(BY_MODEL)),
        F.when(F.col("ocr"), F.lit(BY_OCR)),
        F.when(F.coalesce("supplier", F.lit("")) == "", F.lit(NO_SUPPLIER)),
    ]
    return F.filter(F.array(*checks), lambda r: r.isNotNull())
