"""The matching cascade: number, folded number, order batch, nearest amount, order remainder.

Every step is an equi-join of one row per document with a table that is already aggregated to one row
per key. Verdicts never expand a document into its ledger rows, so an order that holds a third of all
rows costs one partial aggregate and not a product of its invoices and rows. Outer joins probe with
``spread_null`` keys; a hot key on the document side is one-to-many only, which lets adaptive execution
split the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import Config
from ledgerloom.functions.keys import document_key, fold_key, spread_null
from ledgerloom.operators.pairing import pair_nearest

AMOUNT = "decimal(28,2)"


def narrow_invoices(invoices: DataFrame) -> DataFrame:
    """The columns matching works on; texts and line items join again by ``doc_id`` at the end."""
    return invoices.select(
        "doc_id", "file_order", document_key(F.col("invoice_no")).alias("invoice_key"),
        document_key(F.col("po_no")).alias("po_key"), F.coalesce("is_proforma", F.lit(False)).alias("is_proforma"),
        F.coalesce("ocr", F.lit(False)).alias("ocr"), F.col("subtotal.amount_incl").alias("total"))


def resolve_duplicates(docs: DataFrame) -> DataFrame:
    """Mark all but the last document of each number, and the place the number first appeared.

    The last one is found by a partial aggregate and joined back by its document, so a number shared by
    very many copies is never gathered in one task.
    """
    last = (docs.where("invoice_key is not null").groupBy("invoice_key")
            .agg(F.max(F.struct("file_order", "doc_id")).alias("last"), F.min("file_order").alias("first_order"))
            .select("last.doc_id", "first_order"))
    return docs.join(last, "doc_id", "left").withColumns({
        "is_duplicate": F.col("invoice_key").isNotNull() & F.col("first_order").isNull(),
        "pool_order": F.struct(F.col("invoice_key").isNull().alias("keyless"),
                               F.coalesce("first_order", "file_order").alias("place"))}).drop("first_order")


def mark_superseded(docs: DataFrame) -> DataFrame:
    """Mark numbered proformas whose order also has a regular invoice, read or not, duplicate or not."""
    taxed = (docs.where("not is_proforma and po_key is not null")
             .select(F.col("po_key").alias("taxed_po")).distinct())
    probe = F.when(F.col("is_proforma") & F.col("invoice_key").isNotNull() & ~F.col("is_duplicate"), F.col("po_key"))
    probed = docs.withColumn("probe", spread_null(probe, F.col("doc_id")))
    return probed.join(taxed, probed.probe == taxed.taxed_po, "left").withColumn(
        "is_superseded", F.col("taxed_po").isNotNull()).drop("probe", "taxed_po")


def prepare(docs: DataFrame) -> DataFrame:
    """Narrow invoices with their marks."""
    return mark_superseded(resolve_duplicates(docs))


def ledger_groups(ledger: DataFrame) -> DataFrame:
    """Ledger pre-aggregated to (order, number); all later sums start from here."""
    return ledger.groupBy("po_key", "invoice_key").agg(
        F.count("*").alias("n"), F.sum("incl").cast(AMOUNT).alias("incl"), F.min("row_no").alias("first_row"))


def number_totals(groups: DataFrame) -> DataFrame:
    return groups.where("invoice_key is not null").groupBy("invoice_key").agg(
        F.coalesce(F.sum("incl"), F.lit(0)).cast(AMOUNT).alias("key_incl"), F.min("first_row").alias("first_row"))


def unique_folds(totals: DataFrame) -> DataFrame:
    """Folded numbers that stand for exactly one ledger number."""
    return (totals.groupBy(fold_key(F.col("invoice_key")).alias("fold"))
            .agg(F.count("*").alias("n_keys"), F.min("first_row").alias("fold_first_row"),
                 F.min("key_incl").alias("fold_incl"), F.min("invoice_key").alias("fold_key"))
            .where("n_keys = 1").drop("n_keys"))


def match_by_number(docs: DataFrame, totals: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Levels 1 and 2: the exact number, else for scans the number up to misread characters.

    The scans' numbers find their folds first and then meet the documents by the number, like the exact ones, so the
    documents are moved once. ``scans`` may be any cheaper table with the numbers of at least all scanned documents.
    """
    exact = totals.select(F.col("invoice_key").alias("exact_key"), F.col("key_incl").alias("exact_incl"))
    read = (docs if scans is None else scans).where("ocr and invoice_key is not null").select(
        F.col("invoice_key").alias("read_key")).distinct().withColumn("read_fold", fold_key(F.col("read_key")))
    folds = unique_folds(totals)
    folds = read.join(folds, read.read_fold == folds.fold).drop("read_fold", "fold")
    d = docs.withColumn("probe", spread_null(F.col("invoice_key"), F.col("doc_id")))
    d = d.join(exact, d.probe == exact.exact_key, "left")
    d = d.join(folds, d.probe == folds.read_key, "left").drop("probe", "read_key")
    asked = F.col("ocr") & F.col("exact_key").isNull()
    d = d.withColumns({c: F.when(asked, F.col(c)) for c in ("fold_key", "fold_incl", "fold_first_row")})
    return d.withColumns({
        "number_level": F.when(F.col("exact_key").isNotNull(), F.lit("number"))
        .when(F.col("fold_key").isNotNull(), F.lit("folded")),
        "real_key": F.coalesce("exact_key", "fold_key"),
        "number_incl": F.coalesce("exact_incl", "fold_incl"),
        "first_corrected_row": F.col("fold_first_row"),
    }).drop("exact_key", "fold_key", "exact_incl", "fold_incl", "fold_first_row")


def claimed_keys(tagged: DataFrame) -> DataFrame:
    return tagged.where("real_key is not null").select(F.col("real_key").alias("claimed_key")).distinct()


def order_pool(tagged: DataFrame) -> DataFrame:
    """Per order, the documents that no number matched."""
    return (tagged.where("number_level is null and po_key is not null").groupBy("po_key")
            .agg(F.count("*").alias("n_docs"), F.count("total").alias("n_totals"),
                 F.sum("total").cast(AMOUNT).alias("docs_incl")))


def order_rows(groups: DataFrame, claimed: DataFrame) -> DataFrame:
    """Per order, all ledger rows and those that no number claimed."""
    g = groups.where("po_key is not null").withColumn("probe", spread_null(F.col("invoice_key"), F.col("first_row")))
    g = g.join(claimed, g.probe == claimed.claimed_key, "left")
    free = F.col("claimed_key").isNull()
    return g.groupBy("po_key").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum("incl"), F.lit(0)).cast(AMOUNT).alias("rows_incl"),
        F.coalesce(F.sum(F.when(free, F.col("n"))), F.lit(0)).alias("n_free"),
        F.coalesce(F.sum(F.when(free, F.col("incl"))), F.lit(0)).cast(AMOUNT).alias("free_incl"))


def order_decisions(pool: DataFrame, rows: DataFrame, cfg: Config) -> DataFrame:
    """How each order with unmatched documents is settled: batch, pair or remainder."""
    complete = (F.col("n_docs") >= 2) & (F.col("n_totals") == F.col("n_docs"))
    agrees = F.abs(F.col("docs_incl") - F.col("rows_incl")) <= F.lit(cfg.tolerance)
    return pool.join(rows, "po_key").withColumn(
        "decision", F.when(complete & agrees, F.lit("batch"))
        .when(complete & (F.col("n_rows") == F.col("n_docs")), F.lit("pair")).otherwise(F.lit("rest")))


def outcome_of(ledger_incl: Column, total: Column, cfg: Config) -> Column:
    return (F.when(total.isNull() | ledger_incl.isNull(), F.lit("discrepancy"))
            .when(F.abs(ledger_incl - total) <= F.lit(cfg.tolerance), F.lit("matched"))
            .otherwise(F.lit("discrepancy")))


def settle(tagged: DataFrame, decisions: DataFrame, ledger: DataFrame, cfg: Config) -> DataFrame:
    """One row per document with its level, the ledger amount it stands against and the outcome.

    Documents that a number matched, usually most, need nothing from the orders and are not moved.
    """
    by_number = tagged.where("number_level is not null")
    d = tagged.where("number_level is null").withColumn("probe", spread_null(F.col("po_key"), F.col("doc_id")))
    orders = decisions.withColumnRenamed("po_key", "order_key")
    d = d.join(orders, d.probe == orders.order_key, "left").drop("probe")
    pairs = pair_nearest(d.where("decision = 'pair'").select("doc_id", "po_key", "total", "pool_order"),
                         ledger.join(decisions.where("decision = 'pair'").select("po_key"), "po_key", "left_semi")
                         .select("po_key", "row_no", "incl"))
    d = d.join(pairs.withColumnRenamed("incl", "pair_incl").withColumnRenamed("row_no", "pair_row"), "doc_id", "left")
    d = d.unionByName(by_number, allowMissingColumns=True)
    level = (F.when(F.col("number_level").isNotNull(), F.col("number_level"))
             .when(F.col("decision") == "batch", F.lit("order_batch"))
             .when(F.col("decision") == "pair", F.lit("order_pair"))
             .when((F.col("decision") == "rest") & (F.col("n_free") == 0), F.lit("order_claimed"))
             .when((F.col("decision") == "rest") & (F.col("n_free") == F.col("n_rows")), F.lit("order"))
             .when(F.col("decision") == "rest", F.lit("order_rest")))
    ledger_incl = (F.when(F.col("number_level").isNotNull(), F.col("number_incl"))
                   .when(F.col("decision") == "pair", F.col("pair_incl").cast(AMOUNT))
                   .when((F.col("decision") == "rest") & (F.col("n_free") > 0), F.col("free_incl"))
                   .otherwise(F.col("rows_incl")))
    d = d.withColumns({"match_level": level, "ledger_incl": ledger_incl})
    outcome = (F.when(F.col("match_level").isNull(), F.lit("invoice_only"))
               .when(F.col("decision") == "batch", F.lit("matched"))
               .otherwise(outcome_of(F.col("ledger_incl"), F.col("total"), cfg)))
    return d.withColumns({
        "outcome": outcome,
        "diff": (F.col("total") - F.col("ledger_incl")).cast(AMOUNT)}).select(
        "doc_id", "file_order", "invoice_key", "po_key", "ocr", "is_proforma", "total", "match_level",
        "real_key", "first_corrected_row", "pair_row", "ledger_incl", "diff", "outcome", "n_docs", "docs_incl")


def unused_rows(ledger: DataFrame, claimed: DataFrame, pool: DataFrame, cfg: Config) -> DataFrame:
    """Ledger rows no document used, as 'ledger_only' or 'still_pending' by their status.

    Every order with documents in the pool ends up used, whichever way it is settled.
    """
    used = pool.select(F.col("po_key").alias("used_po"))
    r = ledger.withColumns({"key_probe": spread_null(F.col("invoice_key"), F.col("row_no")),
                            "po_probe": spread_null(F.col("po_key"), F.col("row_no"))})
    r = r.join(claimed, r.key_probe == claimed.claimed_key, "left_anti")
    r = r.join(used, r.po_probe == used.used_po, "left_anti").drop("key_probe", "po_probe")
    return r.withColumn("outcome", F.when(
        F.coalesce(F.col("status").isin(*cfg.expected_statuses), F.lit(False)),
        F.lit("ledger_only")).otherwise(F.lit("still_pending")))
