"""One query per operator, over whole tables derived from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.config import Config
from ledgerloom.functions import keys, patterns as P, texts, values
from ledgerloom.operators import documents as docs_op
from ledgerloom.operators import (
    candidates, filenames, headers, ledger as ledger_op, matching, outcome_lines, pairing, quality, review,
    second_reader, similar, totals)
from ledgerloom.operators.factored import Factored
from ledgerloom.plans import extraction
from ledgerloom.plans.cascade import Cascade
from ledgerloom.plans.reconcile import all_lines, with_pending
from ledgerloom.sources import publish, sinks, tables
from ledgerloom.sources.derived import base_table, derived
from ledgerloom.sources.scratch import cut, shared_folder, size_shuffles, written
from ledgerloom.sources.tables import file_kind

CFG = Config(prior_period="1997")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Column types every engine prints alike: amounts as double, dates and lists as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, " | ")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        size_shuffles([base_table(spark, sf_dir, t) for t in ("lineitem", "orders")])
        return plain(f(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def cascade(s: SparkSession, d: str) -> Cascade:
    return Cascade(derived(s, d, "ledger"), derived(s, d, "invoice"), CFG)


def totals_of(inv: DataFrame) -> DataFrame:
    return inv.withColumns({"excl": F.col("subtotal.amount_excl"), "gst": F.col("subtotal.gst"),
                            "incl": F.col("subtotal.amount_incl")}).drop("subtotal")


# --- ledger side ---------------------------------------------------------------------------------

@query
def ledger_clean(s, d):
    aliases = ledger_op.vendor_aliases(derived(s, d, "vendor"))
    return ledger_op.clean_ledger(derived(s, d, "ledger_raw"), aliases)


@query
def vendor_alias(s, d):
    return ledger_op.vendor_aliases(derived(s, d, "vendor"))


@query
def reconcilable_split(s, d):
    aliases = ledger_op.vendor_aliases(derived(s, d, "vendor"))
    clean = ledger_op.clean_ledger(derived(s, d, "ledger_raw"), aliases)
    part = F.when(F.col("invoice_key").isNull() & F.col("po_key").isNull(), "pending").otherwise("expected")
    return clean.groupBy(part.alias("part"), "status").agg(
        F.count("*").alias("n"), F.countDistinct("invoice_key").alias("n_numbers"), F.sum("incl").alias("incl"))


@query
def key_normalize(s, d):
    raw = derived(s, d, "ledger_raw")
    return raw.select("row_no", keys.document_key(F.col("invoice_number")).alias("invoice_key"),
                      keys.document_key(F.col("po_number")).alias("po_key"),
                      keys.supplier_key(F.col("ordered_from")).alias("supplier_key"),
                      keys.fold_key(keys.document_key(F.col("invoice_number"))).alias("fold"),
                      keys.is_valid_number(F.col("invoice_number")).alias("valid"))


@query
def number_shape(s, d):
    return (derived(s, d, "invoice").groupBy(keys.number_shape(F.col("invoice_no")).alias("shape"))
            .agg(F.count("*").alias("n")))


@query
def identifier_print(s, d):
    li = base_table(s, d, "lineitem")
    ident = keys.identifier_text(F.col("l_quantity") * F.when(F.col("l_linenumber") == 1, 0.5).otherwise(1.0))
    return li.groupBy(ident.alias("identifier")).agg(F.count("*").alias("n"))


# --- matching ------------------------------------------------------------------------------------

@query
def exact_match_verdict(s, d):
    inv = matching.narrow_invoices(derived(s, d, "invoice"))
    led = matching.number_totals(matching.ledger_groups(derived(s, d, "ledger")))
    j = inv.withColumn("probe", keys.spread_null(F.col("invoice_key"), F.col("doc_id")))
    j = j.join(led.withColumnRenamed("invoice_key", "ledger_key"), F.col("probe") == F.col("ledger_key"), "left")
    verdict = F.when(F.col("ledger_key").isNull(), "no_exact_key").otherwise(
        matching.outcome_of(F.col("key_incl"), F.col("total"), CFG))
    return j.select("doc_id", "total", F.col("key_incl").alias("ledger_incl"), verdict.alias("verdict"))


@query
def dedupe_last(s, d):
    return cascade(s, d).prepared.select("doc_id", "is_duplicate")


@query
def duplicate_invoice(s, d):
    return outcome_lines.duplicate_report(cascade(s, d).prepared, derived(s, d, "invoice"))


@query
def superseded_proforma(s, d):
    return outcome_lines.superseded_report(cascade(s, d).prepared, derived(s, d, "invoice"))


@query
def fold_unique_match(s, d):
    return cascade(s, d).tagged.where("number_level = 'folded'").select(
        "doc_id", "invoice_key", "real_key", F.col("number_incl").alias("ledger_incl"))


@query
def po_pool(s, d):
    c = cascade(s, d)
    return c.decisions.select("po_key", "n_docs", "docs_incl", "n_rows", "rows_incl", "n_free", "free_incl", "decision")


def _level(*levels):
    def run(s, d):
        return cascade(s, d).documents.where(F.col("match_level").isin(*levels)).select(
            "doc_id", "match_level", "ledger_incl", "total", "diff", "outcome")
    return run


@query
def po_batch_match(s, d):
    return _level("order_batch")(s, d)


@query
def po_nearest_pair(s, d):
    """Pairs every order with as many numberless or foreign documents as rows, batch or not."""
    c = cascade(s, d)
    equal = c.decisions.where("n_docs >= 2 and n_rows = n_docs and n_totals = n_docs").select("po_key")
    docs = c.tagged.where("number_level is null").join(equal, "po_key", "left_semi")
    rows = c.ledger.join(equal, "po_key", "left_semi")
    return pairing.pair_nearest(docs.select("doc_id", "po_key", "total", "pool_order"), rows.select("po_key", "row_no", "incl"))


@query
def po_remainder_match(s, d):
    return _level("order", "order_rest", "order_claimed")(s, d)


@query
def document_verdicts(s, d):
    return cascade(s, d).documents.select("doc_id", "match_level", "ledger_incl", "total", "diff", "outcome")


@query
def ledger_only(s, d):
    return cascade(s, d).unused.where("outcome = 'ledger_only'").select("row_no", "status", "incl")


@query
def still_pending(s, d):
    return cascade(s, d).unused.where("outcome = 'still_pending'").select("row_no", "status", "incl")


@query
def invoice_only(s, d):
    return cascade(s, d).documents.where("outcome = 'invoice_only'").select(
        "doc_id", outcome_lines.unmatched_note(F.col("po_key"), CFG).alias("note"))


@query
def outcome_counts(s, d):
    c = cascade(s, d)
    docs = c.documents.groupBy("outcome", F.coalesce("match_level", F.lit("none")).alias("level")).agg(
        F.count("*").alias("n"), F.sum("total").alias("total"))
    rows = c.unused.groupBy("outcome", F.lit("ledger").alias("level")).agg(
        F.count("*").alias("n"), F.sum("incl").alias("total"))
    return docs.unionByName(rows)


# --- outcome rows and reports ---------------------------------------------------------------------

def lines_of_run(s, d):
    c = cascade(s, d)
    return c, all_lines(c, derived(s, d, "invoice"), CFG)


@query
def merged_lines(s, d):
    c = cascade(s, d)
    links = outcome_lines.ledger_links(c.ledger, c.documents, c.claimed, c.decisions)
    links = cut(links.select("group_key", *outcome_lines.LISTED))
    return outcome_lines.merged_lines(c.documents, links, derived(s, d, "invoice"), CFG).drop("source_file")


@query
def ledger_link_groups(s, d):
    c = cascade(s, d)
    return outcome_lines.ledger_links(c.ledger, c.documents, c.claimed, c.decisions).select("group_key", "row_no")


@query
def pdf_lines(s, d):
    c = cascade(s, d)
    return outcome_lines.invoice_lines(
        c.documents.where("outcome = 'invoice_only'"), derived(s, d, "invoice"), CFG).drop("source_file", "match_level")


#: Ledger columns that the reports read; only the sheets list the others.
REPORTED = ("row_no", "invoice_key", "po_key", "invoice_number", "po_number", "supplier")


def factored(s, d, flags=False, whole=False):
    c, inv = cascade(s, d), derived(s, d, "invoice")
    q = None
    if flags:
        q = cut(quality.quality_flags(quality.quality_input(c.documents, inv, c.ledger), c.ledger, CFG))
    ledger = c.ledger if whole else c.ledger.select(*REPORTED)
    links = written(outcome_lines.ledger_links(ledger, c.documents, c.claimed, c.decisions), "links", compression="zstd")
    return c, Factored(c.documents, links, c.unused, inv, CFG, q)


@query
def contiguous_groups(s, d):
    return factored(s, d)[1].line_runs()


@query
def group_runs(s, d):
    """Runs as ranges: where each begins and how many lines it has."""
    return factored(s, d)[1].runs()


@query
def kpi(s, d):
    c, f = factored(s, d)
    return f.indicators(c.prepared)


@query
def payables_export(s, d):
    return factored(s, d, whole=True)[1].payables()


@query
def display_text(s, d):
    _, lines = lines_of_run(s, d)
    shown = review.displayed(lines)
    return shown.groupBy("source", "currency", "due_date").agg(
        F.count("*").alias("n"), F.max("incl").alias("max_incl"), F.min("description").alias("first_description"))


@query
def pending_rows(s, d):
    clean = ledger_op.clean_ledger(derived(s, d, "ledger_raw"), ledger_op.vendor_aliases(derived(s, d, "vendor")))
    c = cascade(s, d)
    return outcome_lines.pending_report(ledger_op.without_keys(clean), c.unused)


@query
def warnings_report(s, d):
    c = cascade(s, d)
    return review.warnings_report(c.prepared, derived(s, d, "invoice"), review.corrections(c.tagged, c.ledger))


@query
def flagged_documents(s, d):
    return factored(s, d, flags=True)[1].flagged_documents().drop("source_file")


@query
def highlight_counts(s, d):
    return factored(s, d, flags=True)[1].highlight_counts()


@query
def override_apply(s, d):
    """Edits groups of all four origins, as a person would type them: numbers matched with another amount, invoices
    without a match, and large ledger rows without an invoice, due or not."""
    c, lines = lines_of_run(s, d)
    lines = written(with_pending(lines, derived(s, d, "ledger"), c), "correctable", compression="zstd")
    edits = review.with_group_id(lines).where(
        "outcome = 'discrepancy' and match_level = 'number' or outcome = 'invoice_only' "
        "or outcome in ('ledger_only', 'pending') and incl >= 40000").select(
        "group_id", "line_no", "invoice_number", "po_number", "supplier",
        F.date_format("invoice_date", "dd/MM/yyyy").alias("invoice_date"), F.lit("soon").alias("due_date"),
        "description", F.lit("a dozen").alias("unit_no"), "currency", F.col("unit_price").cast("string").alias("unit_price"),
        F.format_number("excl", 2).alias("excl"), F.lit("").alias("gst"),
        F.concat(F.lit(" "), F.format_number("incl", 2)).alias("incl"))
    return review.apply_overrides(lines, edits).select(
        "group_id", "line_no", "outcome", "from_outcome", "invoice_date", "due_date", "unit_no", "excl", "gst", "incl",
        "note", "rejected")


# --- quality and candidates -----------------------------------------------------------------------

@query
def supplier_baseline(s, d):
    return quality.supplier_baseline(derived(s, d, "ledger"), CFG)


@query
def quality_flags(s, d):
    c = cascade(s, d)
    return quality.quality_flags(quality.quality_input(c.documents, derived(s, d, "invoice"), c.ledger), c.ledger, CFG)


@query
def repair_suggest(s, d):
    """Suggestions for all numbers as read, and for all numbers cut off after the second part."""
    inv = derived(s, d, "invoice").where("invoice_no is not null")
    asked = inv.select(F.col("ledger_supplier").alias("supplier_key"), F.explode(F.array(
        "invoice_no", F.regexp_extract("invoice_no", "^(.*)-[^-]*$", 1))).alias("number")).distinct()
    return quality.repair_suggestions(asked, quality.supplier_numbers(derived(s, d, "ledger")), CFG)


@query
def similar_suppliers(s, d):
    inv = derived(s, d, "invoice").select("supplier").distinct().select(keys.supplier_key(F.col("supplier")).alias("name"))
    led = derived(s, d, "ledger").select(F.col("supplier_key").alias("name"))
    return similar.similar_names(inv, led, CFG)


@query
def first_similar_supplier(s, d):
    inv = derived(s, d, "invoice").select("supplier").distinct().select(keys.supplier_key(F.col("supplier")).alias("name"))
    seen = derived(s, d, "ledger").groupBy("supplier_key").agg(F.min("row_no").alias("first_row"))
    return quality.first_similar_supplier(inv, seen, CFG)


@query
def candidate_topk(s, d):
    c = cascade(s, d)
    un = c.documents.where("outcome = 'invoice_only' and invoice_key is not null").select("doc_id", "total")
    un = un.join(derived(s, d, "invoice").select("doc_id", "supplier", "invoice_date"), "doc_id")
    return candidates.rank_candidates(un, c.ledger, CFG)


# --- reading texts --------------------------------------------------------------------------------

def gathered(s, d):
    return extraction.gather(derived(s, d, "page"), derived(s, d, "ocr_page"), CFG)


@query
def header_extract(s, d):
    h = extraction.read_headers(gathered(s, d), CFG)
    return h.select("doc_id", "invoice_no", "invoice_date", "due_date", "po_no", "supplier", "currency", "terms")


@query
def currency_detect(s, d):
    g = gathered(s, d)
    return g.select("doc_id", headers.currency(F.col("text"), F.col("layout")).alias("currency"))


@query
def label_below(s, d):
    g = gathered(s, d).select("doc_id", "layout", texts.lines_of(F.col("layout")).alias("lines"))
    return g.select("doc_id", *[headers.below(F.col("layout"), F.col("lines"), label).alias(name) for name, label in (
        ("below_no", P.BELOW_INVOICE_NO), ("below_day", P.BELOW_INVOICE_DATE), ("below_po", P.BELOW_PO_NO),
        ("below_due", P.BELOW_DUE_DATE), ("below_total", P.BELOW_TOTAL))])


@query
def table_kv(s, d):
    # an inner generator would have Spark check each map for emptiness first, and so read all tables twice
    g = docs_op.document_texts(derived(s, d, "page"))
    return headers.read_table_values(g, "tables").select("doc_id", F.explode_outer("table_values").alias("key", "value")).where(
        "key in ('invoice no', 'invoice date', 'po no', 'due date', 'terms')")


@query
def item_table(s, d):
    g = docs_op.document_texts(derived(s, d, "page"))
    g = totals.item_rows(g.withColumn("item_table", totals.item_table(F.col("tables")))).where("has_table")
    return g.select("doc_id", F.col("table_total.amount_excl").alias("excl"), F.col("table_total.gst").alias("gst"),
                    F.col("table_total.amount_incl").alias("incl"), F.explode_outer("table_items").alias("item")).select(
        "doc_id", "excl", "gst", "incl", F.col("item.description").alias("description"), F.col("item.qty").alias("qty"),
        F.col("item.amount_incl").alias("item_incl"))


@query
def filename_parse(s, d):
    inv = filenames.read_file_name(derived(s, d, "invoice"), "source_file", CFG)
    return inv.select("doc_id", "name_po", "name_date", "name_supplier", "name_number", "name_proforma")


@query
def totals_extract(s, d):
    g = gathered(s, d)
    g = g.withColumns({"text_words": texts.words_in(F.col("text")), "layout_words": texts.words_in(F.col("layout"), F.col("text"))})
    g = g.withColumns(totals.printed_totals(F.col("text"), F.col("layout"), (F.col("text_words"), F.col("layout_words"))))
    g = g.withColumns({c: values.money(F.col(c)) for c in ("t_excl", "t_gst", "t_incl")})
    return totals.balance_totals(g, "t_excl", "t_gst", "t_incl", CFG).select("doc_id", "t_excl", "t_gst", "t_incl")


@query
def totals_algebra(s, d):
    """Every branch of the balancing, over all lines with readings lost or disturbed by their columns."""
    led = derived(s, d, "ledger0")
    m = F.col("row_no") % 13
    gst = F.col("incl") - F.col("excl")
    t = led.select("row_no",
                   F.when(m.isin(0, 1, 2), None).when(m == 3, -F.col("excl")).when(m == 4, F.col("incl")).otherwise(F.col("excl")).cast("decimal(18,2)").alias("e"),
                   F.when(m.isin(0, 4, 5), None).when(m == 6, F.lit(9)).otherwise(gst).cast("decimal(18,2)").alias("g"),
                   F.when(m.isin(1, 7), None).when(m == 8, F.lit(0)).otherwise(F.col("incl")).cast("decimal(18,2)").alias("i"))
    return totals.balance_totals(t, "e", "g", "i", CFG)


@query
def scan_detect(s, d):
    return docs_op.scan_report(derived(s, d, "page"), CFG).drop("n_chars")


@query
def scan_detect_documents(s, d):
    docs = base_table(s, d, "documents").select("doc_id", "text")
    return docs_op.scan_report(docs, CFG).select("doc_id", "n_pages", "is_scanned")


@query
def layout_rebuild(s, d):
    return docs_op.rebuild_layout(derived(s, d, "word"), CFG).select("doc_id", "page_no", "layout_text")


@query
def json_second_reader(s, d):
    r = second_reader.second_readings(derived(s, d, "second_reader"), CFG)
    return r.select("doc_id", F.col("reading").isNotNull().alias("valid"), F.col("reading.invoice_no").alias("invoice_no"),
                    F.col("reading.invoice_date").alias("invoice_date"), F.col("reading.supplier").alias("supplier"),
                    F.col("reading.subtotal.amount_excl").alias("excl"), F.col("reading.subtotal.gst").alias("gst"),
                    F.col("reading.subtotal.amount_incl").alias("incl"), F.size("reading.line_items").alias("n_items"))


@query
def invoice_extract(s, d):
    x = extraction.extract_invoices(derived(s, d, "page"), derived(s, d, "ocr_page"), None, CFG)
    return totals_of(x).select("doc_id", "source_file", "invoice_no", "po_no", "supplier", "supplier_from_body",
                               "currency", "invoice_date", "due_date", "is_proforma", "ocr", "excl", "gst", "incl",
                               F.size("line_items").alias("n_items"))


@query
def second_reader_merge(s, d):
    x = extraction.extract_invoices(derived(s, d, "page"), derived(s, d, "ocr_page"), derived(s, d, "second_reader"), CFG)
    return totals_of(x).select("doc_id", "invoice_no", "invoice_date", "supplier", "second_reader", "incl",
                               F.size("line_items").alias("n_items"))


@query
def text_to_outcome(s, d):
    """From page text to verdict counts."""
    x = written(extraction.extract_invoices(derived(s, d, "page"), derived(s, d, "ocr_page"), None, CFG), "extracted", compression="zstd")
    c = Cascade(derived(s, d, "ledger"), x, CFG)
    return c.documents.groupBy("outcome", F.coalesce("match_level", F.lit("none")).alias("level")).agg(
        F.count("*").alias("n"), F.sum("total").alias("total"))


# --- sources and sinks -----------------------------------------------------------------------------

@query
def outcome_sink(s, d):
    folder = f"{shared_folder(s)}/published/{uuid.uuid4().hex}"
    publish.publish({"outcome": sinks.outcome_sheet(lines_of_run(s, d)[1])}, folder, partitions={"outcome": "outcome"})
    return publish.read_published(s, folder, "outcome")


@query
def side_report_sinks(s, d):
    """Superseded invoices and pending rows, published together and read back through the manifest."""
    clean = ledger_op.clean_ledger(derived(s, d, "ledger_raw"), ledger_op.vendor_aliases(derived(s, d, "vendor")))
    c = cascade(s, d)
    folder = f"{shared_folder(s)}/published/{uuid.uuid4().hex}"
    publish.publish({
        "superseded": sinks.superseded_sheet(outcome_lines.superseded_report(c.prepared, derived(s, d, "invoice"))),
        "pending": sinks.pending_sheet(outcome_lines.pending_report(ledger_op.without_keys(clean), c.unused))}, folder)
    sup, pen = (publish.read_published(s, folder, n) for n in ("superseded", "pending"))
    return sup.select(F.lit("superseded").alias("report"), F.col("Invoice No").alias("number"), F.col("PO").alias("po"),
                      F.col("Supplier").alias("supplier"), F.col("Total").alias("amount"), F.col("File").alias("place")
                      ).unionByName(pen.select(
                          F.lit("pending").alias("report"), F.col("Invoice Number").alias("number"),
                          F.col("PO Number").alias("po"), F.col("Supplier").alias("supplier"),
                          F.col("`Amount incl. GST`").alias("amount"), F.col("Excel row").cast("string").alias("place")))


@query
def ledger_quarantine(s, d):
    """A csv copy of the ledger with amounts and dates that are none and lost row numbers."""
    raw, r = derived(s, d, "ledger_raw"), F.col("row_no") % 89
    path = f"{shared_folder(s)}/csv/{uuid.uuid4().hex}"
    damaged = raw.withColumns({
        "total_cost": F.when(r == 5, "n/a").otherwise(F.col("total_cost").cast("string")),
        "invoice_date": F.when(r == 7, "31.31.2026").otherwise(F.col("invoice_date").cast("string")),
        "row_no": F.when(r != 9, F.col("row_no").cast("string"))})
    damaged.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    good, broken = tables.read_ledger_checked(s, path)
    return good.groupBy(F.lit("good").alias("part")).agg(
        F.count("*").alias("n"), F.sum("row_no").alias("rows_sum"), F.sum("total_cost").alias("total"),
        F.countDistinct("invoice_number").alias("n_numbers"), F.count("invoice_date").alias("n_dates")).unionByName(
        broken.groupBy(F.col("reason").alias("part")).agg(F.count("*").alias("n")), allowMissingColumns=True)


@query
def file_kinds(s, d):
    names = derived(s, d, "invoice").select(F.explode(F.array(
        F.col("source_file"), F.upper("source_file"), F.regexp_replace("source_file", r"pdf$", "xlsx"),
        F.regexp_replace("source_file", r"\.pdf$", ".XLSM"), F.regexp_replace("source_file", r"\.pdf$", "_pdf"))).alias("path"))
    return names.groupBy(F.coalesce(file_kind(F.col("path")), F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))
