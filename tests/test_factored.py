"""Reports over documents and groups equal those over the listed lines."""

import random
from decimal import Decimal as D

from helpers import invoice_row, invoices, ledger, ledger_row, page
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.operators import outcome_lines, review
from ledgerloom.operators.factored import Factored
from ledgerloom.operators.numbering import numbered
from ledgerloom.plans.cascade import Cascade
from ledgerloom.plans.extraction import extract_invoices
from ledgerloom.plans.reconcile import all_lines

CFG = Config()


def both_forms(spark, led, inv):
    c = Cascade(ledger(spark, led), invoices(spark, inv), CFG)
    flags = c.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("odd"))).otherwise(
        F.array().cast("array<string>")).alias("quality_flags"))
    links = outcome_lines.ledger_links(c.ledger, c.documents, c.claimed, c.decisions)
    return c, Factored(c.documents, links, c.unused, c.invoices, CFG, flags), all_lines(c, c.invoices, CFG, flags).cache()


def same(a, b, *cols):
    pick = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert pick(a) == pick(b) and a.count()


def test_reports_agree_with_the_sheets(spark):
    rng = random.Random(12)
    led, inv, no = [], [], 0
    for po in range(40):
        for _ in range(rng.randint(1, 4)):
            no += 1
            number = rng.choice([None, f"N-{rng.randint(100, 140)}-{po % 7}"])
            led.append(ledger_row(no, number, f"PO{po}", rng.choice([10, 20, None]), supplier=rng.choice(["Acme", "Zed", None])))
    item = ("thing", D(1), D(2), D(2), None, D(2))
    for _ in range(90):
        i = rng.randrange(-(1 << 62), 1 << 62)
        inv.append(invoice_row(i, rng.choice([None, f"N-{rng.randint(100, 150)}-{rng.randint(0, 6)}"]),
                               rng.choice([None, " ", f"PO{rng.randint(0, 55)}"]), rng.choice([10, 20, 30, None]),
                               supplier=rng.choice(["Acme", "", None]), items=[item] * rng.choice([0, 0, 1, 3])))
    c, f, lines = both_forms(spark, led, inv)
    assert f.indicators(c.prepared).first() == review.indicators(c.prepared, lines).first()
    runs = review.contiguous_groups(lines)
    same(f.line_runs(), runs, "outcome", "doc_id", "line_no", "run_no", "starts_run")
    ranges = runs.groupBy("outcome", "run_no").agg(F.count("*").alias("n_lines"), F.max(
        F.when(F.col("starts_run"), F.struct("doc_id", "line_no"))).alias("s")).select("*", "s.doc_id", "s.line_no")
    same(f.runs(), ranges, "outcome", "run_no", "n_lines", "doc_id", "line_no")
    same(f.flagged_documents(), review.flagged_documents(lines), "outcome", "label", "quality_flags", "source_file")
    same(f.highlight_counts(), review.with_highlight(lines).groupBy("outcome", "flagged").agg(F.count("*").alias("n")),
         "outcome", "flagged", "n")
    same(f.payables(), review.payables(lines), "doc_id", "line_no", "note", "po_number", "supplier", "invoice_date", "incl")


def test_one_order_holds_nearly_everything(spark):
    """400 documents and 300 rows of one order: 120,000 lines in the sheets, 700 rows here."""
    led = [ledger_row(n, None, "PO1", 1) for n in range(300)]
    inv = [invoice_row(n * 7919, None, "PO1", 5) for n in range(400)]
    c, f, _ = both_forms(spark, led, inv)
    assert f.both.count() == 400 and f.groups.first().n_rows == 300
    assert tuple(f.indicators(c.prepared).first()) == (0, 0, 1, 0, 0)
    assert tuple(f.runs().first())[:3] == ("discrepancy", 1, 120_000)
    assert {(r.outcome, r.flagged): r.n for r in f.highlight_counts().collect()} == {
        ("discrepancy", True): 134 * 300, ("discrepancy", False): 266 * 300}
    plan = f.indicators(c.prepared)._jdf.queryExecution().optimizedPlan().toString()
    assert "line_no" not in plan


def test_no_documents_or_no_rows(spark):
    c, f, lines = both_forms(spark, [ledger_row(1, "A-1001", "PO1", 1)], [])
    assert tuple(f.indicators(c.prepared).first()) == (0, 0, 0, 0, 1) and f.runs().count() == 1
    c, f, lines = both_forms(spark, [], [invoice_row(1, "A-1001", "PO1", 1)])
    assert tuple(f.indicators(c.prepared).first()) == (1, 0, 0, 1, 0) and f.line_runs().count() == 1


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n"), F.lit("x").alias("slice"), F.lit(1).alias("at"))
    out = numbered(rows.repartition(5), ["n"], "no")
    assert out.columns == ["n", "slice", "at", "no"] and out.where("n <> no").count() == 0
    replaced = numbered(rows.select((-F.col("n")).alias("n")), ["n"], "n")
    assert sorted(r.n for r in replaced.collect()) == list(range(1000))


def test_pairs_of_an_order_read_from_text(spark):
    """Documents without numbers, read from page text, meet the nearest rows of their order; the later file of a number wins."""
    text = "Acme Labs Pte Ltd\nInvoice Date: 14/01/2026\n{}Total SGD {}"
    docs = [(11, "b PO123456789 (Acme).pdf", text.format("", "68.50"), []), (12, "a PO123456789 (Acme).pdf", text.format("", "77.50"), []),
            (21, "z.pdf", text.format("Invoice No: AC-2026-01\n", "10.00"), []), (20, "y.pdf", text.format("Invoice No: AC-2026-01\n", "12.00"), [])]
    led = [ledger_row(1, None, "PO123456789", "68.89"), ledger_row(2, None, "PO123456789", "77.50"),
           ledger_row(3, "AC-2026-01", "PO9", "10.00")]
    c = Cascade(ledger(spark, led), extract_invoices(page(spark, docs), None, None, CFG), CFG)
    assert dict(c.prepared.dtypes)["file_order"] == "bigint"
    got = {r.doc_id: (r.match_level, r.outcome, r.pair_row) for r in c.documents.collect()}
    assert got == {11: ("order_pair", "discrepancy", 1), 12: ("order_pair", "matched", 2), 21: ("number", "matched", None)}


def test_documents_without_correction_do_not_meet_in_one_task(spark):
    """Only corrected documents are looked up by their ledger row; the others must not share a null key."""
    n = 400
    rows = ledger(spark, [ledger_row(i, f"INV-{i}", f"PO{i}", "10.00") for i in range(1, n + 1)])
    inv = invoices(spark, [invoice_row(i, f"INV-{i}", f"PO{i}", "10.00") for i in range(1, n + 1)])
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        c = Cascade(rows, inv, Config())
        links = outcome_lines.ledger_links(c.ledger, c.documents, c.claimed, c.decisions)
        heads = outcome_lines.merged_heads(c.documents, links, inv, Config())
        sizes = [r["count"] for r in heads.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < n / 2
