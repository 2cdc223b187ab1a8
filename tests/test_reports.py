from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from helpers import DAY, invoice_row, invoices, ledger, ledger_row
from ledgerloom.config import Config
from ledgerloom.operators import review
from ledgerloom.operators.ledger import clean_ledger, reconcilable, vendor_aliases, without_keys
from ledgerloom.operators.outcome_lines import OUT_COLS
from ledgerloom.plans.reconcile import reconcile, reconcile_raw
from ledgerloom.sources import publish, schemas, sinks, tables
from helpers import page


def test_aliases(spark):
    rows = [("Acme", "Zed, Foo，Bar/Qux", 1), ("ACME Ltd", "Foo", 2), ("Foo", None, 3), (" ", "Lost", 4), ("Pte Ltd", "Gone", 5)]
    got = {r.alias_key: r.canonical for r in vendor_aliases(spark.createDataFrame(rows, schemas.VENDOR)).collect()}
    assert got == {"ACME": "ACME Ltd", "ZED": "Acme", "FOO": "Foo", "BAR": "Acme", "QUX": "Acme", "GONE": "Pte Ltd"}


def test_clean_ledger(spark):
    rows = [("Delivered", None, "foo", "a 1#", None, D(10), D(3), D("32.70"), "30 days net", DAY, "x", 2),
            (None, "skip", None, None, None, None, None, None, None, None, None, 3),
            ("Ordered", "Other", "foo", None, " ", D(1), D(1), None, None, None, "y", 4)]
    vendors = spark.createDataFrame([("Acme", "Foo", 1)], schemas.VENDOR)
    out = clean_ledger(spark.createDataFrame(rows, schemas.LEDGER_RAW), vendor_aliases(vendors))
    a, b = out.orderBy("row_no").collect()
    assert (a.supplier, a.invoice_key, a.excl, a.gst, a.incl, a.due_date) == ("Acme", "A1", D("30.00"), D("2.70"), D("32.70"), date(2026, 2, 14))
    assert (b.supplier, b.invoice_key, b.po_key, b.gst) == ("Other", None, None, None)
    assert reconcilable(out).count() == without_keys(out).count() == 1
    assert clean_ledger(spark.createDataFrame(rows, schemas.LEDGER_RAW), vendor_aliases(tables.read_vendors(spark, None))).count() == 2


def lines(spark):
    item = ("thing", D(1), D(2), D(2), None, D(2))
    led = [ledger_row(1, "A-1001", "PO1", 10), ledger_row(2, "A-1002", "PO2", 10, day=None), ledger_row(3, "A-1003", "PO3", 7)]
    inv = [invoice_row(1, "A-1001", "PO1", 10, day=DAY), invoice_row(2, "A-1002", "PO2", 12), invoice_row(3, "B-1", "PO9", 2, items=[item, item]),
           invoice_row(4, None, "PO2025", 2), invoice_row(5, None, "PO8", None)]
    return reconcile(ledger(spark, led), invoices(spark, inv))


def test_lines_and_payables(spark):
    r = lines(spark)
    rows = {(x.doc_id, x.line_no): x for x in r["outcome"].collect()}
    assert rows[(3, 0)].description == rows[(3, 1)].description == "thing"
    assert rows[(4, 0)].note == "PO is from 2025 — please check the 2025 ledger; Only the invoice total was extracted, no line items"
    assert rows[(5, 0)].note == "No matching PO or invoice number in the ledger / No line items extracted" and rows[(5, 0)].currency is None
    assert rows[(None, 3)].outcome == "ledger_only"
    assert rows[(2, 2)].note == "Amount mismatch: ledger 10.0 vs invoice 12.0 (diff 2.0)"
    pay = {x.doc_id: (x.invoice_date, x.due_date) for x in review.payables(r["outcome"]).collect()}
    assert pay == {1: ("15/01/2026", "15/01/2026")}
    dates = spark.createDataFrame([(1, DAY, date(2026, 2, 1)), (2, DAY, None), (3, None, None), (4, None, DAY)], "doc_id bigint, invoice_date date, due_date date")
    for c in [c for c in (*OUT_COLS, "line_no") if c not in dates.columns]:
        dates = dates.withColumn(c, F.lit(None).cast("string"))
    got = {x.doc_id: (x.invoice_date, x.due_date) for x in review.payables(dates.withColumn("outcome", F.lit("matched"))).collect()}
    assert got == {1: ("15/01/2026", "01/02/2026"), 2: ("15/01/2026", "15/01/2026"), 3: ("", ""), 4: ("", "15/01/2026")}
    k = review.indicators(r["prepared"], r["outcome"]).first()
    assert tuple(k) == (3, 1, 1, 3, 1)
    shown = review.displayed(r["outcome"]).where("source = 'Excel'").first()
    assert shown.due_date == "" and shown.incl == "7"


def test_overrides_and_sinks(spark, tmp_path):
    out = lines(spark)["outcome"]
    ids = review.with_group_id(out)
    edits = ids.where("doc_id = 2").select("group_id", "line_no", *[
        F.lit("1,012.50").alias(c) if c == "incl" else F.lit("many").alias(c) if c == "unit_no"
        else F.lit("3/2/2026").alias(c) if c == "invoice_date" else F.lit("").alias(c) if c == "due_date"
        else F.col(c).cast("string") for c in OUT_COLS])
    moved = review.apply_overrides(out, edits)
    m = moved.where("from_outcome is not null").collect()
    assert len(m) == 1 and m[0].outcome == "matched" and m[0].incl == D("1012.50") and m[0].invoice_date == date(2026, 2, 3)
    assert m[0].rejected == ["unit_no"] and m[0].quality_flags is not None
    assert m[0].note == "Manually confirmed as matched after review (original auto-match result: Amount mismatch: ledger 10.0 vs invoice 12.0 (diff 2.0))"
    assert moved.count() == out.count()
    sinks.write_outcome(moved, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(OUT_COLS.values()) < set(back.columns) and back.count() == out.count()
    sinks.write_payables(review.payables(moved), str(tmp_path / "pay"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pay")).count() == 2


def test_run_from_raw_tables(spark, tmp_path):
    raw = spark.createDataFrame([("Delivered", "Acme", None, "AC-2026-01", "PO123456789", D(100), D(1), D(109), None, DAY, "x", 2)], schemas.LEDGER_RAW)
    raw.write.parquet(str(tmp_path / "raw"))
    text = "Acme Labs Pte Ltd\nInvoice No: AC-2026-01\nInvoice Date: 14/01/2026\nSubtotal 100.00\nGST 9% 9.00\nTotal SGD 109.00"
    r = reconcile_raw(tables.read_ledger(spark, str(tmp_path / "raw")), tables.read_vendors(spark, None), page(spark, [(1, "PO123456789 (Acme).pdf", text, [])]))
    assert r["documents"].first().outcome == "matched"
    kinds = spark.createDataFrame([("A.XLSX",), ("b.Pdf",), ("c.txt",)], "p string").select(tables.file_kind(F.col("p"))).collect()
    assert [k[0] for k in kinds] == ["ledger", "invoice", None]


def test_runs_are_published_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "pub")
    first, second = spark.range(3).toDF("n"), spark.range(5).toDF("n")
    none = second.where("n < 0").withColumn("a.b c", F.lit("x"))
    with pytest.raises(LookupError):
        publish.read_published(spark, folder, "a")
    assert publish.publish({"a": first, "b": none}, folder, "one")["tables"]["a"]["rows"] == 3
    breaks = second.select(F.raise_error(F.lit("lost")).cast("bigint").alias("n"))
    with pytest.raises(Exception, match="lost"):
        publish.publish({"a": second, "b": breaks}, folder, "two")
    assert publish.read_published(spark, folder, "a").count() == 3
    assert publish.read_published(spark, folder, "b").columns == ["n", "a.b c"]
    publish.publish({"a": second, "b": none}, folder, "two")
    publish.publish({"a": first, "b": none}, folder, "two")
    assert publish.read_published(spark, folder, "a").count() == 5
    assert publish.read_published(spark, folder, "a", "one").count() == 3
    publish.publish({"a": first.withColumn("m", F.lit(1))}, folder, partitions={"a": "n"})
    assert publish.prune(spark, folder, keep=2) == ["one"]
    assert sorted(r.n for r in publish.read_published(spark, folder, "a").collect()) == [0, 1, 2]
    assert publish.read_published(spark, folder, "a", "two").count() == 5
    with pytest.raises(LookupError):
        publish.read_published(spark, folder, "a", "one")


def test_a_run_is_published_with_its_sheets(spark, tmp_path):
    r = lines(spark)
    m = publish.publish_run(r, review.payables(r["outcome"]), str(tmp_path / "run"))
    assert {n: t["rows"] for n, t in m["tables"].items()} == {
        "outcome": r["outcome"].count(), "superseded": r["superseded"].count(), "pending": r["pending"].count(),
        "payables": review.payables(r["outcome"]).count()}
    assert set(publish.read_published(spark, str(tmp_path / "run"), "pending").columns) == set(sinks.PENDING_COLS.values())


def test_broken_source_rows_are_set_aside(spark, tmp_path):
    path = str(tmp_path / "ledger.csv")
    names = [f.name for f in spark.createDataFrame([], schemas.LEDGER_RAW).schema]
    whole = "Delivered,Acme,,INV-1,PO1,1.00,1.00,1.09,,2026-01-14,\"a, b\",1"
    broken = ["Delivered,Acme,,INV-2,PO1,1.00", whole + ",more", whole.replace("1.09", "n/a"), whole.replace("-14", "-99")]
    lost = whole[:-1]
    open(path, "w").write("\n".join([",".join(names), whole, *broken, lost, ",,,,,,,,,,,2"]) + "\n")
    good, bad = tables.read_ledger_checked(spark, path)
    assert sorted((x.row_no, x.item_description, x.total_cost) for x in good.collect()) == [(1, "a, b", D("1.09")), (2, None, None)]
    rows = bad.collect()
    assert sorted(x.record for x in rows if x.reason == "unreadable") == sorted(broken)
    assert [x.reason for x in rows if x.reason != "unreadable"] == ["no row_no"] and all("ledger.csv" in x.source for x in rows)
    tables.quarantine(bad, str(tmp_path / "set_aside"))
    tables.quarantine(bad, str(tmp_path / "set_aside"))
    assert spark.read.parquet(str(tmp_path / "set_aside")).count() == 10
    answers = str(tmp_path / "answers.json")
    open(answers, "w").write('{"doc_id": 1, "response": "{}"}\n{"doc_id": "x", "response": "{}"}\n{"doc_id": 2, "resp\n{"response": ""}\n')
    good, bad = tables.read_second_reader_checked(spark, answers)
    assert [x.doc_id for x in good.collect()] == [1]
    assert sorted(x.reason for x in bad.collect()) == ["no doc_id", "unreadable", "unreadable"]
    spark.createDataFrame([("Acme", "A", 1), (None, "B", 2)], schemas.VENDOR).write.parquet(str(tmp_path / "vendor"))
    good, bad = tables.read_vendors_checked(spark, str(tmp_path / "vendor"), "parquet")
    assert good.count() == 1 and bad.first().record == '{"brands":"B","row_no":2}'


def test_stored_tables_go_when_released(spark, tmp_path):
    import os
    from ledgerloom.sources import scratch
    kept = list(scratch._STORED)
    scratch._STORED.clear()
    stored = scratch.written(spark.range(3).toDF("n"), "n")
    folder = scratch._STORED[0]
    assert stored.count() == 3 and os.path.isdir(folder.removeprefix("file:"))
    scratch.release(spark)
    assert not os.path.exists(folder.removeprefix("file:")) and not scratch._STORED
    scratch._STORED.extend(kept)
