"""What is stored, how often a ledger row moves, and how many partitions a shuffle begins with."""

import pytest

from helpers import invoice_row, invoices, ledger, ledger_row
from ledgerloom.config import Config
from ledgerloom.operators import outcome_lines
from ledgerloom.plans.cascade import Cascade
from ledgerloom.plans.reconcile import all_lines
from ledgerloom.sources import scratch
from pyspark.sql import functions as F


@pytest.fixture
def clean_settings(spark):
    yield
    for key in (scratch.INITIAL_PARTITIONS, scratch.ADVISORY_BYTES):
        spark.conf.unset(key)
    scratch._SIZED.clear()


def test_a_cut_is_a_compressed_table(spark):
    files = scratch.cut(spark.range(100)).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_shuffles_begin_with_partitions_in_proportion_to_the_input(spark, clean_settings, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small, large = (scratch.written(spark.range(n).withColumn("x", F.rand(1)), "sized") for n in (2000, 20000))
    scratch.size_shuffles([small])
    assert int(spark.conf.get(scratch.INITIAL_PARTITIONS)) == least
    monkeypatch.setattr(scratch, "INPUT_BYTES_PER_PARTITION", 1000)
    scratch.size_shuffles([small])
    few = int(spark.conf.get(scratch.INITIAL_PARTITIONS))
    scratch.size_shuffles([large])
    assert least < few and 5 * few < int(spark.conf.get(scratch.INITIAL_PARTITIONS))


def test_settings_of_others_stay(spark, clean_settings):
    spark.conf.set(scratch.INITIAL_PARTITIONS, "7")
    scratch.size_shuffles([scratch.written(spark.range(10), "sized")])
    assert spark.conf.get(scratch.INITIAL_PARTITIONS) == "7"


def test_links_move_keys_and_rows_without_an_order_keep_their_number(spark):
    led = ledger(spark, [ledger_row(1, "A-100", None, 10), ledger_row(2, "A-100", "PO1", 5),
                         ledger_row(3, None, "PO2", 7), ledger_row(4, "A-400", "PO2", 9)])
    inv = invoices(spark, [invoice_row(1, "A-100", "PO1", 15), invoice_row(2, None, "PO2", 16)])
    c = Cascade(led, inv, Config())
    links = outcome_lines.row_links(c.ledger, c.documents, c.claimed, c.decisions)
    assert links.columns == ["row_no", "group_key"]
    want = {(1, "number:A-100"), (2, "number:A-100"), (3, "free:PO2"), (4, "free:PO2")}
    assert {tuple(r) for r in links.collect()} == want
    full = outcome_lines.ledger_links(c.ledger, c.documents, c.claimed, c.decisions)
    assert {(r.row_no, r.group_key) for r in full.collect()} == want and full.columns == [*led.columns, "group_key"]


def test_outcome_rows_leave_no_other_table_behind(spark):
    led = ledger(spark, [ledger_row(1, "A-100", "PO1", 10), ledger_row(2, "A-200", "PO2", 5), ledger_row(3, None, "PO3", 5)])
    inv = invoices(spark, [invoice_row(1, "A-100", "PO1", 10), invoice_row(2, "B-9", "PO9", 5), invoice_row(3, None, "PO3", 5)])
    c = Cascade(led, inv, Config())
    assert c.documents.count() == 3 and c.decisions.count() == 1
    before = set(scratch.stored())
    rows = all_lines(c, inv, Config())
    assert {(r.outcome, r.doc_id, r.line_no) for r in rows.collect()} == {
        ("matched", 1, 1), ("matched", 3, 3), ("invoice_only", 2, 0), ("ledger_only", None, 2)}
    left = set(scratch.stored()) - before
    assert len(left) == 3 and all(any(folder in f for folder in left) for f in rows.inputFiles())


def test_links_of_far_and_negative_row_numbers(spark):
    numbers = [-1, 0, 63, 64, 127, 128, 1 << 40, (1 << 62) + 5]
    led = ledger(spark, [ledger_row(n, f"A-{i}00", "PO1", 10) for i, n in enumerate(numbers)])
    inv = invoices(spark, [invoice_row(i, f"A-{i}00", "PO1", 10) for i in range(len(numbers))])
    c = Cascade(led, inv, Config())
    links = outcome_lines.ledger_links(c.ledger, c.documents, c.claimed, c.decisions)
    assert {tuple(r) for r in links.select("row_no", "group_key").collect()} == {
        (n, f"number:A-{i}00") for i, n in enumerate(numbers)}
