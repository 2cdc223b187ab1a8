"""Derived tables against the statements that make them."""

import os

import pytest

from checks.queries import QUERIES
from ledgerloom.sources import derived as D

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_invoices_are_a_view_with_the_rows_of_the_statement(spark):
    base = D.derived(spark, DATA, "invoice_base")
    got = D.derived(spark, DATA, "invoice")
    assert got.inputFiles() == base.inputFiles()
    cols = ["ok", "iseq", "doc_id", "po_no", "supplier", "invoice_date", "due_date", "invoice_no", "ocr", "is_proforma"]
    want = spark.sql(D.INVOICE_HEAD, invoice_base=base)
    got = got.select(*cols, "subtotal.amount_excl", "subtotal.amount_incl")
    want = want.select(*cols, "excl", "incl")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_tables_are_read_once(spark):
    """No filter repeats the reading of the tables, and empty rows are dropped once a table, not once an entry."""
    got = QUERIES["table_kv"](spark, DATA)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(") == 1
    assert not got.isEmpty()
