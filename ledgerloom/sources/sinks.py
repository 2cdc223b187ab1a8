"""Writers of the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.outcome_lines import OUT_COLS

# Printed column names of the side reports.
SUPERSEDED_COLS = {"invoice_no": "Invoice No", "po_no": "PO", "supplier": "Supplier", "total": "Total",
                   "reason": "Reason Ignored", "source_file": "File"}
PENDING_COLS = {"invoice_number": "Invoice Number", "po_number": "PO Number", "supplier": "Supplier",
                "description": "Description", "unit_no": "Unit no", "incl": "Amount incl. GST",
                "status": "Status", "row_no": "Excel row"}


def _renamed(df: DataFrame, names: dict[str, str], *also: str) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for c, n in names.items()], *also)


def outcome_sheet(lines: DataFrame) -> DataFrame:
    return _renamed(lines, OUT_COLS, "outcome")


def superseded_sheet(report: DataFrame) -> DataFrame:
    return _renamed(report, SUPERSEDED_COLS)


def pending_sheet(report: DataFrame) -> DataFrame:
    return _renamed(report, PENDING_COLS)


def payables_sheet(rows: DataFrame) -> DataFrame:
    return _renamed(rows, OUT_COLS)


def write_outcome(lines: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per outcome, all with the same columns."""
    writer = outcome_sheet(lines).write.partitionBy("outcome")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_superseded(report: DataFrame, path: str) -> None:
    superseded_sheet(report).write.option("header", True).csv(path)


def write_pending(report: DataFrame, path: str) -> None:
    pending_sheet(report).write.option("header", True).csv(path)


def write_payables(rows: DataFrame, path: str) -> None:
    payables_sheet(rows).write.option("header", True).csv(path)
