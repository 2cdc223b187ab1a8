"""Reports over outcome rows and manual corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.keys import blank_to_null
from ledgerloom.functions.values import day_text, edited_date, edited_number
from ledgerloom.operators.islands import number_runs
from ledgerloom.operators.outcome_lines import MONEY_COLS, OUT_COLS

# Notes of manually moved rows, by where they came from.
MOVED = {
    "discrepancy": ("Manually confirmed as matched after review (original auto-match result: ", ")"),
    "invoice_only": ("⚠ Not auto-matched to the ledger — manually added to matched (original note: ", ")"),
    "ledger_only": ("⚠ No matching invoice PDF found for this ledger entry — manually added to matched "
                    "(original note: ", ")"),
}
MOVED_PENDING = "⚠ Originally marked not yet invoiced / goods not received — manually added to matched"
UNRECOGNISED = "(number not recognized)"


def contiguous_groups(lines: DataFrame) -> DataFrame:
    """Runs of adjacent rows with equal number, order and note, in document order within an outcome."""
    return number_runs(lines.withColumn("place", F.coalesce("doc_id", "line_no")), ["outcome"], ["place", "line_no"],
                       F.struct("invoice_number", "po_number", "note")).drop("place")


def flagged_documents(lines: DataFrame) -> DataFrame:
    """One entry per invoice that has quality reasons and a file to look at."""
    label = F.concat_ws(" · ", F.coalesce(blank_to_null(F.col("invoice_number")), F.lit(UNRECOGNISED)),
                        F.coalesce("supplier", F.lit("None")), "source_file")
    return (lines.where("size(quality_flags) > 0 and source_file is not null")
            .select("outcome", label.alias("label"), "doc_id", F.struct("quality_flags", "source_file").alias("entry"))
            .groupBy("outcome", "label").agg(F.min_by("entry", "doc_id").alias("entry"))
            .select("outcome", "label", "entry.quality_flags", "entry.source_file"))


def with_highlight(lines: DataFrame) -> DataFrame:
    return lines.withColumn("flagged", F.coalesce(F.size("quality_flags") > 0, F.lit(False)))


def indicators(prepared: DataFrame, lines: DataFrame) -> DataFrame:
    """The key figures of a run as one row.

    Each figure is an aggregate of its own, so none of them needs the rows in one place; the one-row
    results are put side by side by a final aggregate.
    """
    def named(name: str, count: Column):
        return lambda df: df.agg(count.alias("n")).select(F.lit(name).alias("name"), F.col("n").cast("bigint").alias("n"))

    runs = contiguous_groups(lines.where("outcome in ('discrepancy', 'invoice_only')")).where("starts_run")
    matched = lines.where("outcome = 'matched'").select("invoice_number").distinct()
    parts = [
        named("invoices_read", F.count("*"))(prepared.where(
            "invoice_key is not null and not is_duplicate and not is_superseded")),
        named("matched", F.count("*"))(matched),
        named("amount_mismatch", F.count("*"))(runs.where("outcome = 'discrepancy'")),
        named("no_ledger_match", F.count("*"))(runs.where("outcome = 'invoice_only'")),
        named("no_invoice_found", F.count("*"))(lines.where("outcome = 'ledger_only'")),
    ]
    figures = parts[0]
    for p in parts[1:]:
        figures = figures.unionByName(p)
    names = ["invoices_read", "matched", "amount_mismatch", "no_ledger_match", "no_invoice_found"]
    return figures.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])


CORRECTED = "The ledger's number {} is used in place of {}, which only differs by letters that look alike"


def corrections(tagged: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, new_no): the ledger's printed number of documents matched up to look-alike letters."""
    folded = tagged.where("number_level = 'folded'").select("doc_id", F.col("first_corrected_row").alias("row_no"))
    return folded.join(ledger.select("row_no", F.col("invoice_number").alias("new_no")), "row_no").select("doc_id", "new_no")


def warnings_report(prepared: DataFrame, invoices: DataFrame, corrected: DataFrame) -> DataFrame:
    """Live documents whose reading left warnings or whose number was corrected from the ledger."""
    live = prepared.where("not is_duplicate and not is_superseded").select("doc_id")
    said = invoices.select("doc_id", "invoice_no", "source_file", "warnings").join(live, "doc_id", "left_semi").join(
        corrected, "doc_id", "left")
    changed = F.col("new_no").isNotNull() & ~F.col("new_no").eqNullSafe(F.col("invoice_no"))
    template, rest = CORRECTED.split("{}", 1)
    middle, end = rest.split("{}")
    note = F.when(changed, F.concat(F.lit(template), "new_no", F.lit(middle), F.coalesce("invoice_no", F.lit("")), F.lit(end)))
    notes = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.filter(F.array(note), lambda n: n.isNotNull()))
    return said.select("doc_id", F.coalesce("new_no", "invoice_no", "source_file").alias("document"),
                       notes.alias("notes")).where("size(notes) > 0").select(
        "doc_id", "document", F.array_join("notes", "; ").alias("warnings"))


def payables(lines: DataFrame) -> DataFrame:
    """Matched rows for import, dates as text and never missing where the other date is known."""
    invoice_day, due_day = day_text(F.col("invoice_date")), day_text(F.col("due_date"))
    return lines.where("outcome = 'matched'").select(
        "doc_id", "line_no",
        *[F.coalesce(invoice_day, F.lit("")).alias(c) if c == "invoice_date"
          else F.coalesce(due_day, invoice_day, F.lit("")).alias(c) if c == "due_date" else F.col(c)
          for c in OUT_COLS])


def displayed(lines: DataFrame) -> DataFrame:
    """All outcome columns as text, missing values blank, amounts without zeros at the end."""
    def text(c: str) -> Column:
        shown = F.col(c).cast("string")
        return F.regexp_replace(shown, r"\.?0+$", "") if c in MONEY_COLS else shown

    return lines.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in OUT_COLS])


def group_id(outcome: Column, doc_id: Column, line_no: Column) -> Column:
    """Identity of the rows that move together: an invoice, or one ledger row."""
    return F.concat_ws(":", outcome, F.when(doc_id.isNotNull(), F.lit("doc")).otherwise(F.lit("row")),
                       F.coalesce(doc_id, line_no).cast("string"))


def with_group_id(lines: DataFrame) -> DataFrame:
    return lines.withColumn("group_id", group_id(F.col("outcome"), F.col("doc_id"), F.col("line_no")))


def coerce_edits(edits: DataFrame) -> DataFrame:
    """Typed-in text to typed columns; ``rejected`` names the amounts that are not numbers.

    A date that cannot be read is taken as missing.
    """
    bad = F.filter(F.array(*[F.when(F.coalesce(F.length(F.col(c)) > 0, F.lit(False)) & edited_number(F.col(c)).isNull(),
                                    F.lit(c)) for c in MONEY_COLS]), lambda c: c.isNotNull())
    return edits.withColumn("rejected", bad).withColumns({
        **{c: edited_number(F.col(c)) for c in MONEY_COLS},
        **{c: edited_date(F.col(c)) for c in ("invoice_date", "due_date")}})


def apply_overrides(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Move edited groups to matched, with a note of where they came from; flags and file stay.

    ``edits`` holds text for the outcome columns per (group_id, line_no); rows of a moved group that were
    not edited move as they are.
    """
    base = with_group_id(lines)
    typed = coerce_edits(edits)
    fields = [c for c in OUT_COLS if c not in ("source", "note")]
    moved_ids = edits.select("group_id").distinct()
    origin, note = F.col("outcome"), F.coalesce("note", F.lit(""))
    moved_note = F.coalesce(*[F.when(origin == o, F.concat(F.lit(a), note, F.lit(b))) for o, (a, b) in MOVED.items()],
                            F.lit(MOVED_PENDING))
    new = typed.select("group_id", "line_no", F.lit(True).alias("edited"), "rejected",
                       *[F.col(c).alias(f"new_{c}") for c in fields])
    moved = (base.join(moved_ids, "group_id", "left_semi").join(new, ["group_id", "line_no"], "left")
             .withColumns({**{c: F.when(F.col("edited"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields},
                           "note": moved_note})
             .withColumns({"from_outcome": F.col("outcome"), "outcome": F.lit("matched")})
             .drop("edited", *[f"new_{c}" for c in fields]))
    kept = base.join(moved_ids, "group_id", "left_anti")
    return kept.unionByName(moved, allowMissingColumns=True)
