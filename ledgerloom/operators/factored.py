"""Reports over the factored result: documents, ledger groups and links, without listing documents times rows.

An order with m documents and n rows takes m + n rows here. A group enters a report as its size, its distinct
suppliers or the runs of its order numbers; only the sheets themselves (``expanded``) list every pair.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import Config
from ledgerloom.functions.keys import blank_to_null
from ledgerloom.operators import outcome_lines as lines
from ledgerloom.operators.islands import count_runs, number_runs
from ledgerloom.operators.review import UNRECOGNISED, payables
from ledgerloom.sources.scratch import written


def _key(number: Column, po: Column, note: Column) -> Column:
    return F.struct(number.alias("number"), po.alias("po"), note.alias("note"))


class Factored:
    """What the reports of one run read; each table is stored when first asked for."""

    def __init__(self, documents: DataFrame, links: DataFrame, unused: DataFrame, invoices: DataFrame, cfg: Config,
                 flags: DataFrame | None = None):
        self.documents, self.invoices, self.cfg, self.flags = documents, invoices, cfg, flags
        self.links = links
        self.ledger_only = unused.where("outcome = 'ledger_only'")

    @cached_property
    def groups(self) -> DataFrame:
        """Per ledger group: rows, runs of its order numbers in row order, and the first and last of these."""
        runs = count_runs(self.links.select("group_key", "row_no", "po_number"), ["group_key"], ["row_no"], F.col("po_number"))
        return written(runs.select(
            F.col("group_key"), F.col("n_items").alias("n_rows"), "n_runs", F.col("first_key").alias("first_po"),
            F.col("last_key").alias("last_po")), "groups")

    @cached_property
    def both(self) -> DataFrame:
        """Documents with a ledger side, with the size and runs of their group; groups without rows list nothing."""
        heads = lines.merged_heads(self.documents, self.links, self.invoices, self.cfg)
        return written(heads.join(self.groups, "group_key"), "both")

    @cached_property
    def alone(self) -> DataFrame:
        """Invoices without a ledger side."""
        return written(lines.alone_heads(self.documents.where("outcome = 'invoice_only'"), self.invoices, self.cfg), "alone")

    def items(self) -> DataFrame:
        """Documents as run items: the keys of their first and last line, the changes between, and the number of lines."""
        own = F.col("head_po").isNotNull()
        key = lambda po: _key(F.col("invoice_number"), F.coalesce(F.col("head_po"), F.col(po)), F.col("note"))
        both = self.both.select(
            "outcome", "doc_id", "group_key", own.alias("own_po"), F.col("n_rows").alias("n_lines"), key("first_po").alias("first"),
            key("last_po").alias("last"), F.when(own, 0).otherwise(F.col("n_runs") - 1).alias("inner"))
        one = _key(F.col("invoice_number"), F.col("po_number"), F.col("note"))
        alone = self.alone.select("outcome", "doc_id", F.lit(None).cast("string").alias("group_key"), F.lit(True).alias("own_po"),
                                  "n_lines", one.alias("first"), one.alias("last"), F.lit(0).alias("inner"))
        return both.unionByName(alone)

    def indicators(self, prepared: DataFrame) -> DataFrame:
        """The key figures of a run as one row, each from an aggregate of its own."""
        def named(name: str, df: DataFrame, n: Column) -> DataFrame:
            return df.agg(n.alias("n")).select(F.lit(name).alias("name"), F.col("n").cast("bigint").alias("n"))

        runs = count_runs(self.items().where("outcome <> 'matched'"), ["outcome"], ["doc_id"], F.col("first"), F.col("last"),
                          F.col("inner"))
        runs = written(runs.select("outcome", "n_runs"), "runs")
        of = lambda outcome: F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("n_runs"))), F.lit(0))
        read = prepared.where("invoice_key is not null and not is_duplicate and not is_superseded")
        parts = [named("invoices_read", read, F.count("*")),
                 named("matched", self.both.where("outcome = 'matched'").select("invoice_number").distinct(), F.count("*")),
                 named("amount_mismatch", runs, of("discrepancy")), named("no_ledger_match", runs, of("invoice_only")),
                 named("no_invoice_found", self.ledger_only, F.count("*"))]
        figures = parts[0]
        for p in parts[1:]:
            figures = figures.unionByName(p)
        names = ["invoices_read", "matched", "amount_mismatch", "no_ledger_match", "no_invoice_found"]
        return figures.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])

    def runs(self) -> DataFrame:
        """Every run of the sheets as one row: outcome, run_no, n_lines, and where it begins (doc_id, line_no).

        A document whose lines change key inside is cut into the runs of its group; all others join whole.
        """
        numbered = number_runs(self.items(), ["outcome"], ["doc_id"], F.col("first"), F.col("last"), F.col("inner"))
        numbered = written(numbered.select("outcome", "doc_id", "group_key", "own_po", "n_lines", "inner", "starts_run", "run_no"),
                           "numbered")
        whole = numbered.where("inner = 0").join(self._group_first(), "group_key", "left").select(
            "outcome", "run_no", "starts_run", "n_lines", "doc_id", F.coalesce("first_row", F.lit(0)).alias("line_no"))
        cut = numbered.where("inner > 0").join(self._group_runs(), "group_key").select(
            "outcome", (F.col("run_no") + F.col("nth")).alias("run_no"),
            (F.col("starts_run") | (F.col("nth") > 0)).alias("starts_run"), F.col("n_of_run").alias("n_lines"), "doc_id",
            F.col("first_row").alias("line_no"))
        alone = number_runs(self.ledger_only.select("outcome", "row_no", "invoice_number", "po_number"), ["outcome"], ["row_no"],
                            F.struct("invoice_number", "po_number")).select(
            "outcome", "run_no", "starts_run", F.lit(1).cast("bigint").alias("n_lines"), F.lit(None).cast("bigint").alias("doc_id"),
            F.col("row_no").alias("line_no"))
        start = F.struct("doc_id", "line_no")
        return whole.unionByName(cut).unionByName(alone).groupBy("outcome", "run_no").agg(
            F.sum("n_lines").alias("n_lines"), F.min(F.when(F.col("starts_run"), start)).alias("start")).select(
            "outcome", "run_no", "n_lines", "start.doc_id", "start.line_no")

    def _group_first(self) -> DataFrame:
        return self.links.groupBy("group_key").agg(F.min("row_no").alias("first_row"))

    def _group_runs(self) -> DataFrame:
        """(group_key, nth, n_of_run, first_row): the runs of order numbers inside groups, from 0."""
        rows = number_runs(self.links.select("group_key", "row_no", "po_number"), ["group_key"], ["row_no"], F.col("po_number"))
        return rows.groupBy("group_key", (F.col("run_no") - 1).alias("nth")).agg(
            F.count("*").alias("n_of_run"), F.min("row_no").alias("first_row"))

    def line_runs(self) -> DataFrame:
        """(outcome, doc_id, line_no, run_no, starts_run) of every line of the sheets.

        Numbers are found on documents and on groups; listing the lines is the last step, and nothing is sorted after it.
        """
        numbered = written(number_runs(self.items(), ["outcome"], ["doc_id"], F.col("first"), F.col("last"), F.col("inner")).select(
            "outcome", "doc_id", "group_key", "own_po", "n_lines", "starts_run", "run_no"), "numbered")
        rows = number_runs(self.links.select("group_key", "row_no", "po_number"), ["group_key"], ["row_no"], F.col("po_number"))
        rows = rows.join(self._group_first(), "group_key").select(
            "group_key", F.col("row_no").alias("line_no"), (F.col("run_no") - 1).alias("nth"),
            F.col("starts_run").alias("row_starts"), (F.col("row_no") == F.col("first_row")).alias("is_first"))
        varies = ~F.col("own_po")
        both = numbered.where("group_key is not null").join(rows, "group_key").select(
            "outcome", "doc_id", "line_no", (F.col("run_no") + F.when(varies, F.col("nth")).otherwise(F.lit(0))).alias("run_no"),
            F.when(F.col("is_first"), F.col("starts_run")).otherwise(varies & F.col("row_starts")).alias("starts_run"))
        lone = numbered.where("group_key is null").withColumn("line_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_lines") - 1)))
        lone = lone.select("outcome", "doc_id", "line_no", "run_no", (F.col("starts_run") & (F.col("line_no") == 0)).alias("starts_run"))
        led = number_runs(self.ledger_only.select("outcome", "row_no", "invoice_number", "po_number"), ["outcome"], ["row_no"],
                          F.struct("invoice_number", "po_number")).select(
            "outcome", F.lit(None).cast("bigint").alias("doc_id"), F.col("row_no").alias("line_no"), "run_no", "starts_run")
        return both.unionByName(lone).unionByName(led)

    def flagged_documents(self) -> DataFrame:
        """One entry per invoice with quality reasons and a file; suppliers of a group only where the invoice names none."""
        entry = F.struct("quality_flags", "source_file").alias("entry")
        shown = F.coalesce(blank_to_null(F.col("invoice_number")), F.lit(UNRECOGNISED))
        label = F.concat_ws(" · ", shown, F.coalesce("supplier", F.lit("None")), "source_file").alias("label")
        flags = self.flags.where("size(quality_flags) > 0")
        both = self.both.where("source_file is not null").join(flags, "doc_id")
        suppliers = self.links.select("group_key", "supplier").distinct()
        named = both.where("head_supplier is not null").withColumn("supplier", F.col("head_supplier"))
        unnamed = both.where("head_supplier is null").join(suppliers, "group_key")
        alone = self.alone.where("source_file is not null").join(flags, "doc_id")
        out = named.select("outcome", "doc_id", label, entry)
        for more in (unnamed, alone):
            out = out.unionByName(more.select("outcome", "doc_id", label, entry))
        return out.groupBy("outcome", "label").agg(F.min_by("entry", "doc_id").alias("entry")).select(
            "outcome", "label", "entry.quality_flags", "entry.source_file")

    def highlight_counts(self) -> DataFrame:
        """Lines per outcome, flagged or not; a document counts as many as it has."""
        docs = self.both.select("doc_id", "outcome", F.col("n_rows").alias("n")).unionByName(
            self.alone.select("doc_id", "outcome", F.col("n_lines").alias("n")))
        docs = docs.join(self.flags, "doc_id", "left").select(
            "outcome", F.coalesce(F.size("quality_flags") > 0, F.lit(False)).alias("flagged"), "n")
        rows = self.ledger_only.select("outcome", F.lit(False).alias("flagged"), F.lit(1).cast("bigint").alias("n"))
        return docs.unionByName(rows).groupBy("outcome", "flagged").agg(F.sum("n").alias("n"))

    def payables(self) -> DataFrame:
        """Matched rows for import, which list what they list, from matched documents alone."""
        heads = lines.merged_heads(self.documents.where("outcome = 'matched'"), self.links, self.invoices, self.cfg)
        return payables(lines.expanded(heads, self.links))
