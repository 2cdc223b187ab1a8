"""The matching plan: which document stands against which part of the ledger."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ledgerloom.config import Config
from ledgerloom.operators import matching
from ledgerloom.operators.ledger import reconcilable
from ledgerloom.operators.numbering import numbered
from ledgerloom.sources.scratch import cut, written


class Cascade:
    """The stages of a run, laid out when first asked for.

    Narrow tables are stored because several later stages read each of them: the documents tagged
    with their number match, the decision per order, and the verdict per document. None holds texts or
    line items, so together they are a small fraction of the invoices.
    """

    def __init__(self, ledger: DataFrame, invoices: DataFrame, cfg: Config):
        self.ledger, self.invoices, self.cfg = reconcilable(ledger), invoices, cfg

    @cached_property
    def narrow(self) -> DataFrame:
        """The columns matching works on, stored.

        An extraction is a long chain, and marking reads it many times. A file order of another kind than a number, such
        as path and document, becomes one here; later steps see a bigint.
        """
        narrow = matching.narrow_invoices(self.invoices)
        if dict(narrow.dtypes)["file_order"] == "bigint":
            return written(narrow, "narrow", compression="zstd")
        return numbered(narrow, ["file_order", "doc_id"], "file_order")

    @cached_property
    def prepared(self) -> DataFrame:
        """Every document, with its duplicate and superseded marks."""
        return matching.prepare(self.narrow)

    @cached_property
    def groups(self) -> DataFrame:
        return matching.ledger_groups(self.ledger)

    @cached_property
    def tagged(self) -> DataFrame:
        """Live documents with the number match, if any."""
        live = self.prepared.where("not is_duplicate and not is_superseded")
        return cut(matching.match_by_number(live, matching.number_totals(self.groups), self.narrow))

    @cached_property
    def claimed(self) -> DataFrame:
        """Ledger numbers claimed by documents."""
        return matching.claimed_keys(self.tagged)

    @cached_property
    def pool(self) -> DataFrame:
        """Orders with documents no number matched."""
        return matching.order_pool(self.tagged)

    @cached_property
    def decisions(self) -> DataFrame:
        """How each such order is settled."""
        rows = matching.order_rows(self.groups, self.claimed)
        return cut(matching.order_decisions(self.pool, rows, self.cfg))

    @cached_property
    def documents(self) -> DataFrame:
        """One verdict per live document."""
        return cut(matching.settle(self.tagged, self.decisions, self.ledger, self.cfg))

    @cached_property
    def unused(self) -> DataFrame:
        """Ledger rows no document used."""
        return matching.unused_rows(self.ledger, self.claimed, self.decisions, self.cfg)
