"""Nearest-amount pairing of the documents and ledger rows of one order."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.shipping import ship_with_tasks

ship_with_tasks(__name__)

ROW, DOC = 0, 1


class _OrderSweep:
    """Pairs one order's documents while amounts arrive in ascending order.

    A document waits until the next ledger row shows what lies above it, then takes the nearer of that
    row and the closest unused row below; equally near rows go by ledger order. Only unused rows and
    waiting documents are held.
    """

    def __init__(self):
        self.below: list[tuple[Decimal, deque]] = []
        self.waiting: deque = deque()

    def row(self, amount, row_no) -> Iterator[tuple]:
        while self.waiting:
            doc_id, total = self.waiting[0]
            if self.below:
                near, rows = self.below[-1]
                low, high = total - near, amount - total
                if low < high or (low == high and rows[0] < row_no):
                    yield self._take_below()
                    continue
            self.waiting.popleft()
            yield doc_id, row_no, amount
            return
        if self.below and self.below[-1][0] == amount:
            self.below[-1][1].append(row_no)
        else:
            self.below.append((amount, deque([row_no])))

    def doc(self, total, doc_id) -> None:
        self.waiting.append((doc_id, total))

    def finish(self) -> Iterator[tuple]:
        while self.waiting and self.below:
            yield self._take_below()

    def _take_below(self) -> tuple:
        doc_id, _ = self.waiting.popleft()
        amount, rows = self.below[-1]
        row_no = rows.popleft()
        if not rows:
            self.below.pop()
        return doc_id, row_no, amount


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    order, state = None, _OrderSweep()
    for batch in batches:
        out = []
        for po, kind, amount, ident in zip(batch.po_key, batch.kind, batch.amount, batch.ident):
            if po != order:
                out.extend(state.finish())
                order, state = po, _OrderSweep()
            if kind == ROW:
                out.extend(state.row(amount, ident))
            else:
                state.doc(amount, ident)
        yield pd.DataFrame(out, columns=["doc_id", "row_no", "incl"])
    yield pd.DataFrame(list(state.finish()), columns=["doc_id", "row_no", "incl"])


def pair_nearest(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, row_no, incl): documents in ascending total each take the closest row still free.

    The choice of one document depends on all smaller ones, so an order is swept in sequence; it is
    streamed in sorted order by Spark's external sort and never gathered. Rows without an amount are
    farther than any other and come last.
    """
    far = F.lit(Decimal("9999999999999999.99")).cast("decimal(18,2)")
    events = rows.select(
        "po_key", F.coalesce("incl", far).alias("amount"), F.lit(ROW).alias("kind"),
        F.struct(F.lit(False).alias("keyless"), F.col("row_no").alias("place")).alias("ord"),
        F.col("row_no").alias("ident")
    ).unionByName(docs.select(
        "po_key", F.col("total").alias("amount"), F.lit(DOC).alias("kind"),
        F.col("pool_order").alias("ord"), F.col("doc_id").alias("ident")))
    # mapInPandas states no distribution of its own. Hashing the key a second time keeps Spark from taking
    # this shuffle for a repetition of an earlier one and dropping it.
    swept = (events.repartition(F.xxhash64("po_key")).sortWithinPartitions("po_key", "amount", "kind", "ord")
             .select("po_key", "kind", "amount", "ident")
             .mapInPandas(_sweep, "doc_id bigint, row_no bigint, incl decimal(18,2)"))
    return swept.withColumn("incl", F.nullif(F.col("incl"), far))
