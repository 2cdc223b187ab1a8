import random
from decimal import Decimal as D

import pytest

from helpers import DAY, by_id, invoice_row, invoices, ledger, ledger_row
from ledgerloom.config import Config
from ledgerloom.operators import matching
from ledgerloom.operators.pairing import pair_nearest
from ledgerloom.plans.cascade import Cascade
from ledgerloom.plans.reconcile import reconcile

CFG = Config()


def run(spark, led, inv, cfg=CFG):
    return Cascade(ledger(spark, led), invoices(spark, inv), cfg)


def test_undated_invoices_get_their_verdict_and_a_flag(spark):
    r = reconcile(ledger(spark, [ledger_row(1, "A-1001", "PO1", 10), ledger_row(2, "A-1002", "PO2", 10)]),
                  invoices(spark, [invoice_row(1, "A-1001", incl=10), invoice_row(2, "A-1002", incl=12),
                                   invoice_row(3, "A-1003", incl=5)]))
    assert by_id(r["documents"], "outcome") == {1: "matched", 2: "discrepancy", 3: "invoice_only"}
    assert all("Invoice date not extracted" in f for f in by_id(r["quality_flags"], "quality_flags").values())


def test_two_receipts_of_one_order_pair_by_amount(spark):
    c = run(spark, [ledger_row(1, None, "PO1", "68.89"), ledger_row(2, None, "PO1", "77.50")],
            [invoice_row(1, None, "PO1", "77.50"), invoice_row(2, None, "PO1", "68.50")])
    assert by_id(c.documents, "outcome", "match_level", "pair_row", "diff") == {
        1: ("matched", "order_pair", 2, D("0.00")), 2: ("discrepancy", "order_pair", 1, D("-0.39"))}


def test_scanned_number_matches_a_single_fold_only(spark):
    led = [ledger_row(1, "INV260123-LBH001", "PO1", 10)]
    inv = [invoice_row(1, "INV260123-LBHOO1", "PO9", 10, ocr=True), invoice_row(2, "INV260123-LBHO01", "PO9", 10)]
    r = reconcile(ledger(spark, led), invoices(spark, inv))
    assert by_id(r["documents"], "match_level") == {1: "folded", 2: None}
    line = r["outcome"].where("doc_id = 1").first()
    assert line.invoice_number == "INV260123-LBH001" and "LBHOO1 -> INV260123-LBH001" in line.note
    two = run(spark, led + [ledger_row(2, "INV260123-LBHO01", "PO2", 10)], inv[:1])
    assert by_id(two.documents, "match_level") == {1: None}


def test_tolerance_is_exact_in_decimals(spark):
    c = run(spark, [ledger_row(1, "A-1001", None, "571.06"), ledger_row(2, "A-1002", None, "571.06")],
            [invoice_row(1, "A-1001", incl="571.11"), invoice_row(2, "A-1002", incl="571.12")])
    assert by_id(c.documents, "outcome") == {1: "matched", 2: "discrepancy"}


def test_batch_remainder_and_claims(spark):
    led = [ledger_row(1, "A-1001", "PO1", 30), ledger_row(2, None, "PO1", 70),
           ledger_row(3, None, "PO2", 40), ledger_row(4, None, "PO2", 60), ledger_row(5, None, "PO2", 1),
           ledger_row(6, "A-1006", "PO3", 9)]
    inv = [invoice_row(1, "A-1001", "PO1", 30), invoice_row(2, None, "PO1", 70),
           invoice_row(3, None, "PO2", 50), invoice_row(4, "X-9999", "PO2", 51),
           invoice_row(5, "A-1006", None, 9), invoice_row(6, None, "PO3", 9), invoice_row(7, None, "PO3", None)]
    c = run(spark, led, inv)
    assert by_id(c.documents, "match_level", "outcome") == {
        1: ("number", "matched"), 2: ("order_rest", "matched"), 3: ("order_batch", "matched"),
        4: ("order_batch", "matched"), 5: ("number", "matched"), 6: ("order_claimed", "matched"),
        7: ("order_claimed", "discrepancy")}


def test_last_duplicate_wins_and_superseded_proformas_leave(spark):
    inv = [invoice_row(1, "A-1001", "PO1", 1), invoice_row(2, "a 1001", "PO1", 2), invoice_row(3, "A-1001", "PO1", 3),
           invoice_row(4, "PI-2001", "PO1", 1, proforma=True), invoice_row(5, "PI-2002", "PO2", 1, proforma=True),
           invoice_row(6, None, "PO1", 1, proforma=True), invoice_row(7, "", "", 1)]
    c = run(spark, [ledger_row(1, "A-1001", "PO1", 3)], inv)
    marks = by_id(c.prepared, "is_duplicate", "is_superseded")
    assert marks == {1: (True, False), 2: (False, False), 3: (False, False), 4: (False, True), 5: (False, False),
                     6: (False, False), 7: (False, False)}


def test_blank_keys_never_meet(spark):
    c = run(spark, [ledger_row(1, None, None, 5), ledger_row(2, "A-1001", None, 5)],
            [invoice_row(1, None, None, 5), invoice_row(2, "", "", 5)])
    assert set(by_id(c.documents, "outcome").values()) == {"invoice_only"}


def greedy(docs, rows):
    left, out = list(rows), {}
    for doc, total in sorted(docs, key=lambda x: x[1]):
        best = min(range(len(left)), key=lambda k: abs(left[k][1] - total))
        out[doc] = left.pop(best)[0]
    return out


def test_pairing_equals_the_greedy_choice_in_sequence(spark):
    rng = random.Random(3)
    docs, rows, want = [], [], {}
    for po in range(60):
        n = rng.randint(1, 12) if po else 400
        amounts = [D(rng.randint(0, 30)) for _ in range(2 * n)]
        d = [(po * 1000 + k, amounts[k]) for k in range(n)]
        r = [(po * 1000 + k, amounts[n + k]) for k in range(n)]
        want |= greedy(d, r)
        docs += [(i, f"PO{po}", t, (False, i)) for i, t in d]
        rows += [(f"PO{po}", i, t) for i, t in r]
    rng.shuffle(docs), rng.shuffle(rows)
    d = spark.createDataFrame(docs, "doc_id bigint, po_key string, total decimal(18,2), pool_order struct<keyless:boolean,place:bigint>")
    r = spark.createDataFrame(rows, "po_key string, row_no bigint, incl decimal(18,2)")
    assert by_id(pair_nearest(d, r), "row_no") == want
    same = r.select("po_key").distinct()
    joined = pair_nearest(d.join(same, "po_key", "left_semi"), r.join(same, "po_key", "left_semi"))
    assert by_id(joined, "row_no") == want


def random_case(seed, n=300):
    """A third of the documents and rows share one order, a third of the numbers are missing."""
    rng = random.Random(seed)
    po = lambda: "PO1" if rng.random() < 1 / 3 else f"PO{rng.randint(2, 40)}" if rng.random() < .9 else None
    num = lambda: None if rng.random() < 1 / 3 else f"A-10{rng.choice('01IO')}{rng.randint(0, 40):02d}"
    led = [ledger_row(i, num(), po(), rng.randint(1, 9), status=rng.choice(["Delivered", "Ordered"])) for i in range(n)]
    inv = [invoice_row(i, num(), po(), rng.choice([None, *range(1, 30)]), ocr=rng.random() < .3,
                       proforma=rng.random() < .1, day=DAY) for i in range(n)]
    return led, inv


@pytest.mark.parametrize("seed", [1, 2])
def test_every_document_and_row_ends_up_somewhere_whatever_the_order(spark, seed):
    led, inv = random_case(seed)
    r = reconcile(ledger(spark, led), invoices(spark, inv))
    docs = by_id(r["documents"], "outcome", "match_level", "ledger_incl")
    gone = {x.doc_id for x in r["prepared"].where("is_duplicate or is_superseded").collect()}
    assert set(docs) | gone == {x[0] for x in inv} and not set(docs) & gone
    lines = r["outcome"].collect()
    used = {x.line_no for x in lines if x.outcome in ("matched", "discrepancy", "ledger_only")}
    pending = {x.row_no for x in r["pending"].collect()}
    assert used | pending == {x[-1] for x in led}
    assert {x.doc_id for x in lines if x.doc_id is not None} == set(docs)

    rng = random.Random(seed)
    rng.shuffle(led), rng.shuffle(inv)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = run(spark, led, inv)
        assert by_id(again.documents, "outcome", "match_level", "ledger_incl") == docs
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_join_of_the_cascade_is_a_product(spark):
    led, inv = random_case(1)
    c = run(spark, led, inv)
    for df in (c.decisions, c.documents, c.unused):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_documents_move_once_for_numbers_and_not_at_all_once_matched(spark):
    """Exact numbers and folds meet the documents in one shuffle; a fold counts for scans without an exact number only."""
    led = ledger(spark, [ledger_row(1, "A-1001", "PO1", 10), ledger_row(2, "B-2002", "PO2", 20), ledger_row(3, "C-3003", "PO3", 30)])
    inv = invoices(spark, [invoice_row(1, "A-1OO1", incl=10, ocr=True), invoice_row(2, "B-2OO2", incl=20),
                           invoice_row(3, "C-3003", incl=30, ocr=True), invoice_row(4, "A-1OO1", incl=10),
                           invoice_row(5, None, "PO2", 20, ocr=True)])
    c = Cascade(led, inv, CFG)
    # document 1 gives way to its later copy 4 and is tagged here on its own
    tagged = matching.match_by_number(matching.prepare(c.narrow), matching.number_totals(c.groups), c.narrow)
    assert by_id(tagged, "number_level", "real_key", "first_corrected_row") == {
        1: ("folded", "A-1001", 1), 2: (None, None, None), 3: ("number", "C-3003", None), 4: (None, None, None),
        5: (None, None, None)}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = matching.match_by_number(c.narrow, matching.number_totals(c.groups), c.narrow)
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning(probe#") == 1
    settled = matching.settle(c.tagged, c.decisions, c.ledger, CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in settled and by_id(c.documents, "outcome")[3] == "matched"
