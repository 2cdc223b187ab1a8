import random
from datetime import date, timedelta
from decimal import Decimal as D
from statistics import median

from helpers import DAY, by_id, invoice_row, invoices, ledger, ledger_row
from ledgerloom.config import Config
from ledgerloom.functions.similarity import score
from ledgerloom.operators.candidates import rank_candidates
from pyspark.sql import functions as F

from ledgerloom.operators.islands import _edges, _in_slices, count_runs, number_runs
from ledgerloom.operators.median import exact_median
from ledgerloom.operators.quality import repair_suggestions
from ledgerloom.operators.similar import similar_names
from ledgerloom.plans.reconcile import reconcile

CFG = Config()


def test_near_names(spark):
    assert score("BIOLAB", "BIOBASIC") == 80.0
    assert score("ABC", "ABC") == 100.0 and score("AGILENT", "AGILENTTECHNOLOGIES") == 100.0


def test_similarity_join_finds_every_pair(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 13))) for _ in range(120)]
    other = []
    for b in base:
        x = list(b)
        for _ in range(rng.randint(0, 3)):
            if rng.random() < .5 and len(x) > 1:
                x.pop(rng.randrange(len(x)))
            else:
                x.insert(rng.randrange(len(x) + 1), rng.choice("ABCDE"))
        other.append("".join(x))
    frame = lambda names: spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {(r.left_name, r.right_name) for r in similar_names(frame(other), frame(base), CFG).collect()}
    assert got == {(a, b) for a in other for b in base if score(a, b) >= 85}


def test_medians_of_a_hot_and_many_small_groups(spark):
    rng = random.Random(5)
    groups = {"hot": [D(rng.randint(-10**9, 10**9)) / 100 for _ in range(3000)]}
    groups |= {f"g{k}": [D(rng.randint(0, 500)) / 100 for _ in range(rng.randint(1, 9))] for k in range(40)}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), (None, D(1))]
    got = exact_median(spark.createDataFrame(rows, "k string, v decimal(18,2)"), "k", "v")
    assert {r.k: (r.n_values, r.median) for r in got.collect()} == {k: (len(v), median(v)) for k, v in groups.items()}


def test_runs_cross_slices(spark):
    """Ids are sparse 64-bit numbers; one summary row per slice and part is stitched."""
    rng = random.Random(2)
    ids = sorted(rng.randrange(-(1 << 63), 1 << 63) for _ in range(400))
    rows, want, starts, last = [], {}, {}, {}
    for i in ids:
        part, key = rng.choice(["x", "y", "y", "y", None]), rng.choice(["a", "b", None])
        rows.append((i, part, key))
        no, prev = last.get(part, (0, "none"))
        starts[i] = prev != key
        no += prev != key
        last[part] = (no, key)
        want[i] = (part, no)
    df = spark.createDataFrame(rows, "i bigint, part string, key string").repartition(3)
    got = number_runs(df, ["part"], ["i"], F.col("key"))
    assert got.columns == ["i", "part", "key", "starts_run", "run_no"]
    got = got.collect()
    assert {r.i: (r.part, r.run_no) for r in got} == want and {r.i: r.starts_run for r in got} == starts
    counts = {r.part: (r.n_items, r.n_runs) for r in count_runs(df, ["part"], ["i"], F.col("key")).collect()}
    assert counts == {p: (sum(v[0] == p for v in want.values()), no) for p, (no, _) in last.items()}
    edges = _edges(_in_slices(df, ["part"], ["i"], F.col("key"), None, None), ["part"])
    assert edges.groupBy("slice", "part").count().where("count > 1").count() == 0 and edges.count() <= 3 * 4


def test_items_that_stand_for_several_rows(spark):
    """Runs of items with keys at both ends equal the runs of the rows they stand for."""
    rng = random.Random(4)
    items, no, prev, want = [], 0, None, {}
    for i in range(120):
        keys = [rng.choice("ab") for _ in range(rng.randint(1, 4))]
        for n, k in enumerate(keys):
            starts = k != prev
            no, prev = no + starts, k
            if n == 0:
                want[i] = (starts, no)
        items.append((i, keys[0], keys[-1], sum(x != y for x, y in zip(keys, keys[1:]))))
    df = spark.createDataFrame(items, "i bigint, f string, l string, n int").withColumn("p", F.lit(1))
    got = number_runs(df, ["p"], ["i"], F.col("f"), F.col("l"), F.col("n")).collect()
    assert {r.i: (r.starts_run, r.run_no) for r in got} == want
    assert count_runs(df, ["p"], ["i"], F.col("f"), F.col("l"), F.col("n")).first().n_runs == no


def test_repairs(spark):
    asked = spark.createDataFrame([("S", "LBHOO1"), ("S", "INV-26"), ("S", "INV"), ("S", "OOOO11")], "supplier_key string, number string")
    nums = ["LBH001", "LBHO01", "INV-26-03283", "INV-26-03284", "INV-26-03285", "INV-26-03286", "000011"]
    numbers = spark.createDataFrame([("S", n) for n in nums] + [("T", "INV-26-1")], "supplier_key string, number string")
    got = {r.number: r.suggestion for r in repair_suggestions(asked, numbers, CFG).collect()}
    assert got == {
        "LBHOO1": "Possible OCR character misread — the ledger has LBH001 / LBHO01",
        "INV-26": "Possibly truncated — the ledger has INV-26-03283 / INV-26-03284 / INV-26-03285..."}


def test_flags_in_order(spark):
    led = [ledger_row(i, f"INV-{1000 + i}", f"PO{i}", 100) for i in range(4)]
    r = reconcile(ledger(spark, led), invoices(spark, [
        invoice_row(1, "INV-1000", "PO0", 2000, ocr=True, excl=1000, gst=1000, supplier="Acme Pte Ltd"),
        invoice_row(2, "INV-1O01", "PO77", None, day=DAY, supplier="Acme"),
        invoice_row(3, "ZZ-7777", "PO2", 100, day=DAY, excl=90, gst=5, supplier=None)]))
    flags = by_id(r["quality_flags"], "quality_flags")
    assert flags[1] == ["Amount 2000.0 is more than 10x off this supplier's median of 100.0", "Invoice date not extracted",
                        "Unusual tax rate: 50.0%", "Scanned document read via OCR — figures need manual review"]
    assert flags[2] == ["Invoice total not extracted", "Invoice number format AAA-9A99 doesn't match this supplier's ledger "
                        "formats (AAA-9999); Possible OCR character misread — the ledger has INV-1001"]
    assert flags[3] == ["excl. GST + GST != incl. GST", "Supplier not extracted"]


def brute_force(docs, groups, sims, k=5):
    out = {}
    for doc, name, day, total in docs:
        rows = []
        for key, sup, d, amt in groups:
            sim = sims.get((name, sup))
            if sim is None:
                continue
            a = 0 if total is None else max(0, 60 - abs(amt - total))
            g = 0 if day is None or d is None else max(0, 30 - abs((day - d).days))
            rows.append((-(float(a + g) + sim * 0.1), key))
        out[doc] = [key for _, key in sorted(rows)[:k]]
    return {d: v for d, v in out.items() if v}


def test_candidates_equal_a_full_ranking(spark):
    rng = random.Random(8)
    names = ["ACMELABS", "ACMELAB", "ZENITHBIO"]
    led, groups = [], []
    for i in range(700):
        sup = names[0] if i % 3 == 0 else rng.choice(names)
        day = None if rng.random() < .1 else DAY + timedelta(days=rng.randint(-60, 60))
        amt = D(rng.choice([rng.randint(0, 40), rng.randint(0, 400)]))
        led.append(ledger_row(i, f"K-{rng.randint(0, 10**6):07d}-{i}", None, amt, supplier=sup, day=day))
        groups.append((led[-1][12], sup, day, amt))
    docs = [(j, rng.choice(names + ["NOBODY", None]), None if rng.random() < .2 else DAY + timedelta(days=rng.randint(-80, 80)),
             None if rng.random() < .2 else D(rng.randint(0, 420))) for j in range(120)]
    sims = {(a, b): score(a, b) for a in names for b in names if score(a, b) >= 85}
    frame = spark.createDataFrame(docs, "doc_id bigint, supplier string, invoice_date date, total decimal(18,2)")
    got = {}
    for r in rank_candidates(frame, ledger(spark, led), CFG).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append(r.invoice_number)
    assert got == brute_force(docs, groups, sims)


def test_median_moves_counts_of_blocks_and_not_every_amount(spark):
    df = spark.createDataFrame([("A", D(f"{v}.25")) for v in (1, 2, 3, 40000, 500000)] + [("B", D("-7.00")), ("B", None)],
                               "k string, v decimal(18,2)")
    m = exact_median(df, "k", "v")
    assert {r["k"]: (r["n_values"], r["median"]) for r in m.collect()} == {"A": (5, D("3.250")), "B": (1, D("-7.000"))}
    assert "_groupingexpression" not in m._jdf.queryExecution().optimizedPlan().toString()  # no group per amount of all rows


def test_days_in_reach_are_those_with_points(spark):
    """Against all pairs: days before 1970, at both ends of a reach, of other suppliers, shared and missing ones."""
    from ledgerloom.operators.candidates import _days_asked
    asked = [(q, s, date(1969, 11, 20) + timedelta(days=q * 17)) for q in range(9) for s in "AB"] + [(99, "A", None)]
    points = [(s, date(1969, 10, 1) + timedelta(days=n * m)) for n in range(60) for s, m in (("A", 4), ("A", 6), ("C", 1))]
    queries = spark.createDataFrame(asked, "q int, supplier_key string, date date").selectExpr(
        "struct(q as name, date, 1 as total) as query", "supplier_key")
    got = _days_asked(queries, spark.createDataFrame(points + [("A", None)], "supplier_key string, ledger_date date"), 29)
    want = {(q, s, day) for q, s, at in asked for t, day in points if s == t and at and abs((day - at).days) <= 29}
    got = [(r.query.name, r.supplier_key, r.ledger_date) for r in got.collect()]
    assert want and sorted(got) == sorted(want)
