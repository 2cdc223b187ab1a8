import random
from itertools import combinations

from pyspark.sql import functions as F

from ledgerloom.llm import packing as x
from tests.llm.helpers import documents, prose


def padding(lengths, counts, ends):
    return sum(n * (min(e for e in ends if e >= v) - v) for v, n in zip(lengths, counts))


def test_boundaries_are_the_best_of_all(spark):
    rng = random.Random(1)
    for _ in range(40):
        lengths = sorted(rng.sample(range(0, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]
        k = rng.randint(1, 4)
        ends = x.best_boundaries(lengths, counts, k)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(k)
                   for c in combinations(lengths[:-1], min(m, len(lengths) - 1)))
        assert len(ends) <= k and padding(lengths, counts, ends) == best
    assert x.best_boundaries([], [], 3) == []


def test_batches_hold_every_document_within_the_budget(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 5, 7, 30, 31, 300])) for _ in range(300)] + [None, "", " ", prose(rng, 5000)]
    got = x.pack(documents(spark, texts).selectExpr("*", "1 as boundary"), buckets=4, token_budget=200, slice_rows=50).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    batches = {}
    for r in got:
        assert r["n_tokens"] == len((texts[r["doc_id"]] or "").split()) <= r["boundary"] or r["boundary"] == 0
        batches.setdefault(r["batch_id"], []).append(r)
    for rows in batches.values():
        assert len({r["boundary"] for r in rows}) == 1
        assert len(rows) == 1 or len(rows) * rows[0]["boundary"] <= 200
        assert sorted(r["place"] for r in rows) == list(range(len(rows)))
    assert len({r["boundary"] for r in got}) <= 4


def test_long_lengths_share_cells_and_no_rows(spark):
    cells = spark.range(1, 2_000_000, 997).select("id", x.cell_of(F.col("id")).alias("c"))
    worst = cells.select(F.min(F.col("c") - F.col("id")), F.max((F.col("c") - F.col("id")) / F.col("id")),
                         F.countDistinct("c")).first()
    assert worst[0] >= 0 and worst[1] <= 1 / 64 and worst[2] < 2048 + 64 * 12
    assert x.pack(documents(spark, [])).count() == 0
