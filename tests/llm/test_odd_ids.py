"""Null ids, repeated rows, one id with two texts, very long texts and clashing names: every row counts as a document."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import exact_dedup, ngram_join, suffix_dedup, vector_graph, warc
from tests.llm.helpers import prose, roots, shingles

RNG = random.Random(21)
BASE = prose(RNG, 120)
NEAR = BASE + " one word more"
LONG = prose(RNG, 60_000)
ROWS = [(None, BASE), (None, BASE), (None, NEAR), (4, BASE), (4, BASE), (4, NEAR), (4, "something else " * 3), (2, NEAR),
        (9, None), (9, ""), (None, None), (7, LONG), (8, LONG + " end"), (8, prose(RNG, 50)), (None, "alone and without an id")]


def docs(spark, rows=ROWS):
    """Documents with columns named like those the operators add for themselves."""
    full = [(i, t, "en", "src", None if t is None else len(t), n, n) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _id long, key long"
                                 ).withColumns({"_found": F.lit("f"), "of": F.lit("o"), "stays": F.lit(5), "id": F.lit(1)})


def low(i):
    return (i is None, i or 0)


def test_exact_dedup(spark):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    want = Counter((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    out = exact_dedup.exact_dedup(docs(spark)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert Counter(r.text_sha256 for r in out if r.kept) == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    kept = exact_dedup.drop_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    assert Counter((r.doc_id, r.text or "") for r in kept.collect()) == Counter((best[t], t) for t in groups)


@pytest.mark.parametrize("n, percent", [(5, 80), (2, 50)])
def test_ngram_join(spark, n, percent):
    sets = [shingles(t, n) for _, t in ROWS]
    links = [(a, b) for a in range(len(ROWS)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low_of = roots(len(ROWS), links)
    name = {r: min((ROWS[k][0] for k in range(len(ROWS)) if low_of[k] == r), key=low) for r in set(low_of)}
    want = Counter((i, len(sets[k]), name[low_of[k]]) for k, (i, _) in enumerate(ROWS))
    got = ngram_join.similar_groups(docs(spark), n=n, percent=percent).collect()
    assert Counter(tuple(r) for r in got) == want
    kept = ngram_join.keep_one(docs(spark), n=n, percent=percent)
    assert kept.columns == docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(name[r] for r in set(low_of))


def test_suffix_dedup(spark):
    def gone(k, length=200):
        raw = (ROWS[k][1] or "").encode()
        hit = [sum(count[raw[p:p + length]] for _ in [0]) > 1 for p in range(max(0, len(raw) - length + 1))]
        cover, until = bytearray(len(raw)), 0
        for p, h in enumerate(hit):
            if h:
                for q in range(max(p, until), p + length):
                    cover[q] = 1
                until = p + length
        return bytes(b for b, c in zip(raw, cover) if not c)

    count = Counter()
    for _, t in ROWS:
        raw = (t or "").encode()
        count.update(raw[p:p + 200] for p in range(max(0, len(raw) - 199)))
    left = [gone(k) for k in range(len(ROWS))]
    want = Counter((i, len((t or "").encode()), left[k]) for k, (i, t) in enumerate(ROWS))
    got = suffix_dedup.remove_repeats(docs(spark)).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == want
    cut = suffix_dedup.cut_repeats(docs(spark))
    assert cut.columns == docs(spark).columns
    assert Counter((r.doc_id, r._id, r._found, (r.text or "").encode()) for r in cut.collect()) == Counter(
        (i, k, "f", left[k]) for k, (i, _) in enumerate(ROWS))


def test_archives(spark):
    rows = [(i, "http://x", t) for i, t in ROWS] + [(30, None, "<p>" + LONG), (31, "u", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"record": F.lit(1), "payload": F.lit("p"), "digest": F.lit("d"), "key": F.lit(2)})
    got = warc.read_archives(spark, warc.write_archives(pages)).collect()
    by_text = {}
    for i, _, t in rows:
        by_text.setdefault(t or "", []).append(i)
    want = Counter()
    for t, ids in by_text.items():
        ids.sort(key=low)
        digest, size = hashlib.sha256(t.encode()).hexdigest(), len(t.encode())
        for k, i in enumerate(ids):
            again = size >= 100 and k > 0
            want[(i, size, digest, "revisit" if again else "response", ids[0] if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert max(len(r.payload) for r in got if r.payload) > 64 << 10


def test_vectors_of_several_dimensions(spark):
    rng = random.Random(22)
    rows = [(10, [1.0, 0.0]), (11, [1.0, 0.01]), (None, [1.0, 0.02]), (12, [1.0]), (13, [2.0]), (13, [2.0]), (14, [-1.0]),
            (15, None), (15, [0.0, 0.0]), (None, None)]
    rows += [(20 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)] + [(20, [5.0, 5.0, 5.0]), (21, [5.0, 5.0, 5.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1))

    def near(x, y):
        if not x or not y or len(x) != len(y) or not any(x) or not any(y):
            return False
        dot = sum(a * b for a, b in zip(x, y))
        return dot / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 >= 0.9

    links = [(a, b) for a in range(len(rows)) for b in range(a) if near(rows[a][1], rows[b][1])]
    low_of = roots(len(rows), links)
    name = {r: min((rows[k][0] for k in range(len(rows)) if low_of[k] == r), key=low) for r in set(low_of)}
    n = Counter(k for link in links for k in link)
    got = vector_graph.near_duplicates(df).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(
        (i, n[k], name[low_of[k]]) for k, (i, _) in enumerate(rows))
    assert sum(r.kept for r in got) == len(name)


def test_pipeline_stages_keep_odd_rows(spark):
    rows = [(None, BASE), (None, BASE), (4, BASE), (4, NEAR), (5, None), (6, prose(RNG, 80)), (6, prose(RNG, 80)), (7, LONG)]
    d = docs(spark, rows)
    d = d.unionByName(docs(spark, [(100 + k, prose(RNG, 40)) for k in range(30)]))
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, d, "")
        n = out.count()
        assert 30 <= n <= d.count()
        if set(out.columns) == set(d.columns):
            from ledgerloom.sources.scratch import written
            d = written(out, "stage")
    assert d.where("doc_id is null").count() == 0 and d.where("doc_id = 4").count() == 1 and d.where("doc_id = 6").count() == 2
