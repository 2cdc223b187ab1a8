import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import resampling
from tests.llm.helpers import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, max_n):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent, min_words, max_n, seed, n_buckets):
    def counted(texts):
        return Counter(zlib.crc32(f.encode()) % n_buckets for t in texts for f in features(t, max_n))

    s, t = counted([d[1] for d in docs]), counted(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + n_buckets) / ((s[b] + 1.0) * (T + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for i, text in docs:
        fs = features(text, max_n)
        weight = sum(gain[zlib.crc32(f.encode()) % n_buckets] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                     len(words(text)) >= min_words))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    return Counter((*r[:4], k if k <= drawn else None) for k, r in enumerate(able, 1)) + Counter(
        (*r[:4], None) for r in rows if not r[4])


def check(spark, docs, target, percent=10, min_words=20, max_n=1, seed=2024, n_buckets=10_000, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(d, t, percent, min_words, max_n, seed, n_buckets, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(docs, target, percent, min_words, max_n, seed, n_buckets)


def test_against_the_definition(spark):
    rng = random.Random(8)
    docs = [(i * 7 - 900, prose(rng, rng.randint(0, 60)).replace("a", rng.choice(["A", "é", "a-1", "`a"]))) for i in range(300)]
    check(spark, docs, [prose(rng, 30) for _ in range(9)], block_rows=64)
    check(spark, docs[:80], [prose(rng, 30) for _ in range(9)], percent=33, min_words=5, max_n=3, seed=1, n_buckets=97)


def test_ids_of_all_sizes_and_many_digits(spark):
    rng = random.Random(9)
    ids = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(40))]
    check(spark, [(i, "same words " * 10 + prose(rng, 12)) for i in ids], ["same target"], percent=100, block_rows=8)


def test_nulls_ties_and_repeated_rows(spark):
    long = "one two three four five " * 4
    docs = [(None, long), (None, long), (5, long), (5, long), (5, long + "six"), (6, None), (7, ""), (8, "!!"), (9, "word " * 19)]
    check(spark, docs, ["one two", None, ""], percent=100)
    check(spark, docs, [None], percent=60)
    check(spark, [(None, long), (None, None)], ["x"], percent=100)
    check(spark, [], ["x"])
    check(spark, [(1, "too short")], [])


def test_a_very_long_text_and_clashing_names(spark):
    rng = random.Random(10)
    check(spark, [(1, prose(rng, 200_000)), *((i, prose(rng, 25)) for i in range(2, 30))], [prose(rng, 50)])
    docs = spark.createDataFrame([(1, "w " * 25)], "doc_id long, text string").withColumns(
        {n: F.lit("x") for n in ("score", "block", "place", "digit", "rank", "weight")})
    assert resampling.resample(docs, docs, percent=100).first()["rank"] == 1


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_passes_are_stable(spark, block_rows):
    rng = random.Random(11)
    data = [(i, rng.randint(0, 5), i // 10, i) for i in range(200)]
    rows = spark.createDataFrame(data, "n long, v int, block long, place long").repartition(3, "block")
    out = resampling.counting_pass(rows, F.col("v"), block_rows).collect()
    assert [r["n"] for r in sorted(out, key=lambda r: r["place"])] == [r[0] for r in sorted(data, key=lambda r: r[1])]
    assert all(r["block"] == r["place"] // block_rows for r in out)
