import hashlib
import random

import pytest

from ledgerloom.llm import exact_dedup as x
from tests.llm.helpers import documents

TEXTS = ["a", "b", "a", None, "", "long " * 3000, "a", "long " * 3000, "B", "b ", "é", "é"]


def expected(texts):
    keep, size = {}, {}
    for i, t in enumerate(texts):
        keep[t or ""] = i
        size[t or ""] = size.get(t or "", 0) + 1
    return {i: (keep[t or ""], size[t or ""], keep[t or ""] == i, hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in enumerate(texts)}


def result(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("how", [{}, {"key": "42"}, {"key": "length(text) % 3"}, {"bucket_entries": 1}, {"fold_bytes": 1}])
def test_groups_whatever_the_keys_and_buckets(spark, how):
    assert result(x.exact_dedup(documents(spark, TEXTS), **how)) == expected(TEXTS)


def test_many_texts_and_a_hot_one(spark):
    rng = random.Random(1)
    texts = [rng.choice(["hot", f"t{rng.randint(0, 400)}"]) for _ in range(3000)]
    assert result(x.exact_dedup(documents(spark, texts).repartition(7), bucket_entries=2)) == expected(texts)


def test_directory_doubles_and_keeps_every_key():
    d = x.Directory(capacity=2, max_depth=52)
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(500)]
    for k in keys:
        d.add(k, str(k).encode(), k, 1)
    rows = list(d.rows())
    assert d.depth > 5 and len(d.slots) == 1 << d.depth
    assert sorted(r[2] for r in rows) == sorted(set(keys))
    assert all((r[2] & ((1 << r[1]) - 1)) == r[0] for r in rows)


def test_probe_compares_bytes(spark):
    index = x.build_index(documents(spark, TEXTS), key="7")
    new = documents(spark, ["a", "new", None])
    rows = x.keyed(new, "doc_id", "text").drop("key").selectExpr("doc_id", "7L as key", "text")
    hit = rows.join(index.selectExpr("key", "text as t", "keep_id"), "key").where("text = t")
    assert {(r["doc_id"], r["keep_id"]) for r in hit.collect()} == {(0, 6), (2, 4)}
    found = x.probe(new, x.build_index(documents(spark, TEXTS)))
    assert {(r["doc_id"], r["keep_id"]) for r in found.collect()} == {(0, 6), (2, 4)}


def test_empty_and_clashing_columns(spark):
    assert x.exact_dedup(documents(spark, [])).count() == 0
    odd = documents(spark, TEXTS).selectExpr("*", "'x' as keep_id", "'y' as key", "1 as kept")
    assert result(x.exact_dedup(odd)) == expected(TEXTS)
    stay = x.drop_copies(odd)
    assert stay.columns == odd.columns
    assert {r["doc_id"] for r in stay.collect()} == {i for i, v in expected(TEXTS).items() if v[2]}
