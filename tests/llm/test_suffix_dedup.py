import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import suffix_dedup as x
from tests.llm.helpers import documents, prose


def naive(texts, length):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        flags = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if n[r[i:i + length]] > 1:
                flags[i:i + length] = True
        out.append((len(r), [(a, a + k) for a, k in x.runs(flags)], bytes(b for b, f in zip(r, flags) if not f)))
    return out


def texts(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 30) + " é日 " + prose(rng, 30) for _ in range(3)]
    out = [None, "", "short", "a" * 70, "a" * 700, "ab" * 200, "日" * 100]
    for _ in range(40):
        out.append(" ".join(rng.choice([prose(rng, rng.randint(0, 40)), rng.choice(shared)[rng.randint(0, 60):]])
                            for _ in range(rng.randint(1, 4))))
    return out + out[10:14]


@pytest.mark.parametrize("seed,hot", [(1, 16_000), (2, 2)])
def test_same_spans_as_counting_all_strings(spark, seed, hot):
    rows = texts(seed)
    got = {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"]))
           for r in x.remove_repeats(documents(spark, rows), 64, hot_contexts=hot, shard_bytes=3000).collect()}
    assert [got[i] for i in range(len(rows))] == naive(rows, 64)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(5)
    for _ in range(150):
        t = np.array([rng.randint(1, rng.choice([2, 3, 60])) for _ in range(rng.randint(1, 60))] + [0], np.uint16)
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert x.suffix_array(t).tolist() == order
        before, common = x.permuted_prefixes(t, np.array(order))
        for i, j in zip(order[1:], order):
            k = 0
            while max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                k += 1
            assert (before[i], common[i]) == (j, k)


def test_whole_documents_keep_their_columns(spark):
    assert x.remove_repeats(documents(spark, [])).count() == 0
    passage = "日本" * 40
    odd = documents(spark, [f"x{passage}y", f"z{passage}w", None, "q"]).selectExpr("*", "'k' as kept", "3 as found")
    got = x.cut_repeats(odd)
    assert got.columns == odd.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: "xy", 1: "zw", 2: None, 3: "q"}
