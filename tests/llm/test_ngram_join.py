import random

import numpy as np
import pytest

from ledgerloom.llm import ngram_join as x
from tests.llm.helpers import documents, prose, roots, shingles


def corpus(seed):
    """Chains of near copies, a passage in many texts, short and odd texts."""
    rng = random.Random(seed)
    common, texts = prose(rng, 60), []
    for _ in range(6):
        words = prose(rng, rng.choice([8, 40, 150])).split()
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(["x", "Y", "zz"])
            texts.append(" ".join(words))
    texts += [f"{prose(rng, rng.randint(5, 200))} {common} {prose(rng, 5)}" for _ in range(25)]
    texts += [None, "", " \n", "one", "ONE", "one two", "one  two", "one two three four", texts[0], texts[0].upper(), "é É"]
    rng.shuffle(texts)
    return texts


def expected(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, roots(len(sets), links)))}


@pytest.mark.parametrize("seed,n,percent,hot,list_to", [(1, 4, 85, 64, 24), (2, 5, 80, 2, 1), (3, 3, 60, 3, 3)])
def test_same_groups_as_all_pairs(spark, monkeypatch, seed, n, percent, hot, list_to):
    monkeypatch.setattr(x, "HOT_FROM", hot)
    monkeypatch.setattr(x, "SALT_ROWS", 3)
    texts = corpus(seed)
    got = x.similar_groups(documents(spark, texts), n, percent, block_rows=4, list_to=list_to)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == expected(texts, n, percent)


def test_spanning_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(4)]
    for i in range(30):
        own = sets[rng.integers(0, len(sets))].copy()
        own[rng.integers(0, len(own), rng.integers(1, 8))] = rng.integers(0, 1 << 63)
        sets.append(np.unique(own))
    n, place = np.array([len(s) for s in sets]), np.ones(len(sets), np.int64)
    label, bits = np.arange(len(sets)) // 2, np.stack([x.sketch(s).view(np.uint64) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    ok = x.allowed(80, a, b, n, place, label, bits)
    same = [(i, j) for i in range(len(sets)) for j in range(i) if label[i] == label[j]]
    forest = x.spanning(80, n, place, label, bits)
    assert 0 < len(forest) < len(set(label.tolist()))
    assert roots(len(sets), same + forest) == roots(len(sets), same + list(zip(a[ok].tolist(), b[ok].tolist())))


def test_empty_table_and_clashing_columns(spark):
    assert x.similar_groups(documents(spark, [])).count() == 0
    odd = documents(spark, ["a b c d e f", "a b c d e f", None, None]).selectExpr("*", "1 as n", "'q' as rep", "2 as component_id")
    stay = x.keep_one(odd)
    assert stay.columns == odd.columns and {r["doc_id"] for r in stay.collect()} == {0, 2, 3}
