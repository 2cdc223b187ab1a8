import random

import numpy as np
import pytest

from ledgerloom.llm import vector_graph as x
from tests.llm.helpers import roots

DDL = "vec_id long, embedding array<float>, label int"


def expected(rows, least):
    unit = []
    for v in rows:
        ok = v and all(c is not None and np.isfinite(c) for c in v)
        v = np.array(v if ok else [0.0] * 8, np.float32).astype(float)
        n = np.linalg.norm(v)
        unit.append(v / n if n else v)
    near = np.array(unit) @ np.array(unit).T
    links = [(a, b) for a in range(len(rows)) for b in range(a) if near[a, b] >= least]
    low, count = roots(len(rows), links), [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {i: (count[i], low[i], low[i] == i) for i in range(len(rows))}


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def vectors(seed, groups=30):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        c = rng.normal(size=8)
        rows += [(c + rng.normal(size=8) * rng.choice([0.05, 0.2])).astype(np.float32).tolist()
                 for _ in range(int(rng.choice([1, 2, 40])))]
    rows += [rows[0], rows[0], None, [0.0] * 8, [float("nan")] * 8, [None] * 8, [float("inf")] * 8,
             [1e-30] * 8, [3e-30] * 8, [2e30] * 8, []]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [10_000, 60])
def test_recall_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(x, "SHARD_NODES", shard)
    rows = vectors(1)
    got = result(x.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], DDL)))
    want = expected(rows, 0.9)
    assert got.keys() == want.keys()
    true = sum(v[0] for v in want.values())
    assert sum(got[i][0] for i in got) >= 0.9 * true and all(got[i][0] <= want[i][0] for i in got)
    if shard == 10_000:
        assert got == want


def test_range_search_finds_dense_groups():
    rng = np.random.default_rng(3)
    c = rng.normal(size=32)
    v = np.concatenate([c + rng.normal(size=(250, 32)) * 0.02, rng.normal(size=(700, 32))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    hits = x.range_search(v, x.build_graph(v), v, 0, 0.9, members=len(v))
    assert min(len(h) for h in hits[:250]) >= 240


def test_no_rows_one_row_and_extra_columns(spark):
    assert x.near_duplicates(spark.createDataFrame([], DDL)).count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0], 0)], DDL).selectExpr("*", "'a' as node", "1 as v")
    assert result(x.near_duplicates(one)) == {5: (0, 5, True)}
    assert result(x.near_duplicates(spark.createDataFrame([(5, None, 0), (6, None, 0)], DDL))) == {
        5: (0, 5, True), 6: (0, 6, True)}


@pytest.mark.parametrize("block", [10_000, 50])
def test_all_pairs_are_compared_where_the_graph_finds_too_few(spark, monkeypatch, block):
    monkeypatch.setattr(x, "SHARD_NODES", 60)
    monkeypatch.setattr(x, "EXACT_BLOCK", block)
    node_links = x.node_links
    monkeypatch.setattr(x, "node_links", lambda *how: node_links(*how).where("a % 2 = 0"))
    rows = vectors(4)
    got = result(x.near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], DDL)))
    assert got == expected(rows, 0.9)


def test_the_audit_sees_isolated_pairs_beside_a_dense_group(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=32)
    dense = [c + rng.normal(size=32) * 0.01 for _ in range(60)]
    lone = [v for _ in range(10) for v in [rng.normal(size=32)] * 1 for v in (v, v + rng.normal(size=32) * 0.01)]
    unit = [(v / np.linalg.norm(v)).tolist() for v in dense + lone]
    nodes = spark.createDataFrame(list(enumerate(unit)), "node long, v array<double>")
    links = spark.createDataFrame([(a, b) for b in range(60) for a in range(b)], "a long, b long")
    assert x.audit_recall(nodes, links, 80, 0.9, 32) < 0.9
