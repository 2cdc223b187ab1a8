"""Near-duplicate vectors through a flat proximity graph with robust pruning.

1. Vectors are scaled to length 1 in double precision; equal ones become one node with a count.
2. Centroids are fitted on a bounded sample; shards that turn out too large get more centroids from their own members.
   Each node is a member of its ``overlap`` nearest shards and is looked for in its ``probes`` nearest.
3. In every shard a graph is built: of the nearest nodes of a node, those stay that no kept one is much closer to
   (robust pruning), links back are added and pruned again. Each query walks greedily from the shard's medoid with a beam
   and then expands every node within range, a member's own one included, until no new one is in range.
4. The adjacency lists of all shards are united per node. Where a node in range belongs to a shard its finder was not
   looked for in, the finder tries that node's united neighbours, round by round, until none adds a link.
5. Links are verified in double precision. Recall is audited: sampled queries against all nodes, exactly, over all pairs
   and as the mean over the queries; if either is below ``min_recall`` the search is repeated with twice the probes.
   If ``attempts`` searches, or one in all shards, do not pass, all pairs are compared in blocks instead.

Every vector is indexed and every vector is a query; only centroids and audit use samples, of documented size.

Edge cases: null vectors and vectors with null or non-finite components or of length zero link with nothing. Equal vectors
link; every dimension has its own graph, and vectors of different dimensions never link. No rows give no rows. Every row
counts as a vector, also where ids are null or shared: repeated rows link with each other, and a null id comes after all
others, so it names a component only where no row of it has an id. One row of a component is kept.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ArrowMap, components
from ledgerloom.llm.rowkeys import ids_back, keyed_rows
from ledgerloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 8192
SHARD_NODES = 1000
MAX_SHARD = 4000
MAX_CENTROIDS = 4096
AUDIT_QUERIES = 512
DEGREE = 24
POOL = 48
FAR = 16
MIN_POINTED = 8
BEAM = 32
SLACK = 2.4  # on 1 - cosine, so about 1.55 on distances: copies of one vector do not hide each other
QUERY_BLOCK = 256
EXACT_BLOCK = 4000


# --- one shard -----------------------------------------------------------------------------------

def rows_of(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pruned(x: np.ndarray, node: np.ndarray, pool: np.ndarray, near: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Of each node's pool (nearest first, -1 for none), those that no kept one is ``slack`` times closer to."""
    away = np.where(pool >= 0, 1 - near, np.inf)
    vectors = x[np.maximum(pool, 0)]
    between = 1 - np.einsum("nid,njd->nij", vectors, vectors)
    alive, kept = pool >= 0, np.full((len(node), degree), -1, np.int64)
    rows, count = np.arange(len(node)), np.zeros(len(node), np.int64)
    for _ in range(degree):
        first = np.argmax(alive, axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[rows[some], count[some]] = pool[rows[some], first[some]]
        count += some
        alive &= ~(some[:, None] & (slack * between[rows, first] <= away))
        alive[rows, first] = False
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, slack: float = SLACK) -> np.ndarray:
    """Neighbours per node, -1 for none."""
    n = len(x)
    pool = min(pool, n - 1)
    if pool < 1:
        return np.full((n, 1), -1, np.int64)
    out = np.empty((n, degree), np.int64)
    random = np.random.default_rng(n)
    for at in range(0, n, QUERY_BLOCK):
        node = np.arange(at, min(at + QUERY_BLOCK, n))
        near = x[node] @ x.T
        near[np.arange(len(node)), node] = -np.inf
        top = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        # Some far nodes too: without them a dense group would have no way in or out.
        far = random.integers(0, n, (len(node), FAR))
        far[(far == node[:, None]) | (far[:, :, None] == top[:, None, :]).any(axis=2)] = -1
        top = np.concatenate([top, far], axis=1)
        some = np.where(top >= 0, np.take_along_axis(near, np.maximum(top, 0), axis=1), -np.inf)
        order = np.argsort(-some, axis=1, kind="stable")
        out[node] = pruned(x, node, np.take_along_axis(top, order, 1), np.take_along_axis(some, order, 1), degree, slack)
    # Links back, as many as the pool takes, pruned together with the own ones.
    source, target = np.repeat(np.arange(n), degree), out.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, pool), -1, np.int64)
    fits = place < pool
    back[target[fits], place[fits]] = source[fits]
    both = np.concatenate([out, back], axis=1)
    for at in range(0, n, QUERY_BLOCK):
        node = np.arange(at, min(at + QUERY_BLOCK, n))
        ids = np.sort(both[node], axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        near = np.where(ids >= 0, np.einsum("nid,nd->ni", x[np.maximum(ids, 0)], x[node]), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        out[node] = pruned(x, node, np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1), degree, slack)
    return reachable(out)


def reachable(graph: np.ndarray) -> np.ndarray:
    """Give nodes that few others point to (in a dense group, most) links from their own neighbours, in extra places."""
    n, degree = graph.shape
    pointed = np.bincount(graph[graph >= 0], minlength=n)
    extra, load = np.full((n, degree), -1, np.int64), np.zeros(n, np.int64)
    for v in np.flatnonzero(pointed < MIN_POINTED).tolist():
        missing = MIN_POINTED - pointed[v]
        for u in graph[v].tolist():
            if missing and u >= 0 and load[u] < degree and v not in graph[u]:
                extra[u, load[u]] = v
                load[u] += 1
                missing -= 1
    return np.concatenate([graph, extra[:, :load.max(initial=0)]], axis=1)


def range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, medoid: int, least: float,
                 beam: int = BEAM, members: int = 0) -> list[np.ndarray]:
    """Nodes within range of each query: a greedy walk from the medoid, then expansion of all nodes in range.

    The first ``members`` queries are the nodes themselves; their range is expanded from their own node as well.
    """
    found = []
    for at in range(0, len(queries), QUERY_BLOCK):
        q = queries[at:at + QUERY_BLOCK]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(x)), bool)
        score = np.full((len(q), len(x)), -2.0)
        seen[:, medoid] = True
        score[:, medoid] = q @ x[medoid]
        ids = np.full((len(q), beam), -1, np.int64)
        near = np.full((len(q), beam), -np.inf)
        done = np.ones((len(q), beam), bool)
        ids[:, 0], near[:, 0], done[:, 0] = medoid, score[:, medoid], False
        while not done.all():
            live = np.flatnonzero(~done.all(axis=1))
            pick = np.argmax(np.where(done[live], -np.inf, near[live]), axis=1)
            done[live, pick] = True
            next_ = graph[ids[live, pick]]
            fresh = (next_ >= 0) & ~seen[live[:, None], np.maximum(next_, 0)]
            r, c = np.nonzero(fresh)
            node = next_[r, c]
            seen[live[r], node] = True
            value = np.einsum("nd,nd->n", x[node], q[live[r]])
            score[live[r], node] = value
            new = np.full(next_.shape, -np.inf)
            new[r, c] = value
            all_near = np.concatenate([near[live], new], axis=1)
            all_ids = np.concatenate([ids[live], next_], axis=1)
            all_done = np.concatenate([done[live], np.isneginf(new)], axis=1)
            top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
            near[live], ids[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_near, all_ids, all_done))
            done[live] |= np.isneginf(near[live])
        own = rows[at + rows < members]
        seen[own, at + own] = True
        score[own, at + own] = 1.0
        expanded = np.zeros_like(seen)
        while True:
            r, node = np.nonzero((score >= least) & ~expanded)
            if not len(r):
                break
            expanded[r, node] = True
            next_ = graph[node]
            owner = np.repeat(r, next_.shape[1])
            next_ = next_.ravel()
            ok = next_ >= 0
            owner, next_ = owner[ok], next_[ok]
            ok = ~seen[owner, next_]
            pair = np.unique(owner[ok] * len(x) + next_[ok])
            owner, next_ = pair // len(x), pair % len(x)
            seen[owner, next_] = True
            for part in range(0, len(owner), 100_000):
                o, m = owner[part:part + 100_000], next_[part:part + 100_000]
                score[o, m] = np.einsum("nd,nd->n", x[m], q[o])
        found += [np.flatnonzero(score[i] >= least) for i in rows]
    return found


FOUND_DDL = "shard int, node long, neighbours array<long>, hits array<long>"


def search_shard(least: float, dim: int):
    """Build the graph of a shard's members and look for all its queries, members first."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("member", "descending"), ("node", "ascending")])
        node, x = t["node"].to_numpy(), rows_of(t["v"], dim)
        members = int(t["member"].to_numpy().sum())
        shard = t["shard"].to_pylist()
        if not members:
            return pa.table({"shard": [], "node": [], "neighbours": [], "hits": []}, schema=SCHEMA)
        own = x[:members]
        graph = build_graph(own)
        medoid = int(np.argmax(own @ own.mean(axis=0)))
        hits = range_search(own, graph, x, medoid, least - 1e-9, members=members)
        near = [node[g[g >= 0]].tolist() for g in graph] + [None] * (len(node) - members)
        return pa.table({"shard": shard, "node": node, "neighbours": near,
                         "hits": [node[h][node[h] != i].tolist() for i, h in zip(node, hits)]}, schema=SCHEMA)

    return run


SCHEMA = pa.schema([("shard", pa.int32()), ("node", pa.int64()), ("neighbours", pa.list_(pa.int64())),
                    ("hits", pa.list_(pa.int64()))])


# --- plan ----------------------------------------------------------------------------------------

def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (double, length 1) of the usable vectors."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("raw")).where(
        F.col("raw").isNotNull() & (F.size("raw") > 0)
        & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # Scaled by the largest component first, so that squares neither vanish nor overflow.
    rows = rows.withColumn("top", F.array_max(F.transform("raw", lambda x: F.abs(x)))).where("top > 0").select(
        "vec_id", F.transform("raw", lambda x: x / F.col("top")).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("vec_id", F.transform("raw", lambda x: x / F.col("norm")).alias("v"))


def fit(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit vectors: farthest-first would chase outliers, so evenly spaced rows start."""
    k = max(1, min(k, len(sample)))
    centroids = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        centroids[length > 0] = sums[length > 0] / length[length > 0, None]
    return centroids


def sampled(nodes: DataFrame, n: int, want: int, dim: int | None = None, salt: int = 0) -> np.ndarray:
    """About ``want`` node vectors, at most three times as many, chosen by the hash of their id."""
    share = min(1.0, 2 * want / max(1, n))
    rows = nodes.where(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20))).select(
        "node", "v").limit(3 * want).collect()
    rows.sort(key=lambda r: r["node"])
    lengths = [len(r["v"]) for r in rows]
    if not rows:
        return np.empty((0, dim or 0))
    dim = dim or max(sorted(set(lengths)), key=lengths.count)
    return np.array([r["v"] for r in rows if len(r["v"]) == dim][:want]).reshape(-1, dim)


def place(centroids: np.ndarray, overlap: int, probes: int, dim: int) -> ArrowMap:
    """A row per node and shard it is looked for in; the nearest ``overlap`` shards have it as member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = min(probes, len(centroids))
        for batch in batches:
            x = rows_of(batch.column(1), dim)
            score = x @ centroids.T
            top = np.argsort(-score, axis=1, kind="stable")[:, :near]
            row = np.repeat(np.arange(len(x)), near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(top.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near) < overlap, len(x))),
                 batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                ["shard", "member", "node", "v"])

    return run


PLACED_DDL = "shard int, member boolean, node long, v array<double>"


def centroids_of(nodes: DataFrame, n: int, dim: int, overlap: int) -> np.ndarray:
    centroids = fit(sampled(nodes, n, SAMPLE, dim), min(-(-n // SHARD_NODES), MAX_CENTROIDS // 4))
    for round_ in range(3):
        placed = nodes.mapInArrow(place(centroids, overlap, overlap, dim), PLACED_DDL)
        large = placed.groupBy("shard").count().where(F.col("count") > MAX_SHARD).orderBy(F.desc("count")).limit(
            MAX_CENTROIDS).collect()
        room = MAX_CENTROIDS - len(centroids)
        if not large or room < 1:
            break
        ids = [r["shard"] for r in large]
        share = min(1.0, SAMPLE / sum(r["count"] for r in large))
        some = placed.where(F.col("shard").isin(ids) & (F.pmod(F.xxhash64("node", F.lit(round_ + 7)), F.lit(1 << 20))
                                                        < int(share * (1 << 20)))).select("node", "v").limit(
            2 * SAMPLE).collect()
        some = np.array([r["v"] for r in sorted(some, key=lambda r: r["node"])]).reshape(-1, dim)
        if not len(some):
            break
        centroids = np.concatenate([centroids, fit(some, min(room, -(-sum(r["count"] for r in large) // SHARD_NODES)))])
    return centroids


def checked(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose cosine, from the vectors in double precision, is in range."""
    a, b = (nodes.select(F.col("node").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(dot >= least).select("a", "b")


def exact_hits(queries: np.ndarray, ids: np.ndarray, least: float, dim: int) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for at in range(0, len(node), 4096):
                x = rows_of(batch.column(1).slice(at, 4096), dim)
                q, r = np.nonzero(queries @ x.T >= least)
                ok = ids[q] != node[at + r]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[ok]]), pa.array(node[at + r[ok]])], ["x", "y"])

    return run


def audit_recall(nodes: DataFrame, links: DataFrame, n: int, least: float, dim: int, queries: int = AUDIT_QUERIES) -> float:
    """Share of the true links of sampled nodes that are among the links; 1 if they have none.

    The smaller of the share of all pairs and the mean share per node: pairs of dense groups would hide isolated ones.
    """
    share = min(1.0, 2 * queries / max(1, n))
    rows = nodes.where(F.pmod(F.xxhash64("node", F.lit(99)), F.lit(1 << 20)) < int(share * (1 << 20))).select(
        "node", "v").limit(queries).collect()
    if not rows:
        return 1.0
    x, ids = np.array([r["v"] for r in rows]).reshape(-1, dim), np.array([r["node"] for r in rows], np.int64)
    true = nodes.select("node", "v").mapInArrow(exact_hits(x, ids, least, dim), "x long, y long").select(
        "x", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    per_node = true.join(links.withColumn("found", F.lit(1)), ["a", "b"], "left").groupBy("x").agg(
        F.count("*").alias("n"), F.count("found").alias("got"))
    got = per_node.agg(F.sum("n"), F.sum("got"), F.avg(F.col("got") / F.col("n"))).first()
    return min(got[1] / got[0], got[2]) if got[0] else 1.0


def compare_blocks(least: float, dim: int):
    """All pairs in range between the nodes of two blocks, or within one."""

    def run(t: pa.Table) -> pa.Table:
        node, x, block = t["node"].to_numpy(), rows_of(t["v"], dim), t["block"].to_numpy()
        left = block == block.min()
        right = ~left if not left.all() else left
        (na, xa), (nb, xb) = (node[left], x[left]), (node[right], x[right])
        found = []
        for at in range(0, len(na), QUERY_BLOCK):
            q, r = np.nonzero(xa[at:at + QUERY_BLOCK] @ xb.T >= least)
            found.append(np.stack([na[at + q], nb[r]]))
        a, b = np.concatenate(found, axis=1)
        if right is left:
            a, b = a[a < b], b[a < b]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def exact_links(nodes: DataFrame, n: int, dim: int, least: float) -> DataFrame:
    """Links (a, b), a < b, from every pair of nodes: quadratic in the nodes, for when the graph does not suffice."""
    blocks = -(-n // EXACT_BLOCK)
    dealt = nodes.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "v")
    pairs = dealt.groupBy("bi", "bj").applyInArrow(compare_blocks(least - 1e-9, dim), "a long, b long")
    return written(checked(pairs.distinct(), nodes, least), "exact")


def node_links(nodes: DataFrame, n: int, dim: int, least: float, centroids: np.ndarray, overlap: int,
               probes: int) -> DataFrame:
    """Links (a, b), a < b, between nodes."""
    placed = nodes.mapInArrow(place(centroids, overlap, probes, dim), PLACED_DDL)
    found = written(placed.groupBy("shard").applyInArrow(search_shard(least, dim), FOUND_DDL), "found")
    pairs = found.select("node", F.explode("hits").alias("hit")).select(
        F.least("node", "hit").alias("a"), F.greatest("node", "hit").alias("b")).distinct()
    links = written(checked(pairs, nodes, least), "links")
    if len(centroids) <= probes:
        return links
    places = written(found.groupBy("node").agg(
        F.collect_set("shard").alias("probed"),
        F.collect_set(F.when(F.col("neighbours").isNotNull(), F.col("shard"))).alias("shards")), "places")
    united = found.where("neighbours is not null").groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("near"))
    fresh = links
    while True:
        both = fresh.union(fresh.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("x", "u")
        bridges = both.join(places.select(F.col("node").alias("u"), "shards"), "u").join(
            places.select(F.col("node").alias("x"), "probed"), "x").where(
            F.size(F.array_except("shards", "probed")) > 0).select("x", "u", "probed")
        tried = bridges.join(united.withColumnRenamed("node", "u"), "u").select(
            "x", "probed", F.explode("near").alias("y")).where("x <> y").distinct()
        tried = tried.join(places.select(F.col("node").alias("y"), "shards"), "y").where(
            ~F.arrays_overlap("shards", "probed")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        fresh = written(checked(tried.distinct().join(links, ["a", "b"], "left_anti"), nodes, least), "fresh")
        if fresh.limit(1).count() == 0:
            break
        links = links.union(fresh)
    return links


def searched_links(usable: DataFrame, n: int, dim: int, least: float, overlap: int, probes: int, min_recall: float,
                   attempts: int) -> DataFrame:
    """(a, b) of linked nodes of one dimension, by search until the audit is passed, else by comparing all pairs."""
    centroids = centroids_of(usable, n, dim, overlap)
    for _ in range(attempts):
        links = node_links(usable, n, dim, least, centroids, overlap, probes)
        if audit_recall(usable, links, n, least, dim) >= min_recall:
            return links
        if probes >= len(centroids):
            break
        probes *= 2
    return exact_links(usable, n, dim, least)


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                    overlap: int = 2, probes: int = 4, min_recall: float = 0.97, attempts: int = 3) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept."""
    how = {"least": least, "overlap": overlap, "probes": probes, "min_recall": min_recall, "attempts": attempts}
    keyed = keyed_rows(vectors.select(id_col, vector_col), id_col, F.xxhash64(F.col(vector_col).cast("string")))
    if keyed is None:
        return by_id(vectors, id_col, vector_col, **how)
    rows = keyed.select("key", F.col(f"of.`{vector_col}`").alias("embedding"))
    return ids_back(by_id(rows, "key", "embedding", **how), keyed, id_col, "vec_id", "component_id")


def by_id(vectors: DataFrame, id_col: str, vector_col: str, least: float, overlap: int, probes: int, min_recall: float,
          attempts: int) -> DataFrame:
    """``near_duplicates`` where ids are unique and not null."""
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    units = unit_vectors(vectors, id_col, vector_col)
    units = written(units.withColumn("same", F.xxhash64(F.col("v").cast("string"))), "units")
    nodes = written(units.groupBy("same", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("held")), "nodes")
    links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("a < b")
    dims = nodes.groupBy(F.size("v").alias("dim")).count().where("count > 1").orderBy("dim").collect()
    for dim, n in dims:  # vectors of different dimensions have no angle; each dimension has a graph of its own
        usable = nodes.where(F.size("v") == dim).select("node", "v")
        found = searched_links(usable if len(dims) == 1 else written(usable, "usable"), n, dim, least, overlap, probes,
                               min_recall, attempts)
        links = links.union(found.select("a", "b"))
    groups = components(links)
    held = nodes.select("node", "held")
    both = links.union(links.select("b", "a")).toDF("node", "other")
    linked = both.join(held.toDF("other", "n"), "other").groupBy("node").agg(F.sum("n").alias("n"))
    of_node = held.join(linked, "node", "left").join(groups.withColumnRenamed("id", "node"), "node", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("held") - 1).alias("n_links"),
        F.coalesce("component_id", "node").alias("component_id"))
    node_of = units.select("vec_id", "same", "v").join(nodes.select("same", "v", "node"), ["same", "v"]).select("vec_id", "node")
    out = ids.join(node_of.join(of_node, "node"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
