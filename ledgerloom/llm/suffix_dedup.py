"""Removal of byte passages that occur more than once, through suffix arrays built by induced sorting.

A string of ``length`` bytes is repeated if it starts at two places of the corpus. Sharding: each such string holds an
anchor, the 32-byte gram with the smallest hash in it, which depends on the string alone. Runs of string starts with one
anchor form a context, the bytes all of them cover; every start lies in exactly one context, and equal strings lie in
contexts with equal anchor grams. So only contexts whose anchor occurs again have to meet, by anchor. Equal contexts are
folded into one with a count, before any text moves.

In a shard (some megabytes of contexts with whole anchor groups) the suffix array is built by induced sorting: suffixes
are classified, leftmost-smaller substrings sorted by inducing, named and ordered recursively, and the array induced in
one pass over the buckets up and one down, each step on whole numpy arrays. Permuted common prefixes are computed from
the irreducible places alone. Starts with a common prefix of ``length`` or more to a neighbour are repeated.

An anchor group beyond ``hot_contexts`` distinct contexts is not sorted in one task: its strings are compared by digest
in an aggregation that combines before it shuffles, which gives the same starts.

Edge cases: null counts as empty; texts shorter than ``length`` lose nothing; overlapping strings count, also within one
document. Every row is a text of its own, also where ids are null or shared, so repeated rows repeat each other's
strings. An empty table gives no rows. Where whole documents are returned, characters that are cut in two go altogether, and other columns stay.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ArrowMap, id_filter, passing, texts_of
from ledgerloom.llm.rowkeys import ids_back, keyed_rows
from ledgerloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
GRAM = 32
SHARD_BYTES = 2 << 20
HOT_CONTEXTS = 16_000
MAP_BYTES = 4 << 20
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


# --- anchors -------------------------------------------------------------------------------------

def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on."""
    n = len(raw) - 7
    eight = np.empty(n, np.uint64)
    for shift in range(8):
        m = (n - shift + 7) // 8
        if m > 0:
            eight[shift::8] = raw[shift:shift + 8 * m].view("<u8")
    m = len(raw) - GRAM + 1
    h = np.zeros(m, np.uint64)
    for i, by in enumerate(MULTIPLIERS):
        h += eight[8 * i:8 * i + m] * by
        h ^= h >> np.uint64(29)
        h *= MULTIPLIERS[0]
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(h)] = h
    blocks = padded.reshape(rows, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1:width - 1 + n])


def last_min(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the last smallest of each ``width`` neighbours."""
    low = sliding_min(h, width)
    n = len(low)
    enters = h[width - 1:] == low
    place = np.where(enters, np.arange(width - 1, width - 1 + n), 0)
    search = np.flatnonzero(~enters & np.concatenate([[True], low[1:] > low[:-1]]))
    for at in range(0, len(search), 4096):
        some = search[at:at + 4096]
        around = h[some[:, None] + np.arange(width)]
        place[some] = some + width - 1 - np.argmin(around[:, ::-1], axis=1)
    return np.maximum.accumulate(place)


def anchors_of(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first start, number of starts, anchor hash) of every context of some texts."""
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return none, none, none, none
    h = gram_hashes(raw)
    anchor = last_min(h, length - GRAM + 1)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(raws)), sizes)[:len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= ends[doc])
    if not len(start):
        return none, none, none, none
    a, d = anchor[start], doc[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]))
    counts = np.diff(np.append(first, len(start)))
    return d[first], start[first] - (ends - sizes)[d[first]], counts, h[a[first]].view(np.int64)


def digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def find_anchors(length: int) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                raws.append(text.as_buffer().to_pybytes())
                held += len(raws[-1])
                if held >= MAP_BYTES:
                    yield rows(ids, raws)
                    ids, raws, held = [], [], 0
            if ids:
                yield rows(ids, raws)

    def rows(ids: list[int], raws: list[bytes]) -> pa.RecordBatch:
        doc, lo, n, h = anchors_of(raws, length)
        c = [digest(raws[d][s:s + k + length - 1]) for d, s, k in zip(doc.tolist(), lo.tolist(), n.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(ids, np.int64)[doc]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)),
             pa.array(h.astype(np.int64)), pa.array(c, pa.int64())], ["doc_id", "lo", "n", "h", "c"])

    return run


# --- suffix arrays -------------------------------------------------------------------------------

def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last, unique smallest sign counts as such."""
    n = len(t)
    differs = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    turn = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = np.empty(n, bool)
    smaller[:-1] = t[turn] < t[np.minimum(turn + 1, n - 1)]
    smaller[-1] = True
    return smaller


def induce(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, n_signs: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in order: larger suffixes upwards, then smaller ones downwards.

    A bucket is walked in waves: what a wave puts into its own bucket is the next wave.
    """
    def deal(places: np.ndarray, wanted: bool, queues: list[list[np.ndarray]], own: int) -> np.ndarray:
        """Queue the predecessors of the wanted type by their sign, in order; those of the own sign come back."""
        before = places[places > 0] - 1
        before = before[smaller[before] == wanted]
        if not len(before):
            return before
        signs = t[before]
        order = np.argsort(signs, kind="stable")
        before, signs = before[order], signs[order]
        cuts = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]])).tolist() + [len(before)]
        mine = before[:0]
        for a, b in zip(cuts, cuts[1:]):
            if signs[a] == own:
                mine = before[a:b]
            else:
                queues[signs[a]].append(before[a:b])
        return mine

    none = np.empty(0, np.int64)
    by_sign = np.argsort(t[leftmost], kind="stable")
    starts = leftmost[by_sign]
    edges = np.searchsorted(t[starts], np.arange(n_signs + 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(n_signs)]
    for sign in range(n_signs):
        wave = np.concatenate(larger[sign]) if larger[sign] else none
        done = [wave]
        while len(wave):
            wave = deal(wave, False, larger, sign)
            done.append(wave)
        larger[sign] = done
        deal(starts[edges[sign]:edges[sign + 1]], False, larger, -1)
    lesser: list[list[np.ndarray]] = [[] for _ in range(n_signs)]
    out = []
    for sign in range(n_signs - 1, -1, -1):
        wave = np.concatenate(lesser[sign]) if lesser[sign] else none
        if sign == t[-1]:
            wave = np.concatenate([wave, [len(t) - 1]])
        done = [wave]
        while len(wave):
            wave = deal(wave, True, lesser, sign)
            done.append(wave)
        up = np.concatenate(larger[sign])
        deal(up[::-1], True, lesser, -1)
        out += [np.concatenate(done), up[::-1]]
    return np.concatenate(out)[::-1]


def words_of(t: np.ndarray) -> np.ndarray:
    """Four signs from each place on as one number; after the end come zeros."""
    padded = np.concatenate([t, np.zeros(8, np.uint16)])
    out = np.empty(len(t), np.uint64)
    for shift in range(4):
        m = (len(t) - shift + 3) // 4
        if m > 0:
            out[shift::4] = padded[shift:shift + 4 * m].view("<u8")
    return out


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (a <> b)."""
    out = np.zeros(len(a), np.int64)
    live, step, n = np.arange(len(a)), 0, len(words)
    while len(live):
        x, y = a[live] + step, b[live] + step
        inside = (x < n) & (y < n)
        differ = words[np.minimum(x, n - 1)] ^ words[np.minimum(y, n - 1)]
        stop = ~inside | (differ != 0)
        ended = live[stop]
        d = differ[stop]
        signs = np.where(d & np.uint64(0xFFFF) != 0, 0, np.where(d & np.uint64(0xFFFFFFFF) != 0, 1, np.where(
            d & np.uint64(0xFFFFFFFFFFFF) != 0, 2, 3)))
        out[ended] = step + np.where(inside[stop], signs, 0)
        live, step = live[~stop], step + 4
    return out


def order_names(names: np.ndarray, span: int = 1) -> np.ndarray:
    """Order of the suffixes of a string of names: pairs of names become names, until all differ."""
    n = len(names)
    if names.max(initial=-1) + 1 == n:
        order = np.empty(n, np.int64)
        order[names] = np.arange(n)
        return order
    after = np.zeros(n, np.int64)
    after[:n - span] = names[span:] + 1
    pairs = names * (n + 1) + after
    order = np.argsort(pairs, kind="stable")
    ranked = pairs[order]
    finer = np.empty(n, np.int64)
    finer[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    return order_names(finer, 2 * span)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small numbers (uint16) that ends in its unique smallest sign."""
    n_signs = int(t.max()) + 1
    smaller = suffix_types(t)
    leftmost = np.flatnonzero(smaller & ~np.concatenate([[True], smaller[:-1]]))
    if len(leftmost) < 2:
        return induce(t, smaller, leftmost, n_signs)
    rough = induce(t, smaller, leftmost, n_signs)
    number = np.full(len(t), -1, np.int64)
    number[leftmost] = np.arange(len(leftmost))
    ranked = rough[number[rough] >= 0]
    length = np.append(np.diff(leftmost) + 1, 1)[number[ranked]]
    same = np.concatenate([[False], length[1:] == length[:-1]])
    at = np.flatnonzero(same)
    if len(at):
        same[at] = common_prefix_at_least(words_of(t), ranked[at - 1], ranked[at], length[at])
    names = np.empty(len(leftmost), np.int64)
    names[number[ranked]] = np.cumsum(~same) - 1
    return induce(t, smaller, leftmost[order_names(names)], n_signs)


def common_prefix_at_least(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the suffixes at a and b share so many signs."""
    equal = np.ones(len(a), bool)
    live, step, n = np.arange(len(a)), 0, len(words)
    while len(live):
        x, y = np.minimum(a[live] + step, n - 1), np.minimum(b[live] + step, n - 1)
        left = np.minimum(length[live] - step, 4)
        mask = np.where(left == 4, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left * 16).astype(np.uint64)) - np.uint64(1))
        fine = (words[x] ^ words[y]) & mask == 0
        equal[live[~fine]] = False
        step += 4
        live = live[fine & (length[live] > step)]
    return equal


def permuted_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text place the preceding suffix in the array and the common prefix with it.

    Where both suffixes follow the same sign the value is one less than at the place before, so only the other,
    irreducible, places are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    irreducible = np.ones(n, bool)
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    irreducible[inner] = t[inner - 1] != t[before[inner] - 1]
    at = np.flatnonzero(irreducible)
    value = np.zeros(n, np.int64)
    known = at[before[at] >= 0]
    value[known] = common_prefix(words_of(t), known, before[known])
    last = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return before, value[last] - (np.arange(n) - last)


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Per context, which of its starts begin a string that begins anywhere else in the contexts too."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    if not len(sizes):
        return []
    t = np.ones(int(sizes.sum()) + len(sizes) + 1, np.uint16)
    t[-1] = 0
    begin = np.cumsum(sizes + 1) - sizes - 1
    inside = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    t[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 2
    left = np.zeros(len(t), np.int64)
    left[inside] = np.repeat(begin + sizes, sizes) - inside
    before, common = permuted_prefixes(t, suffix_array(t))
    hit = np.flatnonzero((common >= length) & (left >= length))
    repeated = np.zeros(len(t), bool)
    repeated[hit] = True
    repeated[before[hit]] = True
    return [repeated[b:b + max(0, s - length + 1)] for b, s in zip(begin, sizes)]


# --- plan ----------------------------------------------------------------------------------------

def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


CONTEXT_DDL = "h long, c long, context binary"
RUN_DDL = "h long, c long, runs array<struct<first:int,number:int>>"


def cut_contexts(length: int) -> ArrowMap:
    """(text, its wanted contexts) -> the contexts' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c, bytes_, held = [], [], [], 0
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    h.append(w["h"])
                    c.append(w["c"])
                    bytes_.append(raw[w["lo"]:w["lo"] + w["n"] + length - 1])
                    held += len(bytes_[-1])
                if held >= MAP_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(bytes_, pa.binary())],
                                                     ["h", "c", "context"])
                    h, c, bytes_, held = [], [], [], 0
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(bytes_, pa.binary())],
                                                 ["h", "c", "context"])

    return run


def sort_shards(length: int, shard_bytes: int) -> ArrowMap:
    """Runs of repeated starts per context; a shard takes whole anchor groups, which arrive in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        contexts: list[bytes] = []
        held, last = 0, None
        for batch in batches:
            for h, c, context in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                     batch.column(2).to_pylist()):
                if held >= shard_bytes and h != last:
                    yield shard(keys, contexts)
                    keys, contexts, held = [], [], 0
                keys.append((h, c))
                contexts.append(context)
                held += len(context)
                last = h
        if keys:
            yield shard(keys, contexts)

    def shard(keys: list[tuple[int, int]], contexts: list[bytes]) -> pa.RecordBatch:
        rows = [(h, c, [{"first": a, "number": n} for a, n in found]) for (h, c), flags in zip(
            keys, repeated_starts(contexts, length)) if (found := runs(flags))]
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("number", pa.int32())]))]
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types)], ["h", "c", "runs"])

    return run


def hash_strings(length: int) -> ArrowMap:
    """Digests of all strings of the contexts: (h, c, first, two halves of the digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for h, c, context in zip(*(part.column(i).to_pylist() for i in range(3))):
                    for first in range(len(context) - length + 1):
                        d = hashlib.blake2b(context[first:first + length], digest_size=16).digest()
                        rows.append((h, c, first, int.from_bytes(d[:8], "little", signed=True),
                                     int.from_bytes(d[8:], "little", signed=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [
                    pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])], ["h", "c", "first", "d1", "d2"])

    return run


def repeated_runs(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                  hot_contexts: int = HOT_CONTEXTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, number): runs of places, in bytes, at which a repeated string starts."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of fewer than {2 * GRAM} bytes have no anchor")
    texts = texts_of(docs, id_col, text_col)
    long_enough = texts.where(F.octet_length("text") >= length)
    anchors = written(long_enough.mapInArrow(find_anchors(length), "doc_id long, lo int, n int, h long, c long"),
                      "anchors")
    again = written(anchors.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "again")
    met = written(anchors.join(again, "h"), "met")
    folded = written(met.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "lo", "n")).alias("r")),
                     "folded")
    groups = folded.groupBy("h").agg(F.count("*").alias("contexts")).where("contexts > 1")
    sort_these = written(folded.join(groups, "h").select(
        "r.doc_id", "contexts", F.struct("h", "c", "r.lo", "r.n").alias("w")), "to_sort")

    def bytes_of(wanted: DataFrame) -> DataFrame:
        per_doc = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
        bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("doc_id")))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return (passing(batch, bitmap.value) for batch in batches)

        return long_enough.mapInArrow(asked, "doc_id long, text string").join(per_doc, "doc_id").select(
            "text", "wanted").mapInArrow(cut_contexts(length), CONTEXT_DDL)

    n_hot = groups.where(F.col("contexts") > hot_contexts).limit(1).count()
    cool = bytes_of(sort_these.where(F.col("contexts") <= hot_contexts) if n_hot else sort_these)
    found = cool.repartition("h").sortWithinPartitions("h").mapInArrow(sort_shards(length, shard_bytes), RUN_DDL)
    if n_hot:
        strings = bytes_of(sort_these.where(F.col("contexts") > hot_contexts)).mapInArrow(
            hash_strings(length), "h long, c long, first int, d1 long, d2 long")
        strings = written(strings, "strings")
        twice = strings.groupBy("d1", "d2").agg(F.count("*").alias("k")).where("k > 1").drop("k")
        found = found.union(strings.join(twice, ["d1", "d2"]).select("h", "c", F.struct(
            "first", F.lit(1).alias("number")).alias("run")).groupBy("h", "c").agg(F.collect_list("run").alias("runs")))
    of_copies = folded.where("k > 1").select("h", "c", F.array(F.struct(
        F.lit(0).alias("first"), F.col("r.n").alias("number"))).alias("runs"))
    of_rest = found.join(folded.where("k = 1").select("h", "c"), ["h", "c"])
    all_runs = of_copies.unionByName(of_rest)
    return met.join(all_runs, ["h", "c"]).select("doc_id", "lo", F.explode("runs").alias("r")).select(
        "doc_id", (F.col("lo") + F.col("r.first")).alias("start"), F.col("r.number").alias("number"))


SPLIT_DDL = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"


def removed(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Byte spans that the runs of repeated starts cover, merged where they touch."""
    spans: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["start"] + r["number"] + length - 1) for r in found or ()):
        if spans and a <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], b)
        else:
            spans.append((a, b))
    return spans


def remaining(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for i, text in enumerate(batch.column(column)):
        held += text.as_buffer().size if text.is_valid else 0
        if held >= MAP_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def split_texts(length: int) -> ArrowMap:
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, 1)):
            rows = []
            for doc_id, text, found in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                raw, spans = text.as_buffer().to_pybytes(), removed(found, length)
                rows.append((doc_id, len(raw), [{"start": a, "end": b} for a, b in spans], remaining(raw, spans)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)],
                                             ["doc_id", "n_bytes", "spans", "kept"])

    return run


def with_runs(docs: DataFrame, length: int, id_col: str, text_col: str, **how) -> DataFrame:
    """The documents with the runs of repeated starts as another column, the last one, null without any."""
    per_doc = repeated_runs(docs, length, id_col=id_col, text_col=text_col, **how).groupBy(
        F.col("doc_id").alias("__of_doc")).agg(F.collect_list(F.struct("start", "number")).alias("__found_runs"))
    return docs.join(per_doc, docs[id_col] == per_doc["__of_doc"], "left").drop("__of_doc")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   **how) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed byte ranges, in order) and kept (the bytes that remain)."""
    keyed = keyed_rows(docs, id_col, F.xxhash64(text_col))
    own = texts_of(docs, id_col, text_col) if keyed is None else texts_of(
        keyed.select("key", F.col(f"of.`{text_col}`").alias("text")), "key", "text")
    out = with_runs(own, length, "doc_id", "text", **how).mapInArrow(split_texts(length), SPLIT_DDL)
    return out if keyed is None else ids_back(out, keyed, id_col, "doc_id")


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents with what remains of their texts, and all their other columns; characters cut in two go whole."""
    keyed = keyed_rows(docs, id_col, F.xxhash64(text_col))
    rows, key = (docs, id_col) if keyed is None else (keyed.select("of.*", F.col("key").alias("__row_key")), "__row_key")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, at)):
            texts = [remaining(t.as_buffer().to_pybytes(), removed(f, length)).decode("utf-8", "ignore") if f else t.as_py()
                     for t, f in zip(part.column(at), part.column(part.num_columns - 1).to_pylist())]
            columns = list(part.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1])

    out = with_runs(rows, length, key, text_col, **how).mapInArrow(run, rows.schema)
    return out if keyed is None else out.drop("__row_key")
