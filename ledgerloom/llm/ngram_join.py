"""Groups of documents whose word shingles overlap, by a blocked sparse product of documents and n-grams.

The Jaccard similarity of two sets is at least a threshold only if they share an element among the first
``n - ceil(threshold * n) + 1`` of each, in any fixed order of all elements. So the product needs only these columns of
the incidence matrix. N-grams that many documents hold come last in the order; this changes the work, not the result.

1. Documents with equal sets become one row of the matrix (a group-by over digests of the sets).
2. The columns are dealt out over tasks; hot ones in blocks of rows. Columns with one row contribute nothing and go.
3. Each row is compared with the smallest row of its column, exactly, unless sizes or sketches (see 4) rule the pair out;
   the links found give first groups.
4. Of pairs in one column, only those between different groups are left to decide. Their products are taken in tiles of
   two row blocks, and pairs go whose size, place or parity sketch bounds the overlap below the threshold: in the first
   column two sets share, they share at most that one and what either has behind it; and they differ in at least as many
   elements as in sketch bits.
5. For the remaining pairs the whole overlap is accumulated, exactly. Small columns give all their pairs; large ones first
   a spanning forest over the nearest sketches, whose links join nearly all that belongs together, and then all pairs
   that are still between different groups. Links give the final groups; no link between different groups is missed.

Sets travel only for rows that take part in a comparison. A comparison of one row with very many is split by salt.

Edge cases: null text counts as empty. Documents without words have an empty set and are linked with nothing; with fewer
words than ``n``, the whole sequence is one shingle. No rows give no rows. Extra columns
are ignored. Every row counts as a document, also where ids are null or shared: a repeated row shares a group with its
copies, one id with two texts is in two groups if these are not alike, and a null id comes after all others, so it names a
group only where no row of the group has an id. ``keep_one`` keeps exactly one row of a group.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ArrowMap, components, id_filter, mixed, passing, texts_of
from ledgerloom.llm.rowkeys import ids_back, keyed_rows
from ledgerloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 4 << 20
MAX_HOT = 65_536
HOT_FROM = 64
BLOCK_ROWS = 2048
SALT_ROWS = 1000
LIST_TO = 24
SKETCH_WORDS = 8
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


# --- shingle sets --------------------------------------------------------------------------------

class Shingler:
    """Sorted sets of 64-bit shingle hashes of many texts at once."""

    def __init__(self, n: int) -> None:
        self.n = n
        byte = np.arange(256, dtype=np.uint8)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.sign = mixed(lower.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        self.blank = (byte == 0x20) | ((byte >= 9) & (byte <= 13))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + (1 << 16))
            for name, by in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(size, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.powers(len(raw) + 1)
        word = ~self.blank[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.sign[raw] * self.up[:len(raw)], dtype=np.uint64)])
        words = mixed((sums[end] - sums[start]) * self.down[start])
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        cuts = np.searchsorted(start, first)
        n = self.n
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n if len(grams) else 0):
            grams = mixed(grams + words[i:i + len(grams)] * np.uint64(MULTIPLIERS[i % 5] + 2 * (i // 5)))
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(grams[a:b - n + 1]))
            elif b > a:
                short = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    short = mixed(short * np.uint64(MULTIPLIERS[4]) + w)
                out.append(short)
            else:
                out.append(grams[:0])
        return out


def sets_of(batch: pa.RecordBatch, shingler: Shingler) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    ids, raws, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(doc_id)
        raws.append(text.as_buffer().to_pybytes())
        held += len(raws[-1])
        if held >= CHUNK_BYTES:
            yield ids, shingler(raws)
            ids, raws, held = [], [], 0
    if ids:
        yield ids, shingler(raws)


def first_elements(n: int, percent: int) -> int:
    """How many first elements of a set of n must be looked at."""
    return n - -(-percent * n // 100) + 1


def keys_of(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Column keys in order: 62 bits of the hash, hot n-grams after all others."""
    keys = (grams >> np.uint64(2)).astype(np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        keys = np.where(hot[at] == keys, keys | 1 << 62, keys)
        keys.sort()
    return keys


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of elements that fall on each of SKETCH_WORDS * 64 bits."""
    bits = np.bincount((grams & np.uint64(SKETCH_WORDS * 64 - 1)).astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


# --- map steps -----------------------------------------------------------------------------------

PROFILE_DDL = "doc_id long, n int, d1 long, d2 long, gram long, held long"


def profile(n: int, percent: int) -> ArrowMap:
    """A row per document with its set's size and digest, and per task the columns that several of its sets open."""
    names, types = ["doc_id", "n", "d1", "d2", "gram", "held"], [pa.int64(), pa.int32()] + [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, opened, size = Shingler(n), set(), [], 0
        none = np.empty(0, np.int64)
        for batch in batches:
            for ids, sets in sets_of(batch, shingler):
                rows = []
                for doc_id, grams in zip(ids, sets):
                    d = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                    rows.append((doc_id, len(grams), int.from_bytes(d[:8], "little", signed=True),
                                 int.from_bytes(d[8:], "little", signed=True), None, None))
                    if len(grams) and d not in seen:
                        seen.add(d)
                        opened.append(keys_of(grams, none)[:first_elements(len(grams), percent)])
                        size += len(opened[-1])
                yield batch_of(rows, names, types)
                if size > 4_000_000:
                    yield held(opened)
                    seen, opened, size = set(), [], 0
        if opened:
            yield held(opened)

    def held(opened: list[np.ndarray]) -> pa.RecordBatch:
        gram, count = np.unique(np.concatenate(opened), return_counts=True)
        often = count > 1
        return batch_of([(None, None, None, None, int(g), int(c)) for g, c in zip(gram[often], count[often])], names, types)

    return run


def incidence(n: int, percent: int, hot: np.ndarray) -> ArrowMap:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for ids, sets in sets_of(batch, shingler):
                rows = [(i, len(s), keys_of(s, hot)[:first_elements(len(s), percent)], sketch(s))
                        for i, s in zip(ids, sets) if len(s)]
                yield batch_of(rows, ["doc_id", "n", "keys", "sketch"],
                               [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())])

    return run


def deal_columns(hot: np.ndarray, blocks: np.ndarray) -> ArrowMap:
    """A row per entry: column, number of row blocks of the column, block of this row, row and its set size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2)
            g = keys.flatten().to_numpy()
            lengths = np.diff(keys.offsets.to_numpy())
            doc = np.repeat(batch.column(0).to_numpy(), lengths)
            n = np.repeat(batch.column(1).to_numpy(), lengths)
            many = np.ones(len(g), np.int32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, g & ~(1 << 62)), len(hot) - 1)
                many = np.where((g >> 62 == 1) & (hot[at] == g & ~(1 << 62)), blocks[at], 1).astype(np.int32)
            block = (mixed(doc.astype(np.uint64)) % many.astype(np.uint64)).astype(np.int32)
            place = (np.arange(len(g)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, many, block, doc, n, place)],
                                             ["g", "blocks", "block", "rep", "n", "place"])

    return run


def group_starts(*columns: np.ndarray) -> np.ndarray:
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that arrive in the order of the keys."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held)
            last = int(group_starts(*(t[k].to_numpy() for k in keys))[-1])
            if last:
                yield t.slice(0, last)
                held = t.slice(last).to_batches()
                size = t.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def keep_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of columns with more than one row, with the size and the smallest row of the column block."""
    for t in whole_groups(batches, ["g", "block"]):
        g, blocks, block, rep, n, place = (t[c].to_numpy() for c in ("g", "blocks", "block", "rep", "n", "place"))
        first = group_starts(g, block)
        sizes = np.diff(np.append(first, len(g)))
        lead = np.repeat(np.minimum.reduceat(rep, first), sizes)
        lead_n = np.repeat(n[rep == lead], sizes)
        met = (np.repeat(sizes, sizes) > 1) | (blocks > 1)
        held = np.repeat(sizes, sizes).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (g, blocks, block, rep, n, place, lead, lead_n, held)],
                                         ["g", "blocks", "block", "rep", "n", "place", "lead", "lead_n", "held"])


def allowed(percent: int, x: np.ndarray, y: np.ndarray, n: np.ndarray, place: np.ndarray, label: np.ndarray,
            bits: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) of entries of one column are of two groups and not ruled out by size, place or sketch."""
    rest = n - place
    ok = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    # As first shared column of the pair, it leaves at most what one of both has behind it.
    ok &= (1 + np.minimum(rest[x], rest[y])) * (100 + percent) >= percent * (n[x] + n[y])
    at = np.flatnonzero(ok)
    x, y = x[at], y[at]
    differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1).astype(np.int64)
    ok[at] = (n[x] + n[y] - differ) * (100 + percent) >= 2 * percent * (n[x] + n[y])
    return ok


def spanning(percent: int, n: np.ndarray, place: np.ndarray, label: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows of one tile that join all its groups by what is left to decide, the nearest sketches first.

    A minimum spanning forest, grown row by row: rows of one group are joined already, pairs that are ruled out join
    nothing. Fewer pairs than rows, held in memory that grows with the rows only.
    """
    far = np.iinfo(np.int64).max
    near, via = np.full(len(n), far), np.zeros(len(n), np.int64)
    out, left, i = [], np.arange(1, len(n)), 0
    while len(left):
        at = np.full(len(left), i)
        ok = allowed(percent, at, left, n, place, label, bits)
        step = np.where(label[left] == label[i], -1, far)
        step[ok] = np.bitwise_count(bits[left[ok]] ^ bits[i]).sum(axis=1)
        closer = step < near[left]
        near[left[closer]], via[left[closer]] = step[closer], i
        k = int(near[left].argmin())
        i = int(left[k])
        left = np.delete(left, k)
        if 0 <= near[i] < far:
            out.append((i, int(via[i])))
    return out


def products(percent: int, list_to: int | None = None) -> ArrowMap:
    """Pairs of different groups in the tiles of a task that sizes, places and sketches allow.

    With ``list_to``, columns of more rows (and those in blocks) give the pairs of a spanning forest per tile instead of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["g", "bi", "bj"], 200_000):
            rep, n, place, label, block = (t[c].to_numpy() for c in ("rep", "n", "place", "label", "block"))
            cross = t["bi"].to_numpy() != t["bj"].to_numpy()
            bits = t["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
            first = group_starts(t["g"].to_numpy(), t["bi"].to_numpy(), t["bj"].to_numpy())
            end = np.repeat(np.append(first[1:], len(rep)), np.diff(np.append(first, len(rep))))
            n = n.astype(np.int64)
            found: list[np.ndarray] = []
            size, live, d = 0, np.arange(len(rep)), 1
            if list_to is not None:
                large = t["large"].to_numpy()
                for i, j in zip(first[large[first]].tolist(), end[first[large[first]]].tolist()):
                    pairs = spanning(percent, n[i:j], place[i:j], label[i:j], bits[i:j])
                    if pairs:
                        x, y = rep[i:j][np.array(pairs).T]
                        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                live = live[~large]
            while len(live := live[live + d < end[live]]):
                j = live + d
                ok = allowed(percent, live, j, n, place, label, bits) & (~cross[live] | (block[live] != block[j]))
                x, y = rep[live[ok]], rep[j[ok]]
                if len(x):
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
                    size += len(x)
                if size > 1_000_000:
                    found, size = [distinct(found)], 0
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.pop()], ["a", "b"])
                d += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in distinct(found)], ["a", "b"])

    def distinct(found: list[np.ndarray]) -> np.ndarray:
        a, b = np.concatenate(found, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = group_starts(a, b)
        return np.stack([a[first], b[first]])

    return run


def wanted_sets(n: int, wanted) -> ArrowMap:
    """Sets of the documents that pass a broadcast bitmap of the wanted ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            for ids, sets in sets_of(passing(batch, wanted.value), shingler):
                yield batch_of([(i, s.tobytes()) for i, s in zip(ids, sets)], ["doc_id", "grams"],
                               [pa.int64(), pa.binary()])

    return run


def compare(percent: int) -> ArrowMap:
    """Exact overlaps: in each group the leading set arrives first, the others follow one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead = None, None
        for batch in batches:
            rows = []
            for a, salt, doc, leads, grams in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = np.frombuffer(grams, np.uint64)
                if leads:
                    key, lead = (a, salt), own
                elif (a, salt) == key:
                    both = np.concatenate([lead, own])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(lead) + len(own) - shared):
                        rows.append((a, doc, shared))
                else:
                    raise ValueError("a comparison without its leading set")
            yield batch_of(rows, ["a", "b", "shared"], [pa.int64(), pa.int64(), pa.int64()])

    return run


# --- plan ----------------------------------------------------------------------------------------

def hot_columns(profiles: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Columns that most sets open, in order, and their counts: at most MAX_HOT, from the power of two that allows it."""
    held = profiles.where("gram is not null").groupBy("gram").agg(F.sum("held").alias("held")).where(
        F.col("held") >= HOT_FROM)
    held = written(held, "hot")
    steps = sorted((r[0], r[1]) for r in held.groupBy(F.floor(F.log2("held")).alias("s")).count().collect())
    total, least = 0, None
    for step, count in reversed(steps):
        total += count
        if total > MAX_HOT:
            break
        least = step
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = held.where(F.floor(F.log2("held")) >= least).orderBy("gram").collect()
    return np.array([r["gram"] for r in rows], np.int64), np.array([r["held"] for r in rows], np.int64)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their whole sets."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs.withColumn("shared", F.lit(0).cast("long"))
    members = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(members, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    roles = written(salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(False).alias("leads")).union(
        members.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                       F.lit(True).alias("leads"))), "roles")
    wanted = texts.sparkSession.sparkContext.broadcast(id_filter(roles.select("doc_id")))
    sets = texts.mapInArrow(wanted_sets(n, wanted), "doc_id long, grams binary")
    placed = roles.hint("merge").join(sets, "doc_id").select("a", "salt", "doc_id", "leads", "grams")
    ordered = placed.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("leads"))
    return ordered.mapInArrow(compare(percent), "a long, b long, shared long")


def sketch_allows(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose sketches do not already show that they differ too much."""
    a, b = (rows.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("na").cast("long") + F.col("nb")
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(
        (both - differ) * (100 + percent) >= both * (2 * percent)).select("a", "b")


def still_mixed(entries: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of columns that more than one group holds, with each row's group as ``label`` and its sketch."""
    info = written(rows.select(F.col("doc_id").alias("rep"), "sketch").join(
        groups.select(F.col("id").alias("rep"), "component_id").hint("merge"), "rep", "left").withColumn(
        "label", F.coalesce("component_id", "rep")).drop("component_id"), "info")
    labelled = entries.select("g", "rep").join(info.select("rep", "label").hint("merge"), "rep")
    mixed_columns = labelled.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g")
    return entries.join(mixed_columns.hint("merge"), "g", "left_semi").join(info.hint("merge"), "rep")


def tiles(entries: DataFrame) -> DataFrame:
    """Entries dealt out by column and pair of row blocks."""
    paired = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "g", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "n",
        "place", "large", "label", "sketch")
    return paired.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj")


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                   block_rows: int = BLOCK_ROWS, list_to: int = LIST_TO) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest id reachable over links."""
    keyed = keyed_rows(docs, id_col, F.xxhash64(text_col))
    if keyed is None:
        return groups_by_id(docs, n, percent, id_col, text_col, block_rows, list_to)
    out = groups_by_id(keyed.select("key", F.col(f"of.`{text_col}`").alias("text")), n, percent, "key", "text",
                       block_rows, list_to)
    return ids_back(out, keyed, id_col, "doc_id", "component_id")


def groups_by_id(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, block_rows: int = BLOCK_ROWS,
                 list_to: int = LIST_TO) -> DataFrame:
    """``similar_groups`` where ids are unique and not null."""
    if not (n >= 1 and 0 < percent <= 100):
        raise ValueError("n must be positive and percent in 1 to 100")
    texts = texts_of(docs, id_col, text_col)
    profiles = written(texts.mapInArrow(profile(n, percent), PROFILE_DDL), "profiles")
    of_docs = profiles.where("doc_id is not null")
    classes = written(of_docs.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    hot, held = hot_columns(profiles)
    blocks = -(-held // block_rows)

    rows = texts.mapInArrow(incidence(n, percent, hot), "doc_id long, n int, keys array<long>, sketch array<long>")
    # Joins that grow with the input are sorted merges at every size, so that a small run shows what a large one does.
    rows = written(rows.join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi"), "rows")
    entries = rows.select("doc_id", "n", "keys").mapInArrow(
        deal_columns(hot, blocks), "g long, blocks int, block int, rep long, n int, place int")
    met = entries.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(
        keep_met, "g long, blocks int, block int, rep long, n int, place int, lead long, lead_n int, held int")
    met = written(met, "met")

    leads = met.where("blocks > 1").select("g", F.struct("lead", "lead_n").alias("l")).distinct()
    star = met.select(F.col("lead").alias("a"), F.col("rep").alias("b"), F.col("lead_n").alias("na"), F.col("n").alias("nb"))
    over_blocks = leads.join(leads.groupBy("g").agg(F.min("l").alias("low")), "g").select(
        F.col("low.lead").alias("a"), F.col("l.lead").alias("b"), F.col("low.lead_n").alias("na"),
        F.col("l.lead_n").alias("nb"))
    size_allows = f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)"
    near = sketch_allows(written(star.union(over_blocks).where(size_allows).distinct(), "star"), rows, percent)
    links = written(verified(near, texts, n, percent).select("a", "b"), "links")
    every = met.select("g", "blocks", "block", "rep", "n", "place", F.expr(f"blocks > 1 or held > {list_to}").alias("large"))
    open_ = written(still_mixed(every, rows, components(links)), "open")
    tried = written(tiles(open_).mapInArrow(products(percent, list_to), "a long, b long").distinct(), "tried")
    links = written(links.union(verified(tried, texts, n, percent).select("a", "b")), "links")
    # All pairs of the other columns are decided.
    open_ = still_mixed(open_.where("large").drop("label", "sketch"), rows, components(links))
    pairs = tiles(open_).mapInArrow(products(percent), "a long, b long").distinct()
    more = verified(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), texts, n, percent).select("a", "b")
    of_rep = components(links.union(more))

    placed = of_docs.join(classes.hint("merge"), ["d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    return placed.join(of_rep.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "rep")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns."""
    def stay(rows: DataFrame, key: str, text: str) -> DataFrame:
        return groups_by_id(rows, n, percent, key, text).where("doc_id = component_id").select(F.col("doc_id").alias("stays"))

    keyed = keyed_rows(docs, id_col, F.xxhash64(text_col))
    if keyed is None:
        ids = stay(docs, id_col, text_col)
        return docs.join(ids, docs[id_col] == ids["stays"], "left_semi")
    ids = stay(keyed.select("key", F.col(f"of.`{text_col}`").alias("text")), "key", "text")
    return keyed.join(ids, keyed["key"] == ids["stays"], "left_semi").select("of.*")
