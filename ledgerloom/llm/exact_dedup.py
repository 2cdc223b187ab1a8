"""Exact duplicates through an extendible-hash index in a shared folder.

Every text gets a 64-bit key. The top bits of a key name the owner of its range; the rest addresses the owner's
directory. An owner inserts its entries one by one: an overfull bucket splits on one more bit, and the directory doubles
when the bucket already uses all its bits. Texts with one key form a chain and are told apart by comparing their bytes.
Map tasks first fold the copies they see themselves, so a text that makes up a third of all rows reaches its owner once
per map task. The finished index is a parquet table, one row per distinct text, that later batches can be probed with.

Edge cases: null text counts as empty, so all null and empty texts are one group. Extra columns are ignored. No rows
give an empty index and an empty result. Every row counts in its group, also where ids are null or shared, and exactly one
row of a group is kept: of repeated rows any one, of null ids one only where no row of the group has an id.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import ArrowMap, texts_of
from ledgerloom.llm.rowkeys import ids_back, keyed_rows
from ledgerloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OWNER_BITS = 12
BUCKET_ENTRIES = 64
MAX_DEPTH = 64 - OWNER_BITS
FOLD_BYTES = 64 << 20

ENTRY = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
ENTRY_DDL = "key long, text binary, keep_id long, group_size long"
INDEX_DDL = ("owner int, bucket long, depth int, key long, chain int, keep_id long, group_size long, "
             "text_sha256 string, text binary")
INDEX = pa.schema([("owner", pa.int32()), ("bucket", pa.int64()), ("depth", pa.int32()), ("key", pa.int64()),
                   ("chain", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()),
                   ("text_sha256", pa.string()), ("text", pa.binary())])


class Chains:
    """Entries of one key, told apart by their bytes: key -> list of [text, largest id, count]."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.held = 0

    def add(self, key: int, text: bytes, keep_id: int, n: int) -> bool:
        """True if the text is new."""
        chain = self.of.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                if entry[1] is None or keep_id is not None and keep_id > entry[1]:
                    entry[1] = keep_id
                entry[2] += n
                return False
        chain.append([text, keep_id, n])
        self.held += len(text) + 200
        return True


class Directory:
    """The directory of one owner: slot -> bucket, both grown by extendible hashing."""

    def __init__(self, capacity: int = BUCKET_ENTRIES, max_depth: int = MAX_DEPTH) -> None:
        self.capacity, self.max_depth, self.depth = capacity, max_depth, 0
        self.slots = [(0, 0, Chains())]  # pattern of the bucket, its own depth, its chains

    def add(self, key: int, text: bytes, keep_id: int, n: int) -> None:
        address = key & ((1 << self.max_depth) - 1)
        pattern, depth, chains = self.slots[address & ((1 << self.depth) - 1)]
        if chains.add(key, text, keep_id, n):
            while len(chains.of) > self.capacity and depth < min(self.max_depth, 24):
                self.split(pattern, depth, chains)
                pattern, depth, chains = self.slots[address & ((1 << self.depth) - 1)]

    def split(self, pattern: int, depth: int, chains: Chains) -> None:
        if depth == self.depth:
            self.slots = self.slots + self.slots
            self.depth += 1
        halves = (pattern, depth + 1, Chains()), (pattern | 1 << depth, depth + 1, Chains())
        for key, chain in chains.of.items():
            halves[key >> depth & 1][2].of[key] = chain
        for slot in range(pattern, 1 << self.depth, 1 << depth):
            self.slots[slot] = halves[slot >> depth & 1]

    def rows(self) -> Iterator[tuple]:
        seen = set()
        for pattern, depth, chains in self.slots:
            if (pattern, depth) not in seen:
                seen.add((pattern, depth))
                for key, chain in chains.of.items():
                    for place, (text, keep_id, n) in enumerate(chain):
                        yield pattern, depth, key, place, keep_id, n, text


def fold_copies(fold_bytes: int) -> ArrowMap:
    """One entry per distinct text of a map task, as long as the held texts stay under the given size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Chains()
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            for doc_id, key, text in zip(ids.to_pylist(), keys.to_pylist(), texts):
                held.add(key, text.as_py(), doc_id, 1)
                if held.held > fold_bytes:
                    yield from entries(held)
                    held = Chains()
        yield from entries(held)

    def entries(held: Chains) -> Iterator[pa.RecordBatch]:
        rows = [(key, *entry) for key, chain in held.of.items() for entry in chain]
        for at in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 2000]), ENTRY.types)],
                                             schema=ENTRY)

    return run


def own_ranges(capacity: int, max_depth: int) -> ArrowMap:
    """Build the directories of the key ranges that fall to this task, and list their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directories: dict[int, Directory] = {}
        for batch in batches:
            owners, keys, texts, ids, sizes = (batch.column(i) for i in range(5))
            for owner, key, text, keep_id, n in zip(owners.to_pylist(), keys.to_pylist(), texts, ids.to_pylist(),
                                                    sizes.to_pylist()):
                directories.setdefault(owner, Directory(capacity, max_depth)).add(key, text.as_py(), keep_id, n)
        rows: list[tuple] = []
        for owner, directory in directories.items():
            for pattern, depth, key, place, keep_id, n, text in directory.rows():
                rows.append((owner, pattern, depth, key, place, keep_id, n, hashlib.sha256(text).hexdigest(), text))
                if len(rows) == 2000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts_of(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"),
                                                   F.encode("text", "UTF-8").alias("text"))


def index_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None,
               bucket_entries: int = BUCKET_ENTRIES, owner_bits: int = OWNER_BITS,
               fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """The index as a frame: one row per distinct text with its owner, bucket, depth, chain place and text.

    ``key`` is an SQL expression over ``text`` (binary) for another key than the default 64-bit hash. A task holds the
    texts of its key ranges; raise the number of shuffle partitions if they outgrow it.
    """
    rows = keyed(docs, id_col, text_col)
    if key is not None:
        rows = rows.withColumn("key", F.expr(key).cast("long"))
    folded = rows.mapInArrow(fold_copies(fold_bytes), ENTRY_DDL)
    owned = folded.select(F.shiftrightunsigned("key", 64 - owner_bits).cast("int").alias("owner"), "key", "text",
                          "keep_id", "group_size").repartition("owner")
    return owned.mapInArrow(own_ranges(bucket_entries, 64 - owner_bits), INDEX_DDL)


def build_index(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the index to ``path`` (or to the shared folder) and read it back."""
    plan = index_plan(docs, **how)
    if path is None:
        return written(plan, "hash_index")
    plan.write.parquet(path)
    return docs.sparkSession.read.schema(plan.schema).parquet(path)


def directory(index: DataFrame) -> DataFrame:
    """(owner, bucket, depth, entries): the buckets, with their bit pattern and the number of bits it has."""
    return index.groupBy("owner", "bucket", "depth").agg(F.count("*").alias("entries"))


def assign(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Texts the index lacks get null."""
    rows = texts_of(docs, id_col, text_col).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return rows.join(index.select("text_sha256", "keep_id", "group_size"), "text_sha256", "left").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def probe(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) of the rows whose text the index already has; equal keys are settled by comparing bytes."""
    rows = keyed(docs, id_col, text_col)
    return rows.join(index.select("key", F.col("text").alias("_indexed"), "keep_id"), "key").where(
        "text = _indexed").select("doc_id", "keep_id")


def by_index(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """``exact_dedup`` where ids are unique and not null."""
    return assign(docs, build_index(docs, id_col=id_col, text_col=text_col, **how), id_col, text_col)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame | None, DataFrame | None]:
    keyed = keyed_rows(docs, id_col, F.xxhash64(text_col), nulls_first=True)
    return keyed, keyed and keyed.select("key", F.col(f"of.`{text_col}`").alias("text"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Group equal texts; of each group the row with the largest id stays."""
    keyed, rows = _keyed(docs, id_col, text_col)
    if keyed is None:
        return by_index(docs, id_col, text_col, **how)
    return ids_back(by_index(rows, "key", "text", **how), keyed, id_col, "doc_id", "keep_id")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns."""
    keyed, rows = _keyed(docs, id_col, text_col)
    if keyed is None:
        stay = by_index(docs, id_col, text_col, **how).where("kept").select(F.col("doc_id").alias("stays"))
        return docs.join(stay, docs[id_col] == stay["stays"], "left_semi")
    stay = by_index(rows, "key", "text", **how).where("kept").select(F.col("doc_id").alias("stays"))
    return keyed.join(stay, keyed["key"] == stay["stays"], "left_semi").select("of.*")
