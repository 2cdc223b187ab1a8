"""Prefix trie of conversations, built from whole sequences instead of turn by turn.

Equal conversations collapse into one weighted sequence first, with a list of the ones that end there. Sequences that
are proper prefixes of others are found by an anti-join; the rest are the leaves. Each distinct sequence then gives one
weighted row per prefix, and aggregating those yields the nodes. A turn's text leaves its row only as a digest and a
number of code points.

Sums over a subtree need no walk of the trie. Over all sequences through a node, weight times the length below it counts
every turn once per conversation. Over all leaves through it, the length below it that a leaf *owns* counts every turn
once per node: a node belongs to the smallest leaf below it, so what a leaf owns is the end of its path, and one number
per leaf says where that begins.

Nothing meets in one task because it is common: a frequent sequence or turn is a partial aggregate, members of an end list
are range-partitioned and only their finished pieces of text follow each other through the digest, and the children of
frequent parents look their parent up in a broadcast of at most ``HOT_PARENTS`` rows. One conversation's digests
(24 bytes a turn) are one row.

Edge cases: null role or text counts as empty. Turns are ordered by number, null first; turns of equal number by the
digest of role and text; equal rows are separate turns. Rows without conv_id belong to no conversation and are left out.
``rebuilt`` takes heads only from conversations that are there. A conversation without turns belongs to the root, which
exists as soon as any conversation does. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOT_PARENTS = 4096
PIECE_IDS = 4096
ROOT = bytes(16)
TURNS = "array<struct<turn:bigint,digest:binary,chars:bigint>>"
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): 16 bytes that stand for role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(both)).alias("digest"), F.char_length(text).cast("long").alias("chars"))


def head_length(conv_id: Column, most: int = 6) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(most)).cast("int")


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns) with the first h turns replaced by those of the conversation that opens the block of ids.

    Turns are dealt by block once; gathering a conversation and looking at its block's first one both stay there.
    """
    t = turn_digests(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % block).repartition("base")
    own = t.groupBy("base", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).cast(TURNS).alias("turns"))
    head = F.slice("turns", 1, most)
    opens = F.first(F.when(F.col("conv_id") == F.col("base"), head), ignorenulls=True).over(Window.partitionBy("base"))
    h = head_length(F.col("conv_id"), most)
    own = own.withColumns({"head": F.coalesce(opens, F.array().cast(TURNS)), "h": h})
    return own.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")),
                                          F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each prefix's digest, from that of the prefix before it and the next turn, and the length from its last turn on."""
    for batch in batches:
        paths, below = [], []
        for turns in batch.column(1).to_pylist():
            path, sizes = [ROOT], [0]
            for t in turns:
                path.append(hashlib.blake2b(path[-1] + t["digest"], digest_size=16).digest())
                sizes.append(t["chars"])
            paths.append(path)
            below.append(list(accumulate(reversed(sizes)))[::-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p[-1] for p in paths], pa.binary()), pa.array(paths, pa.list_(pa.binary())),
             pa.array(below, pa.list_(pa.int64()))], ["conv_id", "sequence", "path", "below"])


def with_nodes(turns: DataFrame) -> DataFrame:
    """(conv_id, sequence, path, below): digests of all prefixes, the root's first, and code points from each depth on."""
    return turns.select("conv_id", "turns").mapInArrow(
        _with_nodes, "conv_id long, sequence binary, path array<binary>, below array<long>")


def sequences(members: DataFrame) -> DataFrame:
    """Distinct sequences with weight and smallest member; paths are equal where digests are."""
    return members.groupBy("sequence").agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("first_conv"),
        F.any_value("path").alias("path"), F.any_value("below").alias("below"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sequence, conv_id) to runs of at most PIECE_IDS ids as text."""
    out, now, first, ids = [], None, None, []

    def flush():
        if ids:
            out.append((now, first, ",".join(ids).encode()))
            ids.clear()

    def ready():
        done = pa.RecordBatch.from_pydict({"sequence": [o[0] for o in out], "first": [o[1] for o in out],
                                           "piece": [o[2] for o in out]}, schema=pa.schema(
            [("sequence", pa.binary()), ("first", pa.int64()), ("piece", pa.binary())]))
        out.clear()
        return done

    for batch in batches:
        for seq, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if seq != now or len(ids) == PIECE_IDS:
                flush()
                now, first = seq, conv
            ids.append(str(conv))
        if out:
            yield ready()
    flush()
    if out:
        yield ready()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest per sequence; only the running digest is held."""
    now, state = None, None
    for batch in batches:
        seqs, hashes = [], []
        for seq, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if seq != now:
                if state:
                    seqs.append(now)
                    hashes.append(state.hexdigest())
                now, state = seq, hashlib.sha256(piece)
            else:
                state.update(b",")
                state.update(piece)
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.binary()), pa.array(hashes, pa.string())], ["sequence", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])],
                                         ["sequence", "ends_sha256"])


def end_lists(members: DataFrame) -> DataFrame:
    """(sequence, ends_sha256): SHA-256 of the ascending ids that end at each sequence, joined by commas."""
    ranged = members.select("sequence", "conv_id").repartitionByRange("sequence", "conv_id").sortWithinPartitions(
        "sequence", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "sequence binary, first long, piece binary")
    # Hashing a hash keeps Spark from taking this shuffle for one that is already there and dropping it.
    dealt = pieces.repartition(F.xxhash64("sequence")).sortWithinPartitions("sequence", "first")
    return dealt.mapInArrow(_digests, "sequence binary, ends_sha256 string")


def leaves(seqs: DataFrame) -> DataFrame:
    """Sequences that are no proper prefix of another."""
    inner = seqs.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("sequence")).distinct()
    return seqs.join(inner, "sequence", "left_anti")


def owned_from(leaf: DataFrame) -> DataFrame:
    """(sequence, owned): the depth from which a leaf is the smallest leaf below every node of its path."""
    nodes = leaf.select(F.posexplode("path").alias("depth", "node"), "sequence")
    return nodes.groupBy("node").agg(F.min("sequence").alias("sequence"), F.any_value("depth").alias("depth")).groupBy(
        "sequence").agg(F.min("depth").alias("owned"))


def nodes_of(seqs: DataFrame, owned: DataFrame) -> DataFrame:
    """All nodes, aggregated from the weighted prefixes of the distinct sequences."""
    steps = seqs.join(owned, "sequence", "left").select(
        "weight", "first_conv", "path", "below", "owned", F.posexplode("path").alias("depth", "node"))
    at = lambda depth: F.element_at("below", depth + 1)
    steps = steps.select(
        "node", "depth", "weight", "first_conv", F.when(F.col("depth") > 0, F.element_at("path", F.col("depth"))).alias("parent"),
        F.col("owned").isNotNull().cast("long").alias("leaf"), (F.col("weight") * at(F.col("depth"))).alias("each"),
        F.when(F.col("owned").isNotNull(), at(F.greatest("depth", "owned"))).otherwise(F.lit(0)).alias("once"))
    return steps.groupBy("node").agg(
        F.min("first_conv").alias("conv_id"), F.any_value("depth").cast("long").alias("depth"),
        F.any_value("parent").alias("parent"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        (F.sum("each") - F.sum("once")).alias("saved_tokens"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds n_children and the parent's conv_id."""
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, "node", "left"), "nodes")
    up = nodes.where("n_children is not null").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = written(up.orderBy(F.desc("n_children"), "parent").limit(HOT_PARENTS).drop("n_children"), "hot")
    near = nodes.join(F.broadcast(hot), "parent")
    far = nodes.where("parent is not null").join(F.broadcast(hot), "parent", "left_anti").join(
        up.drop("n_children"), "parent")
    top = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return near.unionByName(far).unionByName(top).withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns).

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``; ``n_convs``: members; ``n_children``; ``n_leaves``;
    ``saved_tokens``: (members - 1) times the code points of the last text, summed over the subtree; ``ends_sha256``:
    see ``end_lists``, of no ids where no conversation ends.
    """
    members = written(with_nodes(turns), "members")
    seqs = written(sequences(members), "sequences")
    owned = owned_from(leaves(seqs).select("sequence", "path"))
    nodes = with_parents(nodes_of(seqs, owned))
    return nodes.join(end_lists(members).withColumnRenamed("sequence", "node"), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
