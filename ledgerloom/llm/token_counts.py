"""Token counts that follow edits: a segment tree of pre-tokens per document.

A leaf is a run of pre-tokens with its number of characters and tokens; inner nodes hold the sums. An edit finds its
leaves by descending the character sums, and only their text is split and encoded again: from a leaf boundary far enough
before the edit that no earlier pre-token can change, to the first old leaf boundary behind it where the new splitting
arrives too. From there on the text, and so the splitting, is as before. Changed leaves update the sums above them.

Edits are (start, end, text) in characters of the text before, in any order, and must not overlap; places beyond the end
count as the end. Edits that overlap an earlier one, or end before they start, raise an error.

Edge cases: null text counts as empty and has no tokens. Null or empty edits leave a document as it is. No rows give no
rows. Columns named like the results are replaced; other columns stay.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: how the public byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No decision of the pattern looks further than this beyond the end of a match.
LOOKAHEAD = 8
LEAF = 32
CACHED = 300_000
CHUNK_CHARS = 1 << 20


class Counter:
    """Tokens per pre-token; remembers those it has met."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, cached: int = CACHED) -> None:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.split = regex.compile(pattern)
        self.met: dict[str, int] = {}
        self.cached = cached

    def counts(self, pieces: list[str]) -> list[int]:
        met = self.met
        fresh = [p for p in set(pieces) if p not in met]
        if len(met) + len(fresh) > self.cached:
            met.clear()
            fresh = list(set(pieces))
        encode = self.coder.encode_ordinary
        met.update((p, len(encode(p))) for p in fresh)
        return [met[p] for p in pieces]


def worker_counter(ranks: bytes) -> Counter:
    """One counter per worker process, so that the next tasks find the pre-tokens already met."""
    kept = sys.modules.setdefault("_ledgerloom_worker", types.ModuleType("_ledgerloom_worker")).__dict__
    name = f"counts {hashlib.sha256(ranks).hexdigest()}"
    if name not in kept:
        kept[name] = Counter(ranks)
    return kept[name]


class Tree:
    """Sums of characters and tokens over leaves; node i has the children 2i and 2i + 1, node 1 is the root."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.width = len(chars) // 2
        self.chars, self.tokens = chars, tokens

    @classmethod
    def over(cls, leaves: list[tuple[int, int]]) -> Tree:
        width = 1
        while width < len(leaves):
            width *= 2
        sums = []
        for side in (0, 1):
            s = [0] * width + [leaf[side] for leaf in leaves] + [0] * (width - len(leaves))
            for i in range(width - 1, 0, -1):
                s[i] = s[2 * i] + s[2 * i + 1]
            sums.append(s)
        return cls(*sums)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts; the last leaf for places beyond the end."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        more, gain = chars - self.chars[i], tokens - self.tokens[i]
        while i and (more or gain):
            self.chars[i] += more
            self.tokens[i] += gain
            i //= 2

    def leaves(self) -> list[tuple[int, int]]:
        return list(zip(self.chars[self.width:], self.tokens[self.width:]))


def leaves_of(pieces: list[str], counts: list[int]) -> list[tuple[int, int]]:
    return [(sum(map(len, pieces[i:i + LEAF])), sum(counts[i:i + LEAF])) for i in range(0, len(pieces), LEAF)]


def build_tree(text: str, counter: Counter) -> Tree:
    pieces = counter.split.findall(text)
    return Tree.over(leaves_of(pieces, counter.counts(pieces)))


def edited(text: str, tree: Tree, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[str, Tree, int]:
    """Text and tree after the edits, and how many characters were encoded again."""
    again, before, n = 0, None, len(text)
    inside = [(min(start, n), min(end, n), new) for start, end, new in edits]
    for start, end, new in sorted(inside, key=lambda e: (e[0], e[1]), reverse=True):
        if start < 0 or end < start or before is not None and end > before:
            raise ValueError("edits overlap, or end before they start")
        before = start
        text, tree, n = one_edit(text, tree, start, end, new, counter)
        again += n
    return text, tree, again


def one_edit(text: str, tree: Tree, start: int, end: int, new: str, counter: Counter) -> tuple[str, Tree, int]:
    after = text[:start] + new + text[end:]
    shift = len(after) - len(text)
    first, at = tree.leaf_at(max(0, start - LOOKAHEAD)) if text else (0, 0)
    last, last_end = tree.leaf_at(end) if text else (0, 0)
    last_end += tree.chars[tree.width + last]
    pieces, place = [], at
    while place < len(after):
        match = counter.split.match(after, place)
        pieces.append(match.group())
        place = match.end()
        while last_end + shift < place and last + 1 < tree.width:
            last += 1
            last_end += tree.chars[tree.width + last]
        if place == last_end + shift and last_end >= end:
            break
    fresh = leaves_of(pieces, counter.counts(pieces))
    slots = last - first + 1
    if len(fresh) > slots:
        # More leaves than places: the tree is laid out anew from the sums, without encoding anything else.
        kept = tree.leaves()
        tree = Tree.over([leaf for leaf in kept[:first] + fresh + kept[last + 1:] if leaf[0]])
    else:
        for i in range(slots):
            tree.put(first + i, *(fresh[i] if i < len(fresh) else (0, 0)))
    return after, tree, place - at


TREE = [("n_tokens", T.LongType(), pa.int64()), ("tree_chars", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
        ("tree_tokens", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))]
EDITED = [("new_text", T.StringType(), pa.string()), ("encoded_chars", T.LongType(), pa.int64())]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    start, held = 0, 0
    for i, n in enumerate(pc.utf8_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= CHUNK_CHARS:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def with_columns(df: DataFrame, new: list[tuple], row_of, text_col: str, *inputs: str) -> DataFrame:
    """All other columns of df plus new ones, computed per row from the text and the inputs."""
    made = {name for name, _, _ in new}
    read = [text_col, *inputs]
    kept = [c for c in df.columns if c not in made]
    extra = [c for c in read if c in made]
    source = df.select(*kept, *extra)
    at = [source.columns.index(c) for c in read]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = row_of()
        for batch in batches:
            for part in slices(batch, at[0]):
                rows = [row(*values) for values in zip(*(part.column(i).to_pylist() for i in at))]
                columns = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), new)]
                yield pa.RecordBatch.from_arrays(part.columns[:len(kept)] + columns, kept + [n for n, _, _ in new])

    return source.mapInArrow(run, T.StructType(df.select(*kept).schema.fields + [T.StructField(n, t) for n, t, _ in new]))


def count_tokens(docs: DataFrame, ranks: bytes, text_col: str = "text") -> DataFrame:
    """All columns plus n_tokens and the document's tree."""

    def row_of():
        counter = worker_counter(ranks)

        def row(text):
            tree = build_tree(text or "", counter)
            return tree.tokens[1], tree.chars, tree.tokens
        return row

    return with_columns(docs, TREE, row_of, text_col)


def apply_edits(counted: DataFrame, ranks: bytes, text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Counted documents after their edits: trees and n_tokens brought up to date, new_text, and encoded_chars."""

    def row_of():
        counter = worker_counter(ranks)

        def row(text, edits, chars, tokens):
            asked = [(e["start"], e["end"], e["text"] or "") for e in edits or ()]
            text, tree, again = edited(text or "", Tree(list(chars), list(tokens)), asked, counter)
            return tree.tokens[1], tree.chars, tree.tokens, text, again
        return row

    return with_columns(counted, TREE + EDITED, row_of, text_col, edits_col, "tree_chars", "tree_tokens")
