"""SentencePiece encoding that keeps the original byte span of every piece, and decoding.

Normalisation walks the compiled character map of the model: at each place the longest mapped prefix is replaced, other
characters stay, and the original byte offset of every normalised byte is recorded. Word starts then cut the normalised
text: as no piece of the vocabulary holds a word mark after another character, merges never cross them, and each
distinct word is merged once per worker by the library and then looked up. Ends of pieces, in original bytes, come from the
recorded offsets; pieces are contiguous, so a piece starts where the one before it ends.

Edge cases: null counts as empty; an empty text gives the end id alone with end offset 0. A word mark that the text
itself holds counts as a blank, as in the library. Models with user-defined pieces or a suffix word mark are refused.
Columns named like the results are replaced; other columns stay.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
CACHED_WORDS = 400_000


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 and a pool of replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.pool = blob[4 + size:]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest mapped prefix that starts at a byte."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node] if node < len(units) else 0
            if unit & ((1 << 31) | 0xFF) != raw[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & ((1 << 31) - 1)
        if found is None:
            return None
        end = self.pool.index(b"\0", found[1])
        return found[0], self.pool[found[1]:end]


class Normaliser:
    """What the model does to a text before merging, with the source of every normalised byte."""

    def __init__(self, spec, suffix_mark: bool = False) -> None:
        if suffix_mark:
            raise ValueError("a word mark at the end of words is not supported")
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = (spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                                                  spec.escape_whitespaces)

    @property
    def plain(self) -> bool:
        return self.map is None and not self.squeeze and self.escape

    def mapped(self, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(source start, source end, replacement) from left to right."""
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map else None
            if hit is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield at, at + n, raw[at:at + n]
                at += n
            else:
                yield at, at + hit[0], hit[1]
                at += hit[0]

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """Normalised text and, per normalised byte and one past them, the original byte offset."""
        raw = text.encode("utf-8", "surrogatepass")
        mark = MARK.encode() if self.escape else b" "
        parts = list(self.mapped(raw))
        if self.squeeze:
            while parts and parts[0][2].strip(b" ") == b"":
                parts.pop(0)
        out, source = bytearray(), []
        if not parts:
            return "", [0]
        if self.prefix:
            out += mark
            source += [parts[0][0]] * len(mark)
        blank = self.squeeze
        for start, end, new in parts:
            if blank and self.squeeze:
                new = new.lstrip(b" ")
            if not new:
                continue
            blank = new.endswith(b" ")
            copied = new == raw[start:end]
            for i, byte in enumerate(new):
                if byte == 0x20:
                    out += mark
                    source += [start] * len(mark)
                else:
                    out.append(byte)
                    source.append(start + i if copied else start)
        end = len(raw)
        if self.squeeze:
            while out.endswith(mark):
                end = source[len(out) - len(mark)]
                del source[len(out) - len(mark):]
                del out[len(out) - len(mark):]
        return out.decode("utf-8", "surrogatepass"), source + [end]


class Encoder:
    """Encodes texts with one model; keeps the pieces of the words it has met, as long as they are not too many."""

    def __init__(self, model: bytes, cached_words: int = CACHED_WORDS) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.normalise = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        # Words come here normalised: the library must not touch them again.
        proto.normalizer_spec.precompiled_charsmap = b""
        proto.normalizer_spec.remove_extra_whitespaces = False
        proto.normalizer_spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end_id, self.unk_id = self.library.eos_id(), self.library.unk_id()
        crossing = any(p.type == p.NORMAL and MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.by_word = not crossing and proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.plain = self.by_word and self.normalise.plain and self.normalise.prefix
        byte = [p.type == p.BYTE for p in proto.pieces]
        self.normal_bytes = np.array([1 if b else len(p.piece.encode()) for p, b in zip(proto.pieces, byte)], np.int32)
        self.source_bytes = np.array([1 if b else len(p.piece.replace(MARK, " ").encode())
                                      for p, b in zip(proto.pieces, byte)], np.int32)
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.cached_words = cached_words
        self.forget()

    def forget(self) -> None:
        self.cache: dict = {}
        self.start, self.count, self.pieces = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))

    def words(self, text: str) -> tuple[list, list[int] | None]:
        """Words to look up and, where the offsets are not those of plain blanks, the source of each normalised byte.

        A word that begins with a mark is named by what follows it, another one by a pair.
        """
        if self.plain and MARK not in text:
            if not text:
                return [], None
            if "  " not in text and text[0] != " ":
                return text.split(" "), None
            normal, source = MARK + text.replace(" ", MARK), None
        else:
            normal, source = self.normalise(text)
        parts = WORD.findall(normal) if self.by_word else [normal] if normal else []
        return [w[1:] if w[0] == MARK else ("", w) for w in parts], source

    def look_up(self, words: list) -> np.ndarray:
        """Cache places of the words, after encoding those not met before."""
        fresh = list(set(words).difference(self.cache))
        if fresh and (len(self.cache) + len(fresh) > self.cached_words or len(self.pieces) > 16 * self.cached_words):
            self.forget()
            fresh = list(set(words))
        if fresh:
            found = self.library.encode([w[1] if isinstance(w, tuple) else MARK + w for w in fresh], num_threads=1)
            self.cache.update(zip(fresh, range(len(self.cache), len(self.cache) + len(fresh))))
            count = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.append(self.start, len(self.pieces) + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.pieces = np.append(self.pieces, np.fromiter(chain.from_iterable(found), np.int32, int(count.sum())))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, ends) of some texts: ids with the end id, and where each piece ends in the original bytes."""
        found = [self.words(t or "") for t in texts]
        n_words = np.fromiter((len(w) for w, _ in found), np.int64, len(found))
        at = self.look_up(list(chain.from_iterable(w for w, _ in found)))
        count = self.count[at]
        total = np.cumsum(count)
        ids = self.pieces[np.repeat(self.start[at] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        upto = np.concatenate([[0], total])[np.cumsum(n_words)]
        offsets = np.concatenate([[0], upto]) + np.arange(len(found) + 1)
        place = np.arange(len(ids)) + np.repeat(np.arange(len(found)), np.diff(np.concatenate([[0], upto])))
        out = np.full(len(ids) + len(found), self.end_id, np.int32)
        out[place] = ids
        length = np.zeros(len(out), np.int64)
        length[place] = self.source_bytes[ids]
        ends = np.cumsum(length)
        ends = ends - np.repeat(np.concatenate([[0], ends])[offsets[:-1]], np.diff(offsets))
        if self.normalise.prefix:
            ends = np.maximum(ends - 1, 0)
        for i, (words, source) in enumerate(found):
            a, b = offsets[i], offsets[i + 1] - 1
            if source is None and not self.byte_fallback and (out[a:b] == self.unk_id).any():
                source = self.normalise(texts[i])[1]
            if source is not None and words:
                ends[a:b] = self.aligned(words, out[a:b], source)
                ends[b] = ends[b - 1]
        return offsets.astype(np.int32), out, ends.astype(np.int32)

    def aligned(self, words: list, ids: np.ndarray, source: list[int]) -> np.ndarray:
        """Ends through the recorded offsets; a piece outside the vocabulary spans what the library says it spans."""
        if self.byte_fallback or not (ids == self.unk_id).any():
            at = np.cumsum(self.normal_bytes[ids])
        else:
            normal = "".join(w[1] if isinstance(w, tuple) else MARK + w for w in words)
            at = [len(normal[:p.end].encode()) for p in self.library.encode(normal, out_type="immutable_proto").pieces]
        return np.array(source, np.int64)[at]


def worker_encoder(model: bytes) -> Encoder:
    """One encoder per worker process and model, so that the next tasks find the words already met."""
    kept = sys.modules.setdefault("_ledgerloom_worker", types.ModuleType("_ledgerloom_worker")).__dict__
    name = f"pieces {hashlib.sha256(model).hexdigest()}"
    if name not in kept:
        kept[name] = Encoder(model)
    return kept[name]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


CHUNK_BYTES = 1 << 20


def chunks(batch: pa.RecordBatch, sizes: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose sizes add up to about CHUNK_BYTES, so that Python holds little at a time."""
    start, held = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        held += n or 0
        if held >= CHUNK_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def id_lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column, null ones as empty ones."""
    if column.null_count or column.values.null_count:
        yield from (x or [] for x in column.to_pylist())
        return
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield values[a:b].tolist()


def _others(df: DataFrame, *new: str) -> list[str]:
    return [c for c in df.columns if c not in new]


def encode(df: DataFrame, model: bytes, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """All columns plus ids (with the end id) and, if asked for, ends: per id the end of its span in original bytes."""
    kept = _others(df, "ids", "ends")
    at = kept.index(text_col)
    new = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [
        T.StructField("ends", T.ArrayType(T.IntegerType()))] * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model)
        for batch in batches:
            for part in chunks(batch, pc.binary_length(batch.column(at))):
                starts, *found = encoder.encode(part.column(at).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x)) for x in found[:len(new)]]
                yield pa.RecordBatch.from_arrays(part.columns + lists, kept + [f.name for f in new])

    return df.select(*kept).mapInArrow(run, T.StructType(df.select(*kept).schema.fields + new))


def decode(df: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """All columns plus decoded: the text of the ids; null ids give an empty text."""
    kept = _others(df, "decoded")
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            for part in chunks(batch, pc.multiply(pc.list_value_length(batch.column(at)), 4)):
                texts = [library.decode(x) if x else "" for x in id_lists(part.column(at))]
                yield pa.RecordBatch.from_arrays(part.columns + [pa.array(texts, pa.string())], kept + ["decoded"])

    return df.select(*kept).mapInArrow(run, T.StructType(
        df.select(*kept).schema.fields + [T.StructField("decoded", T.StringType())]))
