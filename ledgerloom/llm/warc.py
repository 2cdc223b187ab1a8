"""Dictionary-compressed web archives: written, and read back.

An archive is a file of Zstandard frames: first a skippable frame that holds the dictionary, then one frame per record,
so that any record can be read alone. The dictionary is built from a bounded number of the records to be archived. Each
map task writes archives of about ``archive_bytes`` into the shared folder under names no other attempt uses, and returns
one manifest row per archive; only archives of the written manifest are read, so a task that was lost or ran twice leaves
no record behind or doubled. Equal payloads of ``min_revisit_bytes`` or more are stored once, as response of the smallest
id; the others become revisit records that name it.

Edge cases: null html counts as empty; such and all other small payloads are responses. A null url becomes an empty
target. No pages give no archives and no rows. Extra columns are ignored. Every row becomes a record, also where page ids
are null or shared: of repeated rows the first is the response and the others revisit it under the same page id. A null id
comes after all others, is left out of the record's head and read back as null.
"""

from __future__ import annotations

import hashlib
import io
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.rowkeys import keyed_rows
from ledgerloom.sources.scratch import shared_folder, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the archive format.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2000-01-01T00:00:00Z"

ARCHIVE_BYTES = 48 << 20
DICT_BYTES = 112 << 10
DICT_RECORDS = 1000
DICT_RECORD_BYTES = 16 << 10
LEVEL = 3
MIN_REVISIT_BYTES = 100
MANIFEST_DDL = "archive string, records long, bytes long"
RECORD_DDL = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
              "payload binary")


def record_id(record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{record}')}>"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None,
                 record: int | None = None, revisits: int | None = None) -> bytes:
    """One record: head, block (none for a revisit) and the two closing line ends.

    ``record`` and ``revisits`` name this record and the one it revisits where page ids cannot; an id that is null is
    left out.
    """
    record, revisits = page_id if record is None else record, refers_to if revisits is None else revisits
    head = [VERSION, f"WARC-Type: {'response' if revisits is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(record)}", f"WARC-Date: {RECORD_DATE}",
            f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    head += [f"X-Payload-Length: {len(payload)}"]
    block = payload
    if revisits is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(revisits)}"]
        head += [] if refers_to is None else [f"X-Refers-To-Page-ID: {refers_to}"]
        block = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple:
    """Row of a record; what a revisit does not hold (its payload) is null."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not an archive record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length and content differ")
    kind = fields["WARC-Type"]
    payload = rest[:n] if kind == "response" else None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if payload is not None:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if digest != fields["WARC-Payload-Digest"].removeprefix("sha256:"):
            raise ValueError("payload and digest differ")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    return (None if page is None else int(page), fields["WARC-Target-URI"], kind, digest, size,
            None if refers is None else int(refers), payload)


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return SKIPPABLE_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def dictionary_of(archive: bytes) -> tuple[bytes, int]:
    """Dictionary of an archive and the offset of its first record."""
    if int.from_bytes(archive[:4], "little") != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    end = 8 + int.from_bytes(archive[4:8], "little")
    return zstandard.ZstdDecompressor().decompress(archive[8:end]), end


def train_dictionary(samples: list[bytes], dict_bytes: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or for too few or too uniform records their bytes as raw content."""
    try:
        return zstandard.train_dictionary(dict_bytes, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples)[:dict_bytes] or VERSION.encode()).rjust(8, b" ")


def with_references(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id",
                    payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload, digest, refers_to, record and revisits of the record to write; only keys meet in the aggregation.

    ``record`` is the page id, or a key in the order of page ids where these are null or shared.
    """
    keyed = keyed_rows(pages.select(id_col, url_col, payload_col), id_col, F.xxhash64(payload_col, url_col))
    key, pages = (F.col(id_col), pages) if keyed is None else (F.col("__row_key"), keyed.select(
        F.col("key").alias("__row_key"), "of.*"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.coalesce(F.col(url_col), F.lit("")).cast("string").alias("url"),
                        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
                        key.cast("long").alias("record")).withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= min_revisit_bytes
    first = rows.where(long_enough).groupBy("digest").agg(
        F.min(F.struct("record", "page_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = long_enough & (F.col("first.record") < F.col("record"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(again, F.col("first.page_id")).alias("refers_to"), "record",
        F.when(again, F.col("first.record")).alias("revisits"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES,
                   dict_records: int = DICT_RECORDS, **how) -> DataFrame:
    """Write the archives and return their manifest (archive, records, bytes), itself a written table."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archives/{uuid.uuid4().hex}"
    records = with_references(pages, **how)
    html = how.get("payload_col", "html")
    # A share of the pages by hash, about twice the wanted number however many pages there are.
    share = min(1.0, 2 * dict_records / max(1, pages.count()))
    h = F.pmod(F.xxhash64(html), F.lit(1 << 30))
    picked = pages.where(F.col(html).isNotNull() & (h < int(share * (1 << 30)))).select(
        F.xxhash64(html).alias("h"), F.encode(F.substring(html, 1, DICT_RECORD_BYTES), "UTF-8").alias("s"))
    samples = [bytes(s) for _, s in sorted(map(tuple, picked.dropDuplicates(["h"]).limit(2 * dict_records).collect()))]
    dictionary = train_dictionary([record_bytes(i, "http://", s, "0" * 64, None) for i, s in enumerate(samples[:dict_records])])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        out, done = None, []
        for batch in batches:
            for columns in zip(*(batch.column(i) for i in range(7))):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, n, size = fs.open_output_stream(name, compression=None), 0, 0
                    out.write(frame := dictionary_frame(dictionary))
                    size += len(frame)
                out.write(frame := coder.compress(record_bytes(*(c.as_py() for c in columns))))
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    done.append((name.rsplit("/", 1)[1], n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name.rsplit("/", 1)[1], n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "records", "bytes"])

    manifest = written(records.mapInArrow(write, MANIFEST_DDL), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, given as URI or as local path."""
    return pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame, under the dictionary it carries."""
    dictionary, at = dictionary_of(archive)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    view = memoryview(archive)
    while at < len(archive):
        one = reader.decompressobj()
        record, step = io.BytesIO(), 1 << 16
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the archive ends inside a record")
            part = view[at:at + step]
            record.write(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield record.getvalue()


def read_archives(spark: SparkSession, manifest: DataFrame, max_tasks: int = 10_000) -> DataFrame:
    """The records of the archives in the manifest, with payloads where they are stored; a task reads whole archives."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for archive, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, root = file_system(folder)
                with fs.open_input_file(f"{root}/{archive}") as f:
                    content = f.read()
                rows, held = [], 0
                for record in frames(content):
                    rows.append(parsed(record))
                    held += len(record)
                    if held >= 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    listed = manifest.select("archive", "folder").repartition(max(1, min(max_tasks, manifest.count())))
    return listed.mapInArrow(read, RECORD_DDL)


def read_record(folder: str, archive: str, offset: int, length: int) -> tuple:
    """One record by the place of its frame, without reading the rest."""
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{archive}") as f:
        head = f.read(8)
        dictionary, _ = dictionary_of(head + f.read(int.from_bytes(head[4:8], "little")))
        f.seek(offset)
        frame = f.read(length)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
    return parsed(reader.decompress(frame))
