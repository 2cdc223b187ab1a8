"""Small helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.sources.scratch import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ArrowMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of fixed size over hashed ids: keeps most other rows out of a shuffle, and never a wanted one."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique((mixed(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(bits)).astype(np.int64))
            value = (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(value)], ["cell", "bits"])

    cells = ids.mapInArrow(cells_of, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in cells:
        out[r["cell"]] = r["bits"]
    return out.view(np.uint8)


def passing(batch: pa.RecordBatch, bitmap: np.ndarray) -> pa.RecordBatch:
    """Rows whose id, in the first column, passes the bitmap."""
    at = (mixed(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(len(bitmap) * 8)).astype(np.int64)
    return batch.filter(pa.array(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component_id): the smallest id reachable over the edges, for every id that has one.

    Alternates two contractions: hang the larger neighbours on the smallest one, then the smaller ones. Each round is
    two aggregations and two joins over the edges, written to the shared folder, so a hub never meets in one task.
    Rows with equal or null ends are ignored; no edges give no rows.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                .where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
