"""From raw documents to packed batches: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import exact_dedup, language, ngram_join, packing, suffix_dedup
from ledgerloom.llm.common import table
from ledgerloom.sources.scratch import release, stored, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language stands out."""
    return language.drop_unknown(docs, language.learn(docs))


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles (five words, similarity 0.8), the one with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that occur again; n_chars follows the text."""
    return suffix_dedup.cut_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document that is left."""
    return packing.pack(docs)


_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The stage, after deleting what earlier stages stored for themselves and ``docs`` does not read."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _left else []
        release(spark, [f for f in _left if f in stored() and not any(f.rsplit("/", 1)[1] in x for x in files)])
        before = set(stored())
        out = stage(spark, docs, sf_dir)
        _left[:] = [f for f in stored() if f not in before]
        return out

    return run_stage


STAGES = [("language", known_language), ("exact_dedup", one_of_each_text), ("ngram_join", one_of_each_group),
          ("suffix_dedup", without_repeats), ("packing", packed)]
STAGES = [(name, tidy(stage)) for name, stage in STAGES]

#: Compression sizes, suffix arrays and the choice of bucket boundaries have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
