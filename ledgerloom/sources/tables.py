"""Readers for the engine's inputs and writers for its outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.sources import schemas
from ledgerloom.sources.scratch import written

RAW = "_unreadable"


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_checked(spark: SparkSession, path: str, schema: str, fmt: str = "parquet",
                 required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Whole rows of a source, and (source, reason, record) of those that are not.

    A csv or json record that does not fit the schema (a value of another type, too few or too many fields) is
    'unreadable' and kept as it stands; a row without a required value is kept as json. No record gets lost
    and none enters a run as nulls. Text sources are parsed once, into a stored table, as their reader
    only notices a broken record when it reads all of its fields.
    """
    texts = fmt in ("csv", "json")
    reader = spark.read.schema(f"{schema}, {RAW} string" if texts else schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).format(fmt).load(path)
    rows = rows.withColumn("_source", F.col("_metadata.file_path"))
    rows = written(rows, "checked") if texts else rows.withColumn(RAW, F.lit(None).cast("string"))
    names = [c for c in rows.columns if c not in (RAW, "_source")]
    reason = F.coalesce(F.when(F.col(RAW).isNotNull(), F.lit("unreadable")),
                        *[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in required])
    broken = rows.where(reason.isNotNull()).select(
        F.col("_source").alias("source"), reason.alias("reason"),
        F.coalesce(RAW, F.to_json(F.struct(*names))).alias("record"))
    return rows.where(reason.isNull()).select(*names), broken


def quarantine(broken: DataFrame, path: str) -> None:
    """Add the rows a reader turned away to a table, one folder per reason."""
    broken.write.mode("append").partitionBy("reason").parquet(path)


def read_ledger_checked(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """``read_ledger``, with broken rows and those without a row number set aside."""
    return read_checked(spark, path, schemas.LEDGER_RAW, fmt, ("row_no",))


def read_vendors_checked(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    return read_checked(spark, path, schemas.VENDOR, fmt, ("vendor",))


def read_second_reader_checked(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    return read_checked(spark, path, schemas.SECOND_READER, fmt, ("doc_id",))


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw ledger rows. ``row_no`` is the row's own number in its source and must be a column."""
    return _read(spark, path, schemas.LEDGER_RAW, fmt)


def read_vendors(spark: SparkSession, path: str | None, fmt: str = "parquet") -> DataFrame:
    """Vendor list; without one, every supplier simply keeps its own name."""
    if path is None:
        return spark.createDataFrame([], schemas.VENDOR)
    return _read(spark, path, schemas.VENDOR, fmt)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.PAGE, fmt)


def read_second_reader(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.SECOND_READER, fmt)


def list_invoice_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the invoice files of a folder, with a sortable name; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
            .select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file")))


def file_kind(path: Column) -> Column:
    """'ledger', 'invoice' or NULL, by file extension."""
    name = F.lower(path)
    return (F.when(name.rlike(r"\.(xlsx|xlsm)$"), F.lit("ledger"))
            .when(name.rlike(r"\.pdf$"), F.lit("invoice")))
