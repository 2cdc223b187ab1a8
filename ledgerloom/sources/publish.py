"""Results of a run published as a whole: tables are staged, then one manifest that names them appears.

A reader sees the tables of the newest manifest and nothing else, so a run that breaks between two tables
leaves the earlier one readable, and a run that is repeated under its own id is published once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from ledgerloom.sources import sinks

PREFIX, SUFFIX = "manifest-", ".json"


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests of a folder, oldest first; there is one small file for each run kept."""
    fs, path = _path(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[len(PREFIX):-len(SUFFIX)]) for n in names if n.startswith(PREFIX) and n.endswith(SUFFIX))


def _manifest(folder: str, number: int) -> str:
    return f"{folder}/{PREFIX}{number:010d}{SUFFIX}"


def _read(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(spark.read.text(_manifest(folder, number), wholetext=True).first()[0])


def _announce(spark: SparkSession, folder: str, content: dict) -> None:
    """Write the manifest aside and rename it to the next free number, so that no reader sees half of it."""
    fs, aside = _path(spark, f"{folder}/_{content['run_id']}{SUFFIX}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(content, indent=1), "utf-8"))
    out.close()
    while True:
        _, place = _path(spark, _manifest(folder, max(_numbers(spark, folder), default=0) + 1))
        if not fs.exists(place) and fs.rename(aside, place):
            return


def publish(tables: dict[str, DataFrame], folder: str, run_id: str | None = None,
            partitions: dict[str, str] | None = None) -> dict:
    """Store the frames as parquet below ``folder`` and make them the current run; returns the manifest.

    ``partitions`` names the column a table is split by. With the id of a run that is already published nothing
    is written; with the id of one that broke, its staged tables are replaced. Runs of one folder should be
    published one after the other where the file system lets a rename replace a file, as a local one does.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, run_id = folder.rstrip("/"), run_id or uuid.uuid4().hex
    for number in reversed(_numbers(spark, folder)):
        earlier = _read(spark, folder, number)
        if earlier["run_id"] == run_id:
            return earlier
    stored = {}
    for name, df in tables.items():
        path = f"runs/{run_id}/{name}"
        by = [c for c in [(partitions or {}).get(name)] if c]
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{path}")
        stored[name] = {"path": path, "schema": json.loads(df.schema.json()),
                        "rows": spark.read.schema(df.schema).parquet(f"{folder}/{path}").count()}
    content = {"run_id": run_id, "tables": stored}
    _announce(spark, folder, content)
    return content


def publish_run(run: dict[str, DataFrame], payables: DataFrame, folder: str, run_id: str | None = None) -> dict:
    """Outcome sheets, superseded invoices, pending rows and payables of a reconciliation, with printed names."""
    return publish({
        "outcome": sinks.outcome_sheet(run["outcome"]), "superseded": sinks.superseded_sheet(run["superseded"]),
        "pending": sinks.pending_sheet(run["pending"]), "payables": sinks.payables_sheet(payables),
    }, folder, run_id, {"outcome": "outcome"})


def read_published(spark: SparkSession, folder: str, name: str, run_id: str | None = None) -> DataFrame:
    """A table of the newest run, or of the run with that id."""
    folder = folder.rstrip("/")
    for number in reversed(_numbers(spark, folder)):
        content = _read(spark, folder, number)
        if run_id in (None, content["run_id"]):
            entry = content["tables"][name]
            schema = T.StructType.fromJson(entry["schema"])
            return spark.read.schema(schema).parquet(f"{folder}/{entry['path']}").select(
                *[f"`{c}`" for c in schema.fieldNames()])
    raise LookupError(f"no published run {run_id or ''} in {folder}")


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Withdraw all but the newest ``keep`` runs, manifest first, then tables; ids of the runs that went.

    Staged tables of runs that broke are left alone, as they cannot be told from those of a run at work.
    """
    folder, gone = folder.rstrip("/"), []
    for number in _numbers(spark, folder)[:-keep] if keep > 0 else []:
        run_id = _read(spark, folder, number)["run_id"]
        for path, deep in ((_manifest(folder, number), False), (f"{folder}/runs/{run_id}", True)):
            fs, target = _path(spark, path)
            fs.delete(target, deep)
        gone.append(run_id)
    return gone
