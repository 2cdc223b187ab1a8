"""Where intermediate tables go: the shared folder the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
        or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Store a frame several branches read, so that none of them recomputes its lineage.

    The copy is a table on shared storage and survives the loss of executors. A checkpoint would compute the last stage
    twice, take several times the space, and keep the shuffles that made it.
    """
    return written(df, "cut", compression="zstd")


#: Compressed input a shuffle partition stands for, and the shuffled bytes that adaptive execution joins into one.
INPUT_BYTES_PER_PARTITION = 4 << 20
SHUFFLE_BYTES_PER_PARTITION = 16 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_SIZED: dict[tuple[str, str], str] = {}


def size_shuffles(inputs: list[DataFrame]) -> None:
    """Let shuffles begin with as many partitions as the files of ``inputs`` ask for.

    A fixed number makes each partition grow with the input until its sort spills. Adaptive execution joins small
    partitions again, so a small input pays nothing for it. Settings that somebody else made stay as they are.
    """
    spark = inputs[0].sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for df in inputs for f in df.inputFiles()]
    total = sum(p.getFileSystem(hadoop).getFileStatus(p).getLen() for p in paths)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for key, value in ((INITIAL_PARTITIONS, str(max(least, -(-total // INPUT_BYTES_PER_PARTITION)))),
                       (ADVISORY_BYTES, str(SHUFFLE_BYTES_PER_PARTITION))):
        slot = (spark.sparkContext.applicationId, key)
        if slot not in _SIZED and _is_set(spark, key) or slot in _SIZED and spark.conf.get(key, None) != _SIZED[slot]:
            continue
        spark.conf.set(key, value)
        _SIZED[slot] = value


def _is_set(spark: SparkSession, key: str) -> bool:
    return spark._jsparkSession.sessionState().conf().contains(key)


_STORED: list[str] = []


#: Once a table is stored, the shuffles that made it are of no use; this deletes them when its write ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Store a frame as a parquet table and read it back with column pruning and pushdown."""
    conf = df.sparkSession.conf
    folder = f"{shared_folder(df.sparkSession)}/ledgerloom/{uuid.uuid4().hex}"
    _STORED.append(folder)
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(f"{folder}/{name}", compression=compression)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def stored() -> list[str]:
    """Folders of the tables this process has stored and not released, oldest first."""
    return list(_STORED)


def release(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete stored tables, all of them by default; frames that read them are of no use afterwards."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in stored() if folders is None else folders:
        _STORED.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def passing(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Store what ``make`` lays out, then delete the tables it stored on the way; nothing else may read those."""
    before = set(stored())
    df = make()
    between = [f for f in stored() if f not in before]
    out = written(df, name, compression="zstd")
    release(df.sparkSession, between)
    return out
