"""Reading the tables, and cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []
_SCRATCH = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only one process that is driver and executor in one (local
    mode) may do without it, in a temporary folder; a cluster without the setting is refused, for each executor would
    write to a disk of its own and what is read back would be incomplete."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-docloom-"))
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if (paths := getattr(_SCRATCH, "paths", None)) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize writes within, in this thread, is removed at the end: a stream would pile it up batch by batch."""
    outer, _SCRATCH.paths = getattr(_SCRATCH, "paths", None), []
    try:
        yield
    finally:
        paths, _SCRATCH.paths = _SCRATCH.paths, outer
        for path in paths:
            remove(spark, path)


def _found(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _found(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _found(spark, path)
    fs.delete(p, True)


def clear_materialized(spark: SparkSession) -> None:
    """Remove all that this application's materialize and streams have written; results that still read it must be written
    out before. What other applications keep in the same shared folder stays."""
    remove(spark, own_dir(spark))


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB: on disk, not in the executors' heaps."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def stream_source(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """Folder and options by which the file stream source reads a table that is one file or a folder of files."""
    fs, p = _found(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return p.getParent().toString(), {"pathGlobFilter": p.getName()}
    return path, {}


def blank_to_null(col) -> F.Column:
    """Null for texts that are null or hold white space only, else the stripped text."""
    return F.nullif(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), F.lit(""))
