"""Writing intermediate tables where every executor can read them."""

from __future__ import annotations

import contextlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"
#: Spark removes a query's shuffle files when it ends; what is stored is not read through them again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Parts for each of the session's shuffle partitions where rows are dealt out finer than by default.
FINER = 4

_writing, _lock = 0, threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder, or the warehouse where the session names none.

    On a cluster a warehouse on a local disk is not shared, so that is an error
    there; a session that doesn't show its context can't be judged.
    """
    if named := spark.conf.get(CHECKPOINT_DIR, None):
        return named.rstrip("/")
    path, context = spark.conf.get(WAREHOUSE_DIR), getattr(spark, "sparkContext", None)
    local = context is None or context.master == "local" or context.master.startswith("local[")
    if not local and (path.startswith("file:") or "://" not in path):
        raise ValueError(f"{path} is a local folder of the driver: set {CHECKPOINT_DIR} to one that all executors share")
    return path.rstrip("/")


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """Within, a query's shuffle files go when it ends; the session's own setting is back when the last of several threads is done."""
    global _writing
    with _lock:
        if not _writing:
            _cleaning.before = spark.conf.get(CLEAN_UP)
            spark.conf.set(CLEAN_UP, "true")
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                spark.conf.set(CLEAN_UP, _cleaning.before)


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), there


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once as Parquet in the shared folder and read back.

    This cuts the lineage and survives the loss of any executor.  The table
    stays until `forget` is called for it, or else until the driver ends, also
    where its query has failed.  A file holds a whole partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    try:
        with _cleaning(spark):
            df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    finally:
        files, there = _file_system(spark, path)
        files.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def merged(df: DataFrame) -> DataFrame:
    """`df` for a join that grows with the input: never broadcast.

    A table's size is known only as its files', and repetitive rows take a
    hundredth of their memory there, so the planner would send millions of rows
    through the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt out by keys into FINER times as many parts as the session shuffles into.

    For steps that work long on a row, since a small file is one task however
    long its rows take, and for those that hold a part in memory to sort it.
    Small parts are not put together again.
    """
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `stored` has written and that nothing reads any more."""
    for table in tables:
        files, there = _file_system(table.sparkSession, table.stored_at)
        files.delete(there, True)
        files.cancelDeleteOnExit(there)
