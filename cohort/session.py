"""Session settings and the written tables that cut long lineages."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}
_RECORDERS: list[list[DataFrame]] = []
#: State of streams in RocksDB: maps and timers need it, and large state stays out of the heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def build_session(app: str = "cohort", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the operators expect; anything can be overridden."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_STORE[0]: STATE_STORE[1],
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session may leave it unset and then gets a temporary folder; on a cluster a
    machine-local folder would not outlive an executor, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="cohort-")
    return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    application = spark.sparkContext.applicationId
    return f"{scratch_folder(spark)}/cohort/{application}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer true sizes, so that it
    only broadcasts what it has measured.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    for tables in _RECORDERS:
        tables.append(table)
    return table


def written_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what ``build`` returns, then delete all tables that it has written on the way."""
    tables: list[DataFrame] = []
    _RECORDERS.append(tables)
    try:
        out = written(build(), name)
    finally:
        _RECORDERS[:] = [t for t in _RECORDERS if t is not tables]
    release(*(t for t in tables if t is not out))
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out evenly when the input has fewer splits than there are cores.

    A small table in one file would leave all costly per-row work to one task.  Large inputs
    have more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
