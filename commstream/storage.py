"""Tables that cut lineage, written to the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only in local mode, where one machine runs all, a folder of
this process is used if that is unset; on a cluster the setting must name shared storage.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffles of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
#: Threads that write in each session, and its own value of _CLEANUP.
_WRITERS: dict[str, tuple[int, str | None]] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or in local mode one of this process if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="commstream-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


@contextlib.contextmanager
def _cleaning(spark: SparkSession):
    """_CLEANUP on; the session's own value comes back when the last of its threads that write has ended."""
    name = spark._jsparkSession.sessionUUID()
    with _LOCK:
        writers, before = _WRITERS.get(name) or (0, spark.conf.get(_CLEANUP, None))
        _WRITERS[name] = writers + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _WRITERS.pop(name)
            if writers > 1:
                _WRITERS[name] = writers - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: survives lost executors, has no lineage.

    The shuffles of the write are deleted when it ends, as nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/commstream-{uuid.uuid4().hex}"
    with _cleaning(spark):
        (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    _MADE.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.materialized_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned; nothing may read them any more, later lazy reads included."""
    for table in tables:
        _MADE.remove((table.sparkSession, table.materialized_at))
        _delete(table.sparkSession, table.materialized_at)


def drop_materialized() -> None:
    """Delete every table that materialize() wrote in this process; called at exit as well."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            return


atexit.register(drop_materialized)
