"""Tables and files in the folder that the driver and all executors share.

The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one process, as in
local tests, a folder of our own is made; elsewhere that is an error, as machines don't see each other's folders. Python tasks reach it through ``pyarrow.fs``, so it may be any store that pyarrow can open.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .words import tidy


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="lexshard-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    path = f"{shared_dir(spark)}/lexshard/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.add(path)
    return path


_open = threading.local()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes, and folders that new_path() names, inside are removed at the end, whatever happens, but
    for those that are kept()."""
    outer = getattr(_open, "paths", None), getattr(_open, "calls", None)
    _open.paths, _open.calls = set(), []
    try:
        yield
    finally:
        for path in _open.paths:
            remove(spark, path)
        for call in _open.calls:
            call()
        _open.paths, _open.calls = outer
        tidy()


def at_end(call: Callable[[], object]) -> None:
    """Have the innermost scratch(), if there is one, call this at its end."""
    if getattr(_open, "calls", None) is not None:
        _open.calls.append(call)


def kept(table: DataFrame) -> DataFrame:
    """A table of written() that outlives the innermost scratch(), to be removed by the one around it."""
    _open.paths.discard(table.written_to)
    return table


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with no lineage, whole whichever executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that written() made and that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that new_path() named."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished jobs that nothing refers to any more; it does so when the driver's
    garbage is collected, which may be long after."""
    spark.sparkContext._jvm.System.gc()


def open_fs(path: str):
    """(filesystem, path in it) for a path with or without a scheme; for use in tasks."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)
