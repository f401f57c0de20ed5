"""File operations of the driver, on any store that Spark's Hadoop file systems reach."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Small files and folders. Data goes through Spark's readers and writers, never through here."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def is_dir(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at) and fs.getFileStatus(at).isDirectory()

    def mode(self, path: str) -> int:
        fs, at = self._at(path)
        return fs.getFileStatus(at).getPermission().toShort()

    def mkdirs(self, path: str) -> None:
        fs, at = self._at(path)
        fs.mkdirs(at)

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def size(self, path: str) -> int:
        """Bytes of all files below a path."""
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength()

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a new file; False if there is one. Of several writers, one gets True."""
        fs, at = self._at(path)
        try:
            stream = fs.create(at, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def rename(self, path: str, to: str) -> None:
        fs, at = self._at(path)
        if not fs.rename(at, self._at(to)[1]):
            raise OSError(f"{path} can't be renamed to {to}")

    def remove(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; where that is unset and Spark runs in one
    process, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lexshard-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/lexshard/{name}-{uuid.uuid4().hex}"
