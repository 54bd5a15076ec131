"""Small files and folders on any Hadoop file system, and scratch space shared by executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    """File operations of the driver, through the file systems that Spark itself uses."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def mkdirs(self, path: str) -> None:
        fs, target = self._at(path)
        fs.mkdirs(target)

    def delete(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)

    def names(self, path: str) -> list[str]:
        fs, target = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def read(self, path: str) -> bytes:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Write all or nothing: a temporary file replaces what is there in one step when it is whole."""
        fs, target = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(part, True)
        stream.write(bytearray(data))
        stream.close()
        jvm = self.jvm.org.apache.hadoop.fs
        options = self.gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        jvm.FileContext.getFileContext(target.toUri(), self.conf).rename(part, target, options)

    def move(self, path: str, to: str) -> None:
        """Move a file or folder to a place that is free."""
        fs, target = self._at(path)
        if not fs.rename(target, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} can't be moved to {to}")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a local session without one gets its own folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        Files(spark).delete(path)
