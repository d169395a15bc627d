"""Small files and folders under a base path, on any file system Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self._conf), where

    def exists(self, name: str = "") -> bool:
        fs, where = self._at(name)
        return fs.exists(where)

    def names(self, name: str = "") -> list[str]:
        """Names in a folder; none if it doesn't exist."""
        fs, where = self._at(name)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def read(self, name: str) -> str:
        fs, where = self._at(name)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """A file that didn't exist, all of it or nothing: written aside, then renamed; raises if it exists by then."""
        fs, where = self._at(name)
        aside = self._at(f"{name}.{uuid.uuid4().hex}")[1]
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self._conf).rename(fs.makeQualified(aside), fs.makeQualified(where), options)
        except Exception:
            fs.delete(aside, False)
            raise

    def rename(self, name: str, to: str) -> None:
        fs, where = self._at(name)
        if not fs.rename(where, self._at(to)[1]):
            raise OSError(f"{name} can't be renamed to {to}")

    def delete(self, name: str = "") -> None:
        fs, where = self._at(name)
        fs.delete(where, True)
