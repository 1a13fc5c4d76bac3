"""Folders of any store that Spark writes to, by its own file system classes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder, with the few operations that are atomic there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm, self.path = spark, spark._jvm, path
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing where there is none."""
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.has(name) else []

    def claim(self, name: str) -> bool:
        """Create an empty file; False if it is there already. One of several writers gets True."""
        try:
            self.fs.create(self._path(name), False).close()
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(name), self._path(to)):
            raise RuntimeError(f"{self.path}/{name} could not be moved to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def escaped(self, value: str) -> str:
        """A value as Spark writes it in the name of a partition's folder."""
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def unescaped(self, value: str) -> str:
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value)


def fresh(name: str) -> str:
    """A name that no other writer takes."""
    return f"{name}-{uuid.uuid4().hex}"
