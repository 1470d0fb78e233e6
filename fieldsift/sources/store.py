"""Small driver-side file operations on whatever store holds a path.

Only names and markers of a few bytes pass through here, never data.  The operations go
through the session's Hadoop file systems, so every path that Spark can write works.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._text = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """Names directly in a folder; none if there is no such folder."""
        if not self.exists(folder):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(self._path(folder)))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a small file so that it is seen whole or not at all."""
        unseen = f"{path}.unfinished"
        stream = self._fs.create(self._path(unseen), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(self._path(unseen), self._path(path)):
            self._fs.delete(self._path(unseen), False)
            raise FileExistsError(path)
