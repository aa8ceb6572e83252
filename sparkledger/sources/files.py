"""Small files of a table, on any file system that Spark's Hadoop configuration reaches."""

from __future__ import annotations

from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .errors import Conflict, InputOutput


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root = root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        with self._told("open the file system"):
            self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @contextmanager
    def _told(self, what: str):
        try:
            yield
        except Py4JJavaError as e:
            raise InputOutput(f"could not {what} below {self.root}") from e

    def at(self, name: str = ""):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        with self._told(f"look for {name}"):
            return self._fs.exists(self.at(name))

    def make(self, name: str) -> None:
        with self._told(f"make {name}"):
            self._fs.mkdirs(self.at(name))

    def list(self, name: str = "") -> dict[str, tuple[bool, int, float]]:
        """Name: (whether it is a folder, bytes, seconds since 1970 when it was last changed)."""
        if not self.exists(name):
            return {}
        with self._told(f"list {name}"):
            found = list(self._fs.listStatus(self.at(name)))
        return {s.getPath().getName(): (s.isDirectory(), s.getLen(), s.getModificationTime() / 1000) for s in found if not s.getPath().getName().startswith(".")}

    def size(self, name: str) -> int:
        with self._told(f"measure {name}"):
            return self._fs.getContentSummary(self.at(name)).getLength() if self._fs.exists(self.at(name)) else 0

    def read(self, name: str) -> bytes:
        with self._told(f"read {name}"):
            stream = self._fs.open(self.at(name))
            try:
                return bytes(stream.readAllBytes())
            finally:
                stream.close()

    def create(self, name: str, data: bytes, replace: bool = False) -> None:
        """Writes a file and syncs it; without replace, an existing one is a conflict."""
        if not replace and self.exists(name):
            raise Conflict(f"{name} is there already")
        with self._told(f"write {name}"):
            out = self._fs.create(self.at(name), replace)
            try:
                out.write(bytearray(data))
                out.hsync()
            finally:
                out.close()

    def delete(self, name: str) -> None:
        with self._told(f"delete {name}"):
            self._fs.delete(self.at(name), True)
