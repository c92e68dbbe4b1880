"""Small files beside a table's data that say which of it counts: a commit is one file that is made once and never changed."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


#: A claim of this age without its file belongs to a writer that was lost; making the file takes far less than that.
ABANDONED_MS = 600_000


class Conflict(Exception):
    """Another writer has taken the version."""


class Files:
    """Small files in any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file with these contents at once; a ``Conflict`` if there is one already."""
        made = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(made, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # The name is claimed by a file of its own, as not every file system refuses to rename onto a file.
        if self._abandoned(name):
            self.delete(f"{name}.claim")
        try:
            self.fs.create(self.path(f"{name}.claim"), False).close()
        except Exception as e:
            self.fs.delete(made, False)
            raise Conflict(name) from e
        if not self.fs.rename(made, self.path(name)):
            raise OSError(f"{name} was not renamed")

    def _abandoned(self, name: str) -> bool:
        """Whether a writer claimed a name long ago and was lost before it made the file."""
        claim = self.path(f"{name}.claim")
        if self.fs.exists(self.path(name)) or not self.fs.exists(claim):
            return False
        return self.fs.getFileStatus(claim).getModificationTime() < time.time() * 1000 - ABANDONED_MS

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
