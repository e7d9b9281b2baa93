"""The few file operations a store needs, on any file system that Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of the shared file system. ``rename`` never replaces what is there."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        path, files = self._at(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def exists(self, name: str) -> bool:
        path, files = self._at(name)
        return files.exists(path)

    def rename(self, name: str, to: str) -> bool:
        """False, and nothing done, if ``to`` exists."""
        (path, files), (goal, _) = self._at(name), self._at(to)
        if files.exists(goal):
            return False
        files.mkdirs(goal.getParent())
        return files.rename(path, goal)

    def delete(self, name: str = "") -> None:
        path, files = self._at(name)
        files.delete(path, True)

    def read(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def publish(self, name: str, text: str) -> bool:
        """Write a small file under another name and rename it: it is seen whole or not at all."""
        draft = f"draft-{uuid.uuid4().hex}"
        path, files = self._at(draft)
        out = files.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.rename(draft, name):
            return True
        files.delete(path, False)
        return False
