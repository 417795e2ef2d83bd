"""Small files next to a table: listed, read, and created only if absent."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of the store that ``root`` names, through Hadoop's file systems.

    ``create`` is what commits rest on: of several writers of one name exactly one succeeds, and no reader sees half a file.  A
    local or mounted folder does it by a hard link, any other store by a rename that refuses an existing target, which has to
    be atomic there (HDFS and its views; object stores with conditional writes).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)
        self._local = self._files.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self._hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def age(self, name: str) -> float:
        """Seconds since the last change."""
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        return (now - self._files.getFileStatus(self._path(name)).getModificationTime()) / 1000

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(self._hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether this call made the file; False if there is one already."""
        folder, _, last = name.rpartition("/")
        draft = self._path(f"{folder}/.{last}-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self._local:
                os.link(draft.toUri().getPath(), self._path(name).toUri().getPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.__getattr__("Options$Rename"), 0)
                self._hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, self._path(name), none)
            return True
        except FileExistsError:
            return False
        except Exception:
            if self._files.exists(self._path(name)):
                return False
            raise
        finally:
            self._files.delete(draft, False)

    def remove(self, name: str) -> None:
        self._files.delete(self._path(name), True)
