"""Files and folders of any file system that Spark reads, for small texts and listings."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def listed(self, name: str) -> list[tuple[str, bool, int, int]]:
        """name, whether it is a folder, size and time in milliseconds of what is in a folder, by name; nothing, if it is not there."""
        at = self._path(name)
        own = self._fs.listStatus(at) if self._fs.exists(at) else []
        return sorted((s.getPath().getName(), s.isDirectory(), 0 if s.isDirectory() else s.getLen(), s.getModificationTime()) for s in own)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: under another name, then renamed."""
        hidden = f"{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(hidden), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.rename(self._path(hidden), self._path(name))

    def claim(self, name: str) -> bool:
        self._fs.mkdirs(self._path(name).getParent())
        return self._fs.createNewFile(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
