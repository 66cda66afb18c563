"""Names, renames and small texts in whatever store holds a path, by Hadoop's file system on the driver. Data go through Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """The store of a path. Every method takes full paths."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """What lies right below a folder, without hidden names; nothing if it isn't there."""
        p = self._path(folder)
        if not self._fs.exists(p):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(p)) if n[0] not in "._")

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make_folder(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def move(self, source: str, target: str) -> bool:
        """Renames source, whose success is told: of several callers one has it. The target must not be there."""
        a, b = self._path(source), self._path(target)
        if self._fs.exists(b) or not self._fs.exists(a):
            return False
        self._fs.mkdirs(b.getParent())
        try:
            return self._fs.rename(a, b)
        except self._jvm.java.io.FileNotFoundException:
            return False

    def write(self, path: str, text: str) -> None:
        """A small text, which readers see whole or not at all: it is written beside, and renamed over what was there."""
        target = self._path(path)
        aside = self._path(f"{path.rsplit('/', 1)[0]}/.{self._jvm.java.util.UUID.randomUUID()}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        over = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(over.getClass(), 1)
        options[0] = over
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), options)

    def read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
