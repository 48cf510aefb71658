"""Small files and folders of an index, by Hadoop's file system API so that any store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.path(*parts)))

    def make(self, *parts: str) -> None:
        """An empty folder."""
        self._fs.mkdirs(self._path(self.path(*parts)))

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self.path(*parts)), True)

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """Written beside, then renamed over: a reader sees the old text or the new one."""
        new = self._path(self.path(f"{name}.new"))
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._path(self.path(name))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, target, options)
