"""Small files and folders through Hadoop's file system, so the same paths serve one machine and a cluster."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


class HadoopFiles:
    """Text files by path or URI; paths without a scheme are those of the session's default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def folders(self, path: str) -> list[str]:
        """Names of what lies in a folder; none where it does not exist."""
        p, fs = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def read_text(self, path: str) -> str | None:
        """The whole file, or None where there is none."""
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_over(self, old: str, new: str) -> None:
        """Move a file or folder to a place that may be taken; one step where the file system has it."""
        a, _ = self._at(old)
        b, fs = self._at(new)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        context.rename(a, b, options)

    def replace_text(self, path: str, text: str) -> None:
        """A reader finds the old text or the new one: written beside, then renamed."""
        spare = f"{path}.{uuid.uuid4().hex}.new"
        self.write_text(spare, text)
        self.rename_over(spare, path)

