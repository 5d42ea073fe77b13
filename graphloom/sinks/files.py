"""Files and folders on whatever file system a path names, through Hadoop's interface: local disks, HDFS, object stores."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Plain operations on paths; a path without a scheme is on the session's default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def rename(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"can't move {path} to {to}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder, in order."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength()

    def modified(self, path: str) -> float | None:
        """Seconds since the epoch; None if there is no such file."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None
