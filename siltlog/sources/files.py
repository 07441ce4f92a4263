"""Small files and renames on whatever file system a path names, through Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one already."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        """Move to a name that nothing has; False if it is taken."""
        return not self.exists(new) and self.fs.rename(self._path(old), self._path(new))

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)

    def copy(self, name: str, to: Files, new: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(name), to.fs, to._path(new), False, self.conf)

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def free(self) -> int:
        return self.fs.getStatus().getRemaining()
