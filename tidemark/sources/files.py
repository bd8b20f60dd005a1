"""Files of the shared folder, by the file system that their path names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modificationTime) of the Parquet files at ``paths``, files or folders; nothing in them is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")


def identity(spark: SparkSession, paths: list[str]) -> str:
    """What tells one state of the files at ``paths`` from another: their number, bytes, and two sums of hashes of path, length and time."""
    of = lambda seed: F.xxhash64(F.lit(seed), "path", "length", "modificationTime").cast("decimal(38,0)")
    files = listed(spark, paths)
    n, size, a, b = files.agg(F.count("*"), F.sum("length"), F.sum(of(1)), F.sum(of(2))).first()
    return f"{n}-{size or 0}-{int(a or 0) % (1 << 64):016x}{int(b or 0) % (1 << 64):016x}"


class Folder:
    """A folder whose files come and go whole: what is put there is written beside and renamed."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.spark = path, spark
        self._of = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._of.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[tuple[str, int]]:
        """Names in the folder, each with its time in milliseconds; none where there is no folder."""
        if not self._fs.exists(self._at("")):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._at(""))]

    def read(self, name: str) -> str | None:
        """The text of a file; None where there is none."""
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str, beside: str) -> bool:
        """Write a file by way of ``beside``; false, with nothing changed, if it is there already."""
        stream = self._fs.create(self._at(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.exists(self._at(name)) and self._fs.rename(self._at(beside), self._at(name)):
            return True
        self._fs.delete(self._at(beside), False)
        return False

    def drop(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
