"""The descriptor index: immutable Parquet versions under one folder, refreshed by what has changed.

A refresh writes version-N whole (taken-over rows and new ones) and then the empty file DONE-N; the newest version that has
one counts, so readers see the old version or the new one, never a mixture, and no crash in between loses either. What is
unchanged is found by path, time and length, so a changed file of equal number is seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["path", "mtime", "length"]


def stale(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files that the index lacks or has in another version."""
    return files.join(index.select(*KEY), KEY, "left_anti")


def still_there(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select(*KEY), KEY, "left_semi")


def refreshed(files: DataFrame, index: DataFrame | None, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index for ``files``: rows that still hold, and ``build`` of those that don't."""
    if index is None:
        return build(files)
    return still_there(index.drop("ref_id"), files).unionByName(build(stale(files, index)))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        fs, path = self._fs("")
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int | None:
        return max((int(n.removeprefix("DONE-")) for n in self._names() if n.startswith("DONE-")), default=None)

    def load(self) -> DataFrame | None:
        """The rows of the newest version, with ref_id."""
        found = self.version()
        return None if found is None else self.spark.read.parquet(f"{self.root}/version-{found}")

    def publish(self, rows: DataFrame) -> int:
        """Writes the next version, numbered, then the file that makes it count. Rows are computed once: they are put in
        order from a draft."""
        new = max((int(n.rpartition("-")[2]) for n in self._names() if n.startswith(("version-", "DONE-"))), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/_draft-{new}")
        numbered(self.spark.read.schema(rows.schema).parquet(f"{self.root}/_draft-{new}")).write.mode("overwrite").parquet(f"{self.root}/version-{new}")
        fs, path = self._fs(f"DONE-{new}")
        fs.create(path, True).close()
        fs.delete(self._fs(f"_draft-{new}")[1], True)
        return new

    def refresh(self, files: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        self.publish(refreshed(files, self.load(), build))
        return self.load()


def numbered(rows: DataFrame) -> DataFrame:
    """In order of path, in ranges, with a ref_id that ascends with it (not without gaps). Ids hold once they are written."""
    return rows.repartitionByRange("path").sortWithinPartitions("path").withColumn("ref_id", F.monotonically_increasing_id())
