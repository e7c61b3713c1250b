"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only where it is unset and all runs in one process, as in tests, a temporary folder that is
    then set; on a cluster others couldn't read that."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: narrow rows of one file
ROWS = 100_000


#: where the folder is a mounted one (file:), checksum files and the modes of files are left out: each chmod there forks the
#: JVM, which then counts twice for a moment
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_roots: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes the folders of all calls so far, once nothing reads their results any more."""
    while _roots:
        _delete(spark, _roots.pop())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Folders that operator calls make inside are deleted at the end: for results that are written meanwhile."""
    before = len(_roots)
    yield
    for root in _roots[before:]:
        _delete(spark, root)
    del _roots[before:]


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: rows of text that go to Python at once, where the session has Spark's own 10,000: of whole documents those are tens of
#: megabytes, held by the JVM beside its heap and by the worker
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def _smaller_batches(spark: SparkSession) -> None:
    name, default, ours = BATCH
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, ours)


class Scratch:
    """A folder of one operator call: ``put`` writes a table and reads it back, which cuts lineage
    and survives lost executors; ``drop`` removes tables that are no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        _smaller_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``rows``: about how many narrow rows there are, where that is known; a small table is written as few files."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS)))
        df.write.mode("overwrite").options(**PLAIN).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


#: schemes that Hadoop and Arrow spell in different ways
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (a path without a scheme is local), for files that executors write themselves. Stores
    that Arrow doesn't know raise ValueError; writers ask on the driver, before any task runs."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri(f"file://{os.path.abspath(uri)}")
    if scheme == "file":
        return fs.FileSystem.from_uri("file:///" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(documents: DataFrame) -> tuple[DataFrame, str]:
    """Documents as one struct column ``row``, and its type: so no column name clashes with what an operator adds."""
    _smaller_batches(documents.sparkSession)
    rows = documents.select(F.struct("*").alias("row"))
    return rows, rows.schema["row"].dataType.simpleString()


def labelled(documents: DataFrame, labels: DataFrame, name: str, bound: int, where: str = "true") -> DataFrame:
    """Documents with column ``name`` of ``labels`` (0 or 1), thinned by a hash of doc_id to about ``bound`` rows.

    The ids and labels are broadcast: their number is bounded by ``bound``. A doc_id with differing labels is left out.
    Other columns of ``documents`` that clash with ``name`` are dropped.
    """
    sound = labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1) & F.expr(where)).groupBy("doc_id").agg(F.min(name).alias(name), F.max(name).alias("_most"))
    sound = sound.where(F.col(name) == F.col("_most")).drop("_most")
    total = sound.count()
    if total > bound:
        sound = sound.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * bound // total)
    return documents.select(*(c for c in documents.columns if c.lower() != name.lower())).join(F.broadcast(sound), "doc_id")
