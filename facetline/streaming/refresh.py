"""Image files that arrive in a folder join the index, one published version for each micro-batch.

A batch that is run again after a failure writes the same rows: paths that are already in the index in the same version
are left out, so a file is never there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..plans.image_search import described
from ..sources import images
from ..sources.index import Store, stale

BINARY = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, build: Callable[[DataFrame], DataFrame] = described, once: bool = True) -> StreamingQuery:
    """Starts a stream over ``folder``; with ``once`` it ends when all files that are there have been taken in."""
    arriving = spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = arriving.where(S.supported("path")).withColumnRenamed("modificationTime", "mtime")

    def take_in(batch: DataFrame, _: int) -> None:
        batch, index = images.through_jvm(batch.sparkSession, batch, folder), store.load()
        if index is None:
            store.publish(build(batch))
            return
        new = stale(batch, index).persist()
        if not new.isEmpty():
            kept = index.drop("ref_id").join(new.select("path"), "path", "left_anti")
            store.publish(kept.unionByName(build(new)))
        new.unpersist()

    writer = rows.writeStream.foreachBatch(take_in).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()

