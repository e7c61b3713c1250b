"""What a user calls: build or load an index, search it, ask for its state."""

from __future__ import annotations

import base64
import threading
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import round4
from .operators.mlp import RANKER, Network
from .plans import image_search
from .sources import images
from .sources.index import Store


@dataclass
class Job:
    """A build: running, done or failed."""

    state: str = "idle"
    done: int = 0
    total: int = 0
    error: str | None = None
    started: float = 0.0


class Engine:
    def __init__(self, spark: SparkSession, index: str, weights: str | None = None, converter: images.Converter | None = None):
        self.spark, self.store, self.converter = spark, Store(spark, index), converter
        self.network = Network.from_frame(spark.read.parquet(weights), RANKER) if weights else None
        self.job, self._lock, self._rows = Job(), threading.Lock(), None

    # -- building -------------------------------------------------------------------------------------------------------

    def build(self, folder: str, exact: bool = True) -> int:
        """Brings the index up to date with a folder; the number of rows that can be searched."""
        found = images.files(self.spark, folder, exact)
        self.store.refresh(found, lambda rows: image_search.described(images.contents(self.spark, rows, folder), self.converter))
        return self.load()

    def start_build(self, folder: str) -> Job:
        """The same in the background; raises if a build is running."""
        with self._lock:
            if self.job.state == "running":
                raise RuntimeError("a build is running")
            self.job = job = Job("running", started=time.time())

        def run() -> None:
            try:
                job.total = images.files(self.spark, folder, True).count()
                job.done = self.build(folder)
                job.state = "done"
            except Exception as e:  # told by status()
                job.state, job.error = "failed", str(e)

        threading.Thread(target=run, daemon=True).start()
        return job

    def load(self) -> int:
        """Takes the published version; searches that run keep theirs."""
        found = self.store.load()
        if found is None:
            raise FileNotFoundError(f"no index at {self.store.root}")
        self._rows = found.where("error IS NULL")
        return self._rows.count()

    def save_weights(self, path: str) -> None:
        self.network.to_frame(self.spark).write.mode("overwrite").parquet(path)

    # -- asking ---------------------------------------------------------------------------------------------------------

    @property
    def rows(self) -> DataFrame:
        if self._rows is None:
            self.load()
        return self._rows

    def __len__(self) -> int:
        return self.rows.count()

    def names(self) -> DataFrame:
        return self.rows.select("path").orderBy("path")

    def errors(self) -> DataFrame:
        return self.store.load().where("error IS NOT NULL").select("path", "error")

    def search_all(self, queries: dict[int, bytes], k: int = 5) -> DataFrame:
        """query_id, path, score and rank of the k best images for each query image; k of 0 or less means 5."""
        asked = {}
        for name, data in queries.items():
            found = image_search.describe(images.decode_query(self.spark, data, self.converter), True)
            if found is None:
                raise ValueError(f"query {name} shows nothing")
            asked[name] = found
        hits = image_search.ranked(self.rows, asked, k if k > 0 else 5, self.network)
        return hits.join(self.rows.select("ref_id", "path"), "ref_id").select("query_id", "path", round4("score").alias("score"), "rank").orderBy("query_id", "rank")

    def search(self, data: bytes, k: int = 5) -> list[dict]:
        return [{"imageId": r["path"], "score": r["score"]} for r in self.search_all({0: data}, k).collect()]

    def search_uri(self, uri: str, k: int = 5) -> list[dict]:
        """Of a data URI, or of plain base64."""
        return self.search(base64.b64decode(uri.rpartition(",")[2]), k)

    def search_path(self, path: str, k: int = 5) -> list[dict]:
        return self.search(bytes(self.spark.read.format("binaryFile").load(path).select("content").first()[0]), k)

    def status(self) -> dict:
        version = self.store.version()
        return {"index": self.store.root, "version": version, "loaded": self._rows is not None, "images": len(self) if version else 0, "build": asdict(self.job)}

    def evaluate(self, queries: DataFrame, at: tuple[int, ...] = (1, 3)) -> DataFrame:
        """Recall over a manifest (image, src, content): queries go through in blocks of 64, of each the first ``max(at)`` names
        are kept."""
        from .operators.ranking import recall

        names = queries.select("image", "src").orderBy("image").collect()
        number, found = {r["image"]: i for i, r in enumerate(names)}, []
        for a in range(0, len(names), 64):
            block = [r["image"] for r in names[a : a + 64]]
            data = {number[r["image"]]: bytes(r["content"]) for r in queries.where(F.col("image").isin(block)).select("image", "content").collect()}
            found += [(r["query_id"], r["path"], r["rank"]) for r in self.search_all(data, max(at)).collect()]
        hits = self.spark.createDataFrame(found, "query_id long, ref_id string, rank int")
        truth = self.spark.createDataFrame([(number[r["image"]], r["src"]) for r in names], "query_id long, ref_id string")
        return recall(hits, truth, at)
