"""Exact top-k search of a query set against all rows.

Rows are scored in Arrow batches by one matrix product for each batch, and each task keeps only its k best for each
query, so what is shuffled is queries x k x tasks rows at most, however many rows are scored. Queries go to the tasks in
blocks of a fixed size, each of which scans the rows once; if there are several, each block's result is written to the
checkpoint folder before the next is read, so the driver never holds more than one block.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import sheets

#: queries of one block
BLOCK = 4096
#: rows of a short list that are broadcast at most (24 bytes each); a longer one is joined by shuffle
BROADCAST = 1_000_000
#: scores that are made at once (8 bytes each, a few times over)
CELLS = 1 << 21
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _l1(x: np.ndarray) -> np.ndarray:
    s = x.sum(axis=1, keepdims=True)
    return np.divide(x, s, out=x.copy(), where=s > 0)


def cosine(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return _unit(q) @ _unit(r).T


def positive_dot(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, q @ r.T)


def intersection(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    q, r = _l1(np.abs(q)), _l1(np.abs(r))
    return np.stack([np.minimum(x, r).sum(axis=1) for x in q])


def nearness(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Minus the chi-square distance of the histograms."""
    q, r, out = _l1(np.abs(q)), _l1(np.abs(r)), []
    for x in q:
        s = x + r
        out.append(-0.5 * np.divide((x - r) ** 2, s, out=np.zeros_like(s), where=s > 0).sum(axis=1))
    return np.stack(out)


def preference(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The cheap score over four equal parts of a vector: histogram, moments, radial and angular profile."""
    w = q.shape[1] // 4
    part = [slice(k * w, (k + 1) * w) for k in range(4)]
    return 0.4 * intersection(q[:, part[0]], r[:, part[0]]) + 0.2 * sum(cosine(q[:, p], r[:, p]) for p in part[1:])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a row of scores, of equal ones the least ids."""
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _scan(queries: list[tuple[int, np.ndarray]], scorer: Scorer, k: int):
    names, q = [x for x, _ in queries], np.stack([v for _, v in queries])
    step = max(1, CELLS // len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0)) for _ in names]
        for batch in batches:
            if not len(batch):
                continue
            every, vectors = batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1))
            for a in range(0, len(every), step):
                ids, scores = every[a : a + step], scorer(q, vectors[a : a + step])
                for i, (own_ids, own_scores) in enumerate(held):
                    held[i] = _best(np.concatenate([own_ids, ids]), np.concatenate([own_scores, scores[i]]), k)
        sizes = [len(x) for x, _ in held]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(names, np.int64), sizes)), pa.array(np.concatenate([x for x, _ in held])), pa.array(np.concatenate([s for _, s in held]))], ["query_id", "ref_id", "score"]
            )

    return run


def top_k(refs: DataFrame, queries: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """query_id, ref_id, score and rank (from 1) of the k best rows of ``refs`` (id, vector) for each of ``queries`` (id,
    vector). Ties go to the least id. Rows without an id or vector are left out; vectors are all of one length."""
    refs, queries = (x.toDF("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL") for x in (refs, queries))
    blocks, found = max(1, -(-queries.count() // BLOCK)), []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = [(r["id"], np.array(r["vector"], np.float64)) for r in block.sort("id").toLocalIterator()]
        if rows:
            best = ranked(refs.mapInArrow(_scan(rows, scorer, k), "query_id long, ref_id long, score double"), k)
            found.append(cut(best) if blocks > 1 else best)
    if not found:
        return refs.sparkSession.createDataFrame([], "query_id long, ref_id long, score double, rank int")
    return reduce(DataFrame.unionAll, found)


#: scores that a task of ``whole`` holds at once, rows of one of its chunks and of a batch that it gives
HELD, CHUNK, GIVEN = 1 << 22, 4096, 50_000


def whole(refs: DataFrame, queries: DataFrame, scorer: Scorer, head: DataFrame) -> DataFrame:
    """query_id, ref_id, score, stage and rank of all rows of ``refs`` (id, vector) for each of ``queries`` (id, vector): those
    of ``head`` (query_id, ref_id, score, rank) at stage 1, behind them all others by their score, of equal ones the least id.

    The result has queries x rows rows, none of which is shuffled or written: vectors lie once in files of the checkpoint
    folder, which stay as long as the result may be read, and a task gives the whole list of some queries at a time."""
    refs, queries = (x.toDF("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL") for x in (refs, queries))
    home = sheets.made(refs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with sheets.Writer(home) as out:
            for batch in batches:
                for part in (batch.slice(a, CHUNK) for a in range(0, len(batch), CHUNK)):
                    place = out.put({"ids": part.column(0).to_numpy().astype(np.int64), "vectors": _matrix(part.column(1))})
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*place, len(part))], [*sheets.PLACE, "n"])

    chunks = [tuple(r) for r in cut(refs.mapInArrow(pack, f"{sheets.PLACE_SCHEMA}, n long")).sort(*sheets.PLACE).toLocalIterator()]
    rows = sum(c[-1] for c in chunks)
    group = max(1, min(64, HELD // max(1, rows)))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sheets.Reader(home)
        asked = (r for batch in batches for r in batch.to_pylist())
        while some := list(islice(asked, group)):
            q, ids, scores, at = np.array([r["vector"] for r in some], np.float64), np.empty(rows, np.int64), np.empty((len(some), rows)), 0
            for *place, n in chunks:
                chunk = reader.get(*place)
                ids[at : at + n], scores[:, at : at + n], at = chunk["ids"], scorer(q, chunk["vectors"]), at + n
            by_id = np.argsort(ids, kind="stable")
            ids = ids[by_id]
            for r, own in zip(some, scores, strict=True):
                own = own[by_id]
                first = sorted(r["head"] or [], key=lambda x: x["rank"])
                order = np.argsort(-own, kind="stable")
                order = order[~np.isin(ids[order], [x["ref_id"] for x in first])]
                every = np.concatenate([np.array([x["ref_id"] for x in first], np.int64), ids[order]])
                score = np.concatenate([np.array([x["score"] for x in first], np.float64), own[order]])
                stage = np.repeat(np.array([1, 2], np.int32), [len(first), len(order)])
                for a in range(0, len(every), GIVEN):
                    b = min(len(every), a + GIVEN)
                    columns = [np.full(b - a, r["id"], np.int64), every[a:b], score[a:b], stage[a:b], np.arange(a + 1, b + 1, dtype=np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "ref_id", "score", "stage", "rank"])

    heads = head.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.struct("ref_id", "score", "rank")).alias("head"))
    # few bytes, much work on each
    asked = queries.join(heads, "id", "left").repartition(max(4 * refs.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // 64)))
    return asked.mapInArrow(lists, "query_id long, ref_id long, score double, stage int, rank int")


def shared(spark: SparkSession) -> str:
    """The checkpoint folder. Where that is unset and all runs in one process, as in tests, it is a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """Written to the checkpoint folder, lineage cut."""
    shared(rows.sparkSession)
    return rows.checkpoint()


def ranked(pairs: DataFrame, k: int, order: tuple = ()) -> DataFrame:
    """With rank (from 1) among the pairs of a query, and only the k first."""
    w = Window.partitionBy("query_id").orderBy(*(order or (F.desc("score"), F.asc("ref_id"))))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_vectors(pairs: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs with the vectors of both sides as a and b. The short list is written, and up to BROADCAST rows of it go to where
    the vectors lie, which then are not shuffled."""
    pairs = cut(pairs)
    small = pairs.count() <= BROADCAST
    a, b = (refs.toDF(i, v) for i, v in (("query_id", "a"), ("ref_id", "b")))
    asked = pairs.select("query_id").distinct()
    a = a.join(F.broadcast(asked) if small else asked, "query_id")
    return b.join(F.broadcast(pairs) if small else pairs, "ref_id").join(a, "query_id")
