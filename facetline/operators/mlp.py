"""A small network of dense layers (ReLU, at the end a sigmoid): inference in Arrow batches, training by Adam.

Training sums gradients in the tasks, a tree aggregate of one row for each task, so the driver sees one gradient a step
however many rows there are. Weights are a table (layer, row, col, w); col -1 is the constant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: widths of the ranking network: 27 scores with the query's bests and gaps
RANKER = (81, 96, 48, 1)
WEIGHTS = "layer int, row int, col int, w double"


@dataclass
class Network:
    weights: list[np.ndarray]  # (out, in)
    constants: list[np.ndarray]

    @classmethod
    def by_rule(cls, widths: tuple[int, ...], w: Callable[[int, int], float], b: Callable[[int], float]) -> Network:
        return cls([np.array([[w(r, c) for c in range(i)] for r in range(o)]) for i, o in zip(widths[:-1], widths[1:], strict=True)], [np.array([float(b(r)) for r in range(o)]) for o in widths[1:]])

    @classmethod
    def random(cls, widths: tuple[int, ...] = RANKER, seed: int = 0, scale: float = 0.6) -> Network:
        rng = np.random.default_rng(seed)
        return cls([rng.uniform(-scale, scale, (o, i)) for i, o in zip(widths[:-1], widths[1:], strict=True)], [np.zeros(o) for o in widths[1:]])

    @property
    def widths(self) -> tuple[int, ...]:
        return (self.weights[0].shape[1], *(len(b) for b in self.constants))

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and what each layer makes of it."""
        out = [x]
        for k, (w, b) in enumerate(zip(self.weights, self.constants, strict=True)):
            z = out[-1] @ w.T + b
            out.append(np.maximum(z, 0.0) if k < len(self.weights) - 1 else 1 / (1 + np.exp(-np.clip(z, -700, 700))))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[-1][:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Sums over rows of the gradient of weighted cross entropy, in the order of ``parts``."""
        layers, out = self.forward(x), []
        delta = (layers[-1] - y[:, None]) * weight[:, None]
        for k in range(len(self.weights) - 1, -1, -1):
            out[:0] = [delta.T @ layers[k], delta.sum(axis=0)]
            if k:
                delta = (delta @ self.weights[k]) * (layers[k] > 0)
        return out

    def parts(self) -> list[np.ndarray]:
        return [p for pair in zip(self.weights, self.constants, strict=True) for p in pair]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, r, c, float(w[r, c])) for k, w in enumerate(self.weights) for r in range(w.shape[0]) for c in range(w.shape[1])]
        rows += [(k, r, -1, float(v)) for k, b in enumerate(self.constants) for r, v in enumerate(b)]
        return spark.createDataFrame(rows, WEIGHTS)

    @classmethod
    def from_frame(cls, df: DataFrame, widths: tuple[int, ...] | None = None) -> Network:
        """Of a weights table; raises if a cell is missing, or if the widths are not the ones asked for."""
        rows = df.toPandas()
        shapes = [(int(g["row"].max()) + 1, int(g["col"].max()) + 1) for _, g in rows.groupby("layer")]
        net = cls([np.full(s, np.nan) for s in shapes], [np.full(s[0], np.nan) for s in shapes])
        for r in rows.itertuples():
            (net.constants[r.layer] if r.col < 0 else net.weights[r.layer])[r.row if r.col < 0 else (r.row, r.col)] = r.w
        if any(np.isnan(p).any() for p in net.parts()) or (widths and net.widths != tuple(widths)):
            raise ValueError(f"weights of widths {net.widths} where {widths or 'a whole table'} was expected")
        return net


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def predicted(rows: DataFrame, vector: str, net: Network, name: str = "score") -> DataFrame:
    """Rows with the network's output; the network travels with the task (some 100 KB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.predict(_rows(batch.column(1))))], ["row", name])

    packed = rows.select(F.struct("*").alias("row"), F.col(vector).cast("array<double>").alias("v"))
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {kind}, {name} double").select("row.*", name)


def _sums(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [np.zeros_like(p) for p in net.parts()], 0
        for batch in batches:
            if len(batch):
                n += len(batch)
                total = [s + g for s, g in zip(total, net.gradient(_rows(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()), strict=True)]
        flat = np.concatenate([t.reshape(-1) for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat), pa.array(np.full(len(flat), n))], ["i", "g", "n"])

    return run


def train(rows: DataFrame, net: Network, steps: int, rate: float = 1e-3, beta: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> Network:
    """Adam on the mean gradient over all of ``rows`` (vector, label, weight), one pass a step."""
    packed = rows.select(F.col("vector").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("w")).persist()
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    try:
        for t in range(1, steps + 1):
            parts = net.parts()
            sums = packed.mapInArrow(_sums(net), "i int, g double, n long").groupBy("i").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas().sort_values("i")
            n = max(1, int(sums["n"].iloc[0]) if len(sums) else 0)
            flat, at, new = sums["g"].to_numpy() / n, 0, []
            for k, p in enumerate(parts):
                g = flat[at : at + p.size].reshape(p.shape)
                at += p.size
                first[k] = beta[0] * first[k] + (1 - beta[0]) * g
                second[k] = beta[1] * second[k] + (1 - beta[1]) * g * g
                new.append(p - rate * (first[k] / (1 - beta[0] ** t)) / (np.sqrt(second[k] / (1 - beta[1] ** t)) + eps))
            net = Network(new[0::2], new[1::2])
    finally:
        packed.unpersist()
    return net
