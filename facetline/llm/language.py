"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (letters in lower case, anything else one space) are hashed to 65,536 features.
Document frequencies come from all rows that may be learned from; weights from a bounded sample of them, by
follow-the-regularised-leader (FTRL-Proximal) with elastic-net penalties; a temperature, fitted on a fifth of the sample
that the weights never saw, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import packed, table

BITS = 16
DIMENSIONS = 1 << BITS
UNKNOWN = "und"
#: steps of the share of a language's rows that are learned from
RATES = 1 << 40


@dataclass(frozen=True)
class Params:
    #: expected bound on the rows that weights are learned from, shared evenly by the languages; each has one at least
    sample: int = 3_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5


@lru_cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def _characters(text: str) -> np.ndarray:
    """Code points of the letters in lower case, with one space for each run of anything else, at both ends too."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_letters()[c], c, np.uint32(32))
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]]).astype(np.uint32)
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, how often each); none if the text has no letter."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = _characters(text)
    if len(c) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, grams = np.zeros(len(c), np.uint32), []
    for n in (1, 2, 3):
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        grams.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    counts = np.bincount(np.concatenate(grams), minlength=DIMENSIONS)
    used = np.flatnonzero(counts)
    return used, counts[used]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # (DIMENSIONS + 1, languages); the last row is the constant
    temperature: float

    def vector(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _vector(used, counts, self.idf)

    def probabilities(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = self.vector(used, counts) @ self.weights[used] + self.weights[-1]
        return _softmax(logits / self.temperature)


def _vector(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[used]
    return x / max(np.sqrt(x @ x), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, p: Params) -> np.ndarray:
    """FTRL-Proximal with a learning rate for each weight (McMahan et al., 2013)."""
    z, n = np.zeros((DIMENSIONS + 1, classes)), np.zeros((DIMENSIONS + 1, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > p.l1, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2), 0.0)

    order = np.random.default_rng(5)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            used, x, y = rows[k]
            at, x = np.append(used, DIMENSIONS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            g = _softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            more = np.sqrt(n[at] + g * g) - np.sqrt(n[at])
            z[at] += g - more / p.alpha * w
            n[at] += g * g
    return weights(z, n)


def fit(rows: pd.DataFrame, idf: np.ndarray, p: Params = Params()) -> Model:
    """A model from rows of lang, fold (0 calibrates), used and counts."""
    languages = tuple(sorted(rows["lang"].unique()))
    number = {x: k for k, x in enumerate(languages)}
    ready = [(u, _vector(u, c, idf), number[lang]) for u, c, lang in zip(rows["used"], rows["counts"], rows["lang"], strict=True)]
    calibrates = rows["fold"].to_numpy() == 0
    weights = _leader([r for r, c in zip(ready, calibrates, strict=True) if not c], len(languages), p)
    held = [r for r, c in zip(ready, calibrates, strict=True) if c]
    best = 1.0
    if held:
        logits, truth = np.stack([x @ weights[u] + weights[-1] for u, x, _ in held]), np.array([y for _, _, y in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        best = float(grid[int(np.argmin(loss))])
    return Model(languages, idf, weights, best)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            total[features(text.as_py())[0]] += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["feature", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in kit.slices(batch):
            found = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("fold"), pa.array([u for u, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))], ["doc_id", "lang", "fold", "used", "counts"])


def _crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def held_out() -> Column:
    return F.coalesce(_crc() % 5 == 0, F.lit(False))


def learned(documents: DataFrame, p: Params = Params()) -> Model | None:
    """A model from the text and non-null lang of documents of which crc32(doc_id) mod 5 is not 0; None if there are
    none. Texts without letters teach nothing."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(RATES))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(spread).alias("least")).collect()
    totals = {r["lang"]: r["n"] for r in found}
    if not totals:
        return None
    idf = np.log((1 + sum(totals.values())) / np.ones(DIMENSIONS)) + 1
    for r in rows.mapInArrow(kit.tidied(_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():
        idf[r["feature"]] -= np.log(1 + r["n"])
    share = max(1, p.sample // len(totals))
    # at least the row with the least hash
    rates = {r["lang"]: min(RATES, max(r["least"] + 1, RATES * share // r["n"])) for r in found}
    rate = F.broadcast(rows.sparkSession.createDataFrame(list(rates.items()), "lang string, rate long"))
    sample = rows.join(rate, "lang").where(spread < F.col("rate")).select("doc_id", "lang", "text")
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)))
    found = sample.mapInArrow(_sparse, "doc_id long, lang string, fold long, used array<int>, counts array<int>").where(F.size("used") > 0).toPandas()
    if not len(found):
        return None
    return fit(found.sort_values(["doc_id", "lang"], kind="stable").reset_index(drop=True), idf, p)


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kit.unpacked(batches):
            for part in kit.slices(batch):
                names, scores = [], []
                for text in part.column("text").to_pylist():
                    used, counts = features(text)
                    if model is None or not len(used):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        chances = model.probabilities(used, counts)
                        best = int(chances.argmax())
                        names.append(model.languages[best])
                        scores.append(float(chances[best]))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(names), pa.array(scores)], ["row", "lang_pred", "score"])

    return run


def predicted(documents: DataFrame, model: Model | None) -> DataFrame:
    """row (a struct of all columns), lang_pred and score (the calibrated probability of lang_pred) of every row.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there is no model. Equal texts
    have equal results; of equally likely languages the first by name is given; an empty table gives no rows."""
    rows, kind = packed(documents)
    return rows.mapInArrow(kit.tidied(_predict(model)), f"row {kind}, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learned(documents)
    return predicted(documents.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
