"""Operators against their SQL in DuckDB, the network against finite differences, search against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from facetline.functions import vectors as V
from facetline.operators import ranking, search, stats
from facetline.operators.mlp import Network, predicted, train
from facetline.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canon(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.6f}"
        return str([f"{float(x) + 0.0:.6f}" for x in v]) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(one, row)) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_its_sql(spark, duck, name):
    assert canon(catalogue.QUERIES[name](spark, DATA).toPandas()) == canon(duck.execute(catalogue.SQL[name]).df())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_k_in_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    x[7] = x[3]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.0] * 4)], "id long, v array<double>").repartition(5)
    got = {(r.query_id, r.rank): r.ref_id for r in search.top_k(rows, rows.where("id < 8"), search.cosine, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(8):
        s = u @ u[q]
        want = sorted(range(40), key=lambda i: (-round(s[i], 12), i))[:5]
        assert [got[q, k + 1] for k in range(5)] == want
    assert search.top_k(rows.where("false"), rows, search.cosine, 5).count() == 0
    assert search.top_k(rows, rows.where("false"), search.cosine, 5).count() == 0


def test_vectors_of_other_lengths_and_zeros(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(
        V.cosine("a", "b").alias("x"), V.cosine("a", "z").alias("y"), V.intersection("a", "b").alias("i"), V.chi_square("a", "b").alias("c"), V.l1("z").alias("l"), V.l2("a").alias("u"), V.rolled("a", 1).alias("r"), V.best_roll("a", F.array(F.lit(2.0), F.lit(1.0))).alias("best"),
        V.upper_median(F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0)))).alias("m"), V.softmax("a").alias("s"), V.strided(F.array(*[F.lit(float(i)) for i in range(10)]), 4).alias("t"),
    ).first()
    assert (row.x, row.y, row.i, row.c, row.l, row.r, row.m, row.t) == (0, 0, 0, 1, [0, 0], [2, 1], 3, [0, 2, 5, 7])
    assert np.isclose(row.best, 1) and np.isclose(sum(row.s), 1) and np.isclose(sum(v * v for v in row.u), 1)


def test_single_row_weights(spark):
    one = spark.createDataFrame([(1, 5, d, 0.5) for d in ("a", "b")], "query_id long, ref_id long, dim string, score double")
    assert [r.weight for r in ranking.dispersion_weights(one).collect()] == [0.5, 0.5]
    assert {r.dim: round(r.weight, 6) for r in ranking.adaptive_weights(one, {"a": 3.0, "b": 1.0}).collect()} == {"a": 0.75, "b": 0.25}


def test_clear_main_band(spark):
    bands = spark.createDataFrame([(1, 1, 10), (1, 2, 5), (2, 1, 10), (2, 2, 6)], "k long, band long, n long")
    assert [r.k for r in stats.clear_main(bands, ["k"]).collect()] == [1]


def test_gradient_and_training(spark):
    rng = np.random.default_rng(1)
    net = Network.random((3, 4, 1), seed=2)
    x, y, w = rng.normal(size=(20, 3)), (rng.random(20) > 0.5).astype(float), rng.random(20)

    def loss(n):
        p = n.predict(x)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g = net.gradient(x, y, w)
    for k, part in enumerate(net.parts()):
        at = tuple(0 for _ in part.shape)
        part[at] += 1e-6
        up = loss(net)
        part[at] -= 2e-6
        down = loss(net)
        part[at] += 1e-6
        assert np.isclose((up - down) / 2e-6, g[k][at], atol=1e-4)
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([([float(v) for v in a], float(b), 1.0) for a, b in zip(x, y, strict=True)], "vector array<double>, label double, weight double")
    better = train(rows, net, 25, rate=0.05)
    assert ((better.predict(x) > 0.5) == (y > 0.5)).mean() >= 0.9
    again = Network.from_frame(better.to_frame(spark), (3, 4, 1))
    assert np.allclose(again.predict(x), better.predict(x))
    assert np.allclose([r.score for r in predicted(rows, "vector", again).collect()], better.predict(x))
    with pytest.raises(ValueError):
        Network.from_frame(better.to_frame(spark), (3, 5, 1))
