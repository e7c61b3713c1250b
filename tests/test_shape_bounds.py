"""The shape search reads and matches only what can be among the best, with the results of doing all of it."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from facetline.operators.raster import bounds
from facetline.operators.raster import pairs as P
from facetline.plans import catalogue
from facetline.plans import image_search as I
from facetline.sources import sheets


@pytest.fixture(scope="module")
def grids(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("grids"))
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 90").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def made(spark, grids):
    rows = spark.read.parquet(f"{grids}/embeddings.parquet").toPandas().sort_values("vec_id")
    drawn = [I.from_grid(r.embedding, r.label) for r in rows.itertuples()]
    q = I.outlined(I.on_background(np.rot90(drawn[0]).copy()), True)
    return P.prepared(q) | {"contour_turns": P.contour_turns(q["points"])}, [I.outlined(x, False) for x in drawn]


def test_costs_of_many_matchings_are_those_of_one(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        costs = np.round(rng.random((40, n, n)), 1)  # with ties
        costs[:3] = 0
        want = [min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(n))) for c in costs]
        assert np.allclose(P.least_costs(costs), want)
    costs = rng.random((30, 48, 48))
    assert np.allclose(P.least_costs(costs), [c[np.arange(48), P.assignment(c)].sum() for c in costs])


def test_six_dimensions_of_many_rows_are_those_of_one(made):
    q, rows = made
    rows = [*rows[:30], rows[0] | {"regions": None}, rows[1] | {"solidity": 0.3}, rows[2] | {"context": rows[2]["context"] * 0.9}]
    got = P.six(q, pd.DataFrame(rows))
    want = [(*P.grids(q, r), P.region_similarity(q["parts"], P.region_arrays(r["regions"])), P.hog_shifts(q["hog"], r["hog"]), P.contour_similarity(q, r), P.cosine(q["fourier"], r["fourier"])) for r in rows]
    assert np.allclose(got, want, rtol=0, atol=1e-9) and got[30, 2] == 0 and got[31, 4] == 0


def test_no_row_scores_above_its_bound(made):
    q, rows = made
    rows = [*rows, rows[3] | {"regions": None}, rows[4] | {"occ_bbox64": np.zeros(4096)}]
    stacked = P.stacked(pd.DataFrame(rows))
    full = P.experts(q, stacked)
    for sample in (rows[:40], rows[:1]):  # axes of whatever rows
        own = bounds.axes({c: np.array([r[c] for r in sample]) for c in bounds.ALONG})
        cut = [P.stacked(pd.DataFrame(rows[a : a + 50])) for a in range(0, len(rows), 50)]
        got = bounds.bounds([bounds.of_query(q, own)] * 9, bounds.joined([bounds.of_rows(x, own) for x in cut]))
        assert got.shape == (9, len(rows)) and np.allclose(got, got[0], atol=1e-5) and (got >= full).all()
        if len(sample) > 1:
            assert np.median(got[0] - full) < 0.1


def test_rows_that_cannot_reach_the_list_are_not_read(spark, grids, monkeypatch):
    read, get = [], sheets.Reader.get
    monkeypatch.setattr(I, "ROWS", 6)
    with sheets.folder(spark) as home:
        asked, index = catalogue._asked(spark, grids, True, home), I.drawings(spark, grids, True, home)
        rows = index.select("ref_id", *sheets.PLACE).toPandas()
        every = pd.concat(I._best_of_sheets(asked, 90)(iter([rows])))
        reader = sheets.Reader(home)
        axes = I._axes(reader, list(rows[list(sheets.PLACE)].itertuples(index=False)))
        chunks = list(I._chunks(reader, axes, iter([rows[:50], rows[50:]])))
        monkeypatch.setattr(sheets.Reader, "get", lambda self, *x: read.append(1) or get(self, *x))
        for span in (I.SPAN, 50):  # all bounds at once, or some at a time
            read.clear()
            monkeypatch.setattr(I, "SPAN", span)
            best = pd.concat(I._best_of_chunks(asked, list(asked), 3, reader, axes, lambda: chunks))
            assert len(asked) == 5 and len(read) < 0.6 * 5 * 90
            want = every.sort_values(["query_id", "global", "ref_id"], ascending=[True, False, True]).groupby("query_id").head(3)
            assert sorted(map(tuple, want.to_numpy().round(9))) == sorted(map(tuple, best.to_numpy().round(9)))


def test_search_by_query_is_that_by_rows(spark, grids, monkeypatch):
    one = catalogue.shape_search_e2e(spark, grids).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    monkeypatch.setattr(I, "ASKED", 2)
    other = catalogue.shape_search_e2e(spark, grids).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert len(one) == 25
    pd.testing.assert_frame_equal(one, other)
    with sheets.folder(spark) as home:
        index = I.drawings(spark, grids, True, home)
        assert I._best_by_query(index.where("false"), catalogue._asked(spark, grids, True, home), 3).count() == 0
