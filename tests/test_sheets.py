"""Image searches whose descriptors lie in files, against the same searches over wide rows."""

import pickle

import numpy as np
import pandas as pd
import pytest
from facetline.operators import search
from facetline.plans import catalogue
from facetline.plans import image_search as I
from facetline.sources import sheets


@pytest.fixture(scope="module")
def grids(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("grids"))
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 70").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    return d


def _wide(spark, d, extra):
    """The index as rows, and the queries as a dict."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    made = [{"path": str(r.vec_id), "length": 0} | (I.describe(I.from_grid(r.embedding, r.label), False, extra) or {"error": "nothing"}) for r in rows.itertuples()]
    index = spark.sparkContext.parallelize(range(0, len(made), 10), 2).toDF("long").mapInPandas(lambda bs: (I._frame([dict(x) for x in made[int(a) : int(a) + 10]], extra) for b in bs for a in b["value"]), I.EXTRA_SCHEMA if extra else I.SCHEMA)
    asked = {int(r.vec_id): I.describe(I.on_background(np.rot90(I.from_grid(r.embedding, r.label)).copy()), True, extra) for r in rows.itertuples() if r.vec_id % 20 == 0}
    return search.cut(index.selectExpr("*", "cast(path as long) AS ref_id")), asked


def _same(got, want):
    got, want = (x.toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, rtol=1e-9)


def test_image_search_by_places_is_that_of_rows(spark, grids):
    index, asked = _wide(spark, grids, False)
    _same(catalogue.image_search_e2e(spark, grids), I.ranked(index, asked, 5, catalogue._network()).select("query_id", "ref_id", catalogue._six("score"), "stage", "rank"))


def test_neither_queries_nor_wide_rows_go_through_closures_and_plans(spark, grids):
    with sheets.folder(spark) as home:
        asked, index = catalogue._asked(spark, grids, False, home), I.drawings(spark, grids, False, home)
        assert list(asked) == [0, 20, 40, 60] and len(pickle.dumps(asked)) < 2_000
        assert pickle.loads(pickle.dumps(asked))[20]["mask"].shape == (4096,)
        assert set(index.columns) == {"ref_id", "error", "shaped", "cheap", *sheets.PLACE} and index.count() == 70
        with pytest.raises(KeyError):
            asked[21]


def test_scores_are_made_a_bounded_number_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(search, "CELLS", 12)
    rng, seen = np.random.default_rng(4), []

    def scorer(q, r):
        seen.append(len(q) * len(r))
        return q @ r.T

    r, q = rng.normal(size=(50, 4)), rng.normal(size=(4, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(list(r))], ["id", "vector"])
    got = next(search._scan(list(enumerate(q)), scorer, 3)(iter([batch]))).to_pandas()
    assert max(seen) <= 12 and sum(seen) == 200
    assert got["ref_id"].tolist() == np.argsort(-(q @ r.T), axis=1)[:, :3].ravel().tolist()


def test_whole_lists_are_neither_shuffled_nor_written(spark, grids, monkeypatch):
    from facetline.operators import ranking

    monkeypatch.setattr(search, "GIVEN", 7)
    monkeypatch.setattr(search, "HELD", 140)
    monkeypatch.setattr(search, "CHUNK", 9)
    rows = catalogue._vectors(spark, grids)
    asked = rows.where("vec_id % 20 = 0")
    # ties, a query without a head and one whose head is out of order
    head = spark.createDataFrame([(0, 5, 0.9, 2), (0, 3, 0.5, 1), (40, 40, 1.0, 1)], "query_id long, ref_id long, score double, rank int")
    flat = lambda q, r: np.round(search.cosine(q, r), 1)
    got = search.whole(rows, asked, flat, head)
    want = ranking.with_tail(head, search.top_k(rows, asked, flat, 70).withColumnRenamed("score", "pref"))
    key = lambda x: sorted(tuple(r) for r in x.select("query_id", "ref_id", "score", "stage", "rank").collect())
    assert key(got) == key(want) and got.count() == 4 * 70
    plan = catalogue.append_tail_union(spark, grids)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in above and "Window" not in above and "Sort" not in above


def test_shape_search_by_places_is_that_of_rows(spark, grids):
    index, asked = _wide(spark, grids, True)
    _same(catalogue.shape_search_e2e(spark, grids), I.expert_ranked(index, asked, 5).select("query_id", "ref_id", catalogue._six("score"), "rank"))


def test_global_scores_leave_a_task_as_a_bounded_list(spark, grids, monkeypatch):
    monkeypatch.setattr(I, "ASKED", 3)
    monkeypatch.setattr(I, "ROWS", 16)
    with sheets.folder(spark) as home:
        asked, index = catalogue._asked(spark, grids, True, home), I.drawings(spark, grids, True, home)
        assert index.where("cheap IS NOT NULL").count() == 0  # what shape alone doesn't read isn't written
        batch = index.select("ref_id", *sheets.PLACE).toPandas()
        every, best = (pd.concat(I._best_of_sheets(asked, most)(iter([batch[:40], batch[40:]]))) for most in (70, 9))
    assert (every.groupby("query_id").size() == 70).all() and (best.groupby("query_id").size() == 9).all()
    want = every.sort_values(["query_id", "global", "ref_id"], ascending=[True, False, True]).groupby("query_id").head(9)
    assert sorted(map(tuple, want.to_numpy())) == sorted(map(tuple, best.to_numpy()))


def test_regions_are_matched_only_of_rows_that_can_reach_the_list(spark, grids, monkeypatch):
    from facetline.operators.raster import pairs as P

    matched, match = [], P.region_similarity
    monkeypatch.setattr(I, "ROWS", 16)
    monkeypatch.setattr(P, "region_similarity", lambda q, r: matched.append(1) or match(q, r))
    with sheets.folder(spark) as home:
        asked, index = catalogue._asked(spark, grids, True, home), I.drawings(spark, grids, True, home)
        batch = index.select("ref_id", *sheets.PLACE).toPandas()
        every = pd.concat(I._best_of_sheets(asked, 70)(iter([batch])))
        assert len(matched) == 4 * 70
        best = pd.concat(I._best_of_sheets(asked, 3)(iter([batch])))
    assert len(matched) - 4 * 70 < 0.8 * 4 * 70
    want = every.sort_values(["query_id", "global", "ref_id"], ascending=[True, False, True]).groupby("query_id").head(3)
    assert sorted(map(tuple, want.to_numpy())) == sorted(map(tuple, best.to_numpy()))


def test_no_row_matches_its_regions_better_than_its_bound(spark, grids):
    from facetline.operators.raster import pairs as P

    rows = spark.read.parquet(f"{grids}/embeddings.parquet").where("vec_id < 12").toPandas()
    made = [I.describe(I.from_grid(r.embedding, r.label), False, True) for r in rows.itertuples()]
    made[3] = made[3] | {"regions": None}
    q, stacked = P.prepared(made[0]), P.stacked(pd.DataFrame(made))
    found, bounds = (np.array(x) for x in ([P.region_similarity(q["parts"], x) for x in stacked["parts"]], P.region_bounds(q["parts"], stacked)))
    assert (found <= bounds).all() and bounds[3] == 0 and (bounds < 1.01).all() and not P.region_bounds(None, stacked).any()
    full = P.experts(q, stacked)
    least = np.sort(full)[6]
    some = P.experts(q, stacked, least)
    assert (some[full >= least] == full[full >= least]).all() and np.isneginf(some[full < least]).any()
