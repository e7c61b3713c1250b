"""The pipeline's stages: rows that go, columns that stay."""

import pytest

import corpus_pipeline
from facetline.llm import shared

DATA = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).persist()
        n = docs.count()
        if k < 3:
            assert docs.columns == columns and 0 < n <= before, name
        elif k == 3:
            assert docs.columns == columns and docs.distinct().count() <= before, name
        else:
            assert n == before and docs.where("NOT round_trip").count() == 0
            assert docs.where("size(ids) <> n_tokens OR ids_crc32 <> nbest_ids_crc32[0]").count() == 0
        before = n


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g", "x", None), (2, "a b c d e f g", "x", "s"), (3, "q r s t u v w", "x", "s"), (3, "q r s t u v w", "x", "s"), (None, "a b c d e f g", None, "s"), (4, None, "y", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.keep_one_of_group(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "3", "4", "None"]


def test_rows_that_share_a_doc_id_stay(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    docs = spark.createDataFrame([(2, a, "x", None), (5, a + " more", "x", "s"), (5, b, "x", "s"), (9, b, "x", "s")], "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_group(spark, docs, DATA).collect()) == [(2, a), (5, b)]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, None, "en", "s", 0), (2, "word " * 30000, None, None, 9), (2, "word " * 30000, None, None, 9)]])
def test_stages_of_odd_tables(spark, rows):
    """Nulls, empty and long texts, repeated rows, no rows, and columns named like those that operators add."""
    for extra in ("n_chars long", "score long", "size long", "kept long", "mark long", "node long", "row long"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")
        for _, stage in corpus_pipeline.STAGES[:-1] if extra in ("n_chars long", "mark long") else corpus_pipeline.STAGES[:1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns and out.count() <= 2 * len(rows)
        assert corpus_pipeline.encode(spark, docs, DATA).where("NOT round_trip").count() == 0


def test_run_gives_tokens(spark):
    from pathlib import Path

    folder = Path(shared.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    out = corpus_pipeline.run(spark, DATA)
    made = set(folder.iterdir()) - before
    assert len(made) == 1 and {p.name for p in made.pop().iterdir()} == {"stage-4"}
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
