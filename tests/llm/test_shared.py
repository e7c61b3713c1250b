"""Scratch tables, places of files and samples of labels."""

import pytest

from facetline.llm import shared
from facetline.llm.textkit import slices, words_of


def test_scratch_tables_are_written_read_and_cleared(spark):
    from pathlib import Path

    scratch = shared.Scratch(spark, "test")
    rows = scratch.put(spark.range(1000).repartition(20), "t", 1000)
    folder = Path(scratch.path("t").removeprefix("file:").removeprefix("//"))
    assert rows.count() == 1000 and len(list(folder.glob("part-*"))) == 1
    scratch.drop("t")
    assert not folder.exists()
    scratch.put(spark.range(3), "u")
    shared.clear(spark)
    assert not folder.parent.exists()


def test_labels_are_thinned_and_differing_ones_left_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}", 9) for i in range(2000)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(2000)] + [(4, 1, 1), (5, 1, 1), (6, 1, 7), (None, 1, 1)], "doc_id long, quality int, toxic int")
    full = {r.doc_id: r.toxic for r in shared.labelled(docs, labels, "toxic", 5000).collect()}
    assert len(full) == 1999 and 4 not in full and full[5] == 1 and full[6] == 0
    assert 300 < shared.labelled(docs, labels, "toxic", 500).count() < 700


def test_words_split_at_ascii_white_space_only():
    import pyarrow as pa

    texts = [" a\x0bb\x1cc d\xa0e \n", None, "", "x\ry\x0cz\x85q É"]
    w = words_of(pa.array(texts), lower=True)
    got = [[w.vocab[int(c)].as_py() for c in w.codes[a:b]] for a, b in zip(w.starts[:-1], w.starts[1:], strict=True)]
    assert got == [[x.decode() for x in (t or "").encode().lower().split()] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "y" * 500, "z"])], ["text"])
    parts = [p.num_rows for p in slices(batch, limit=100)]
    assert sum(parts) == 4 and max(parts) < 4


def test_places_of_files(tmp_path):
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        files, path = shared.place(uri)
        assert path == str(tmp_path) and files.type_name == "local"
    with pytest.raises(ValueError):
        shared.place("nosuch://bucket/x")
    assert shared.SCHEMES["s3a"] == "s3"
