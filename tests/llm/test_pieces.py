"""Segmentations against all of them, and decoding against the text."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from facetline.llm.pieces import OWN_SPACE, SPACE, Pieces, changed, default_model, encoded, is_bpe, pieces


@pytest.fixture(scope="module")
def model():
    return pieces(default_model())


def normal(text):
    return SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if text else ""


def all_ways(model, text):
    """(score, ids) of every segmentation."""
    s, out = normal(text), []
    edges = {}
    for i, j, piece, w in model.lattice(s)[0]:
        edges.setdefault(i, []).append((j, piece, w))

    def go(i, score, ids):
        if i == len(s):
            out.append((score, tuple(model.expand(ids))))
        for j, piece, w in edges.get(i, ()):
            go(j, score + w, [*ids, piece])

    go(0, 0.0, [])
    return out


def ways_of(starts, ids, ranked, k):
    return [(score, tuple(changed(ids[starts[k] : starts[k + 1]], changes).tolist())) for score, changes in ranked[k]]


def test_n_best_against_all_segmentations(model):
    rng = random.Random(0)
    letters = [*"abeinth  .\n,", "ü", SPACE, "中", "́"]
    for _ in range(150):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(3)]
        starts, ids, ranked = model.encode(pa.array(texts), 4)
        assert [x.decode() for x in model.decode(starts, ids)] == texts
        for k, t in enumerate(texts):
            got, every = ways_of(starts, ids, ranked, k), all_ways(model, t)
            assert [score for score, _ in got] == sorted((score for score, _ in every), reverse=True)[:4]
            assert len({way for _, way in got}) == len(got) and set(got) <= set(every)
            assert all(b"".join(model.raw[i] for i in way).decode() == (" " + t if t else "") for _, way in got)


def test_pieces_that_go_on_to_a_space(model):
    """Such a model's texts are searched whole."""
    texts = ["the then of  the", "", " a  b "]
    want = model.encode(pa.array(texts), 4)
    own = Pieces(default_model())
    own.spaces = False
    got = own.encode(pa.array(texts), 4)
    for k in range(3):
        a, b = ways_of(*want, k), ways_of(*got, k)
        assert [x for x, _ in a] == [x for x, _ in b] and a[0][0] == b[0][0]


def test_kind_of_model(model):
    raw = open(default_model(), "rb").read()
    assert is_bpe(raw) and not is_bpe(raw.split(b"\x12", 1)[0] if raw[:1] == b"\x12" else b"")
    assert model.entry_score.max() <= 0 and (model.entry_score * 2**20 == np.round(model.entry_score * 2**20)).all()


def test_most_words_are_encoded_as_the_library_does(model):
    import duckdb
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    words = [w for t in texts for w in t.split()]
    starts, ids, _ = model.encode(pa.array(words))
    same = [ids[a:b].tolist() == x for a, b, x in zip(starts[:-1], starts[1:], library.encode(words, num_threads=1), strict=True)]
    assert sum(same) > 0.8 * len(same)


def test_search_of_a_whole_text_agrees_with_its_parts(model):
    text = "The quick brown fox, they said.\nAnd then the lazy dogs!"
    best = [s for s, _ in model.nbest(normal(text), 5)]
    assert [score for score, _ in model.encode(pa.array([text]), 5)[2][0]] == best == sorted(best, reverse=True)
    score, ids = next(iter(model.nbest(normal(text), 1)))
    assert b"".join(model.raw[i] for i in ids).decode() == " " + text and score == best[0]


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello you  there ", "c"), (3, "Hello you  there ", "c"), (None, "ﬁ ▁ 中\t", "d"), (5, "word " * 4000, "e"), (6, "x" * 5000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    got = encoded(df, default_model(), 3, with_ids=3).collect()
    for r in got:
        ways = r.segmentations
        assert r.round_trip and r.n_tokens == ways[0].n_tokens and r.ids_crc32 == ways[0].ids_crc32
        assert all(w.n_tokens == len(w.ids) and w.ids_crc32 == zlib.crc32(np.array(w.ids, "<u4").tobytes()) for w in ways)
        assert len({tuple(w.ids) for w in ways}) == len(ways) and [w.score for w in ways] == sorted((w.score for w in ways), reverse=True)
    assert {r.row.doc_id: (r.n_tokens, len(r.segmentations), r.segmentations[0].score) for r in got if r.row.doc_id in (1, 2)} == {1: (0, 1, 0.0), 2: (0, 1, 0.0)}
    assert len({str(r.segmentations) for r in got if r.row.doc_id == 3}) == 1
    assert encoded(df.where("false"), default_model()).count() == 0
