"""Formats, folders, the index and its refresh, and image search over real files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetline.functions import scalars as S
from facetline.operators.mlp import RANKER, Network
from facetline.plans import image_search as I
from facetline.sources import images, index, png


def tiny(w, h):
    x = np.zeros((h, w, 4), np.uint8)
    x[0, 0] = 255
    x[..., 3] = 255
    return png.encode(x)


def test_png_there_and_back():
    rng = np.random.default_rng(0)
    for shape in ((6, 8, 4), (5, 7, 3), (4, 4)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        back = png.decode(png.encode(x))
        want = x if x.ndim == 3 else np.repeat(x[..., None], 3, axis=2)
        assert (back[..., : want.shape[2]] == want).all()
    assert png.decode(tiny(8, 6)).shape == (6, 8, 4)
    with pytest.raises(ValueError):
        png.decode(tiny(8, 6)[:-20])


def test_converter_is_told_the_kind():
    seen = []

    def convert(data, kind):
        seen.append(kind)
        return tiny(4, 4)

    svg = b'<svg xmlns="http://www.w3.org/2000/svg" width="4" height="4"></svg>'
    assert images.decode(svg, "", convert).shape == (4, 4, 4) and seen == ["svg"]
    with pytest.raises(ValueError):
        images.decode(svg)


def test_signatures(spark):
    heads = [("svg", b"<svg></svg>"), ("svg", b'<?xml version="1.0"?><svg>'), ("webp", b"RIFFxxxxWEBPVP8 "), ("bmp", b"BM..."), ("", b"plain"), ("avif", b"\0\0\0\x1cftypavif"), ("svg", b"\xef\xbb\xbf \n<!DOCTYPE SVG"), ("bmp", b"  bm"), ("avif", b"AAAAftypavis"), ("", b"AAAAftypheic  avif"), ("webp", b"riffxxxxwebpV"), ("", b"RIFFxxxxWAVE")]
    for kind, head in heads:
        assert images.sniffed(head) == kind
    rows = spark.createDataFrame([(k, bytearray(h)) for k, h in heads], "kind string, head binary").select("kind", S.sniff("head").alias("got")).collect()
    assert all(r["kind"] == r["got"] for r in rows)


def test_supported_extensions_and_folders(spark, tmp_path):
    for e in (*S.EXTENSIONS, ".txt"):
        (tmp_path / f"a{e}").write_bytes(tiny(2, 2))
    assert images.files(spark, str(tmp_path)).count() == 10
    tree = tmp_path / "tree"
    for d in (".", "sub1", "sub1/deep", "sub2", ".git"):
        (tree / d).mkdir(parents=True, exist_ok=True)
        (tree / d / "x.PNG").write_bytes(tiny(2, 2))
    (tree / "note.txt").write_text("no")
    (tree / "_own").mkdir()
    (tree / "_own" / ".y.png").write_bytes(tiny(2, 2))
    assert images.files(spark, str(tree)).count() == 4
    assert images.files(spark, str(tree), exact=True).count() == 5


def test_scalars(spark):
    row = spark.range(1).select(
        S.base_name(F.lit("a\\b/c.PNG")).alias("base"), S.extension(F.lit("x/Y.JPeG")).alias("ext"), S.relative_to(F.lit("/r/a/b"), F.lit("/r")).alias("rel"), S.hex_colour(F.lit(1), F.lit(255), F.lit(16)).alias("hex"),
        S.int_or(F.lit("7"), 5).alias("seven"), S.int_or(F.lit("x"), 5).alias("five"), S.round4(F.lit(0.123456)).alias("r4"), S.from_data_uri(F.lit("data:image/png;base64,QUI=")).alias("uri"), S.mime(F.lit("a.svg")).alias("mime"),
        S.hsv(F.lit(255), F.lit(0), F.lit(0)).alias("red"), S.luminance(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("clear"), S.eta(F.lit(2), F.lit(10), F.lit(4.0)).alias("eta"), S.data_uri(F.lit("a.png"), F.lit(b"AB")).alias("data"),
    ).first()
    assert (row.base, row.ext, row.rel, row.hex, row.seven, row.five, row.r4, bytes(row.uri), row.mime) == ("c.PNG", ".jpeg", "a/b", "#01ff10", 7, 5, 0.1235, b"AB", "image/svg+xml")
    assert (row.red.h, row.red.s, row.red.v, row.clear, row.eta, row.data) == (0, 1, 1, 255, 16, "data:image/png;base64,QUI=")


def _library(folder, n=6):
    rng = np.random.default_rng(5)
    for k in range(n):
        (folder / f"i{k}.png").write_bytes(png.encode(I.from_grid(rng.normal(0, 0.12, 64), k)))
    (folder / "broken.png").write_bytes(b"no image")


def test_index_refresh_sees_changes_only(spark, tmp_path):
    folder = tmp_path / "lib"
    folder.mkdir()
    _library(folder)
    store, built = index.Store(spark, str(tmp_path / "index")), []

    def build(rows):
        built.append(rows.count())
        return I.described(images.contents(spark, rows, str(folder)))

    first = store.refresh(images.files(spark, str(folder)), build)
    assert first.count() == 7 and first.where("error IS NOT NULL").count() == 1 and store.version() == 1
    (folder / "i0.png").write_bytes(png.encode(I.from_grid(np.arange(64) / 300, 3)))
    (folder / "i1.png").unlink()
    second = store.refresh(images.files(spark, str(folder)), build)
    assert built[0] == 7 and built[-1] == 1 and second.count() == 6 and store.version() == 2


def test_a_version_counts_once_it_is_done(spark, tmp_path):
    store = index.Store(spark, str(tmp_path / "index"))
    rows = lambda n: spark.createDataFrame([(f"p{k:02}",) for k in range(n)], "path string").repartition(3)
    assert store.version() is None and store.load() is None
    assert store.publish(rows(5)) == 1
    # a build that ended before its mark: what it wrote is not seen, and not written over
    rows(9).write.parquet(str(tmp_path / "index" / "version-2"))
    assert store.version() == 1 and store.load().count() == 5
    assert store.publish(rows(7)) == 3
    got = [(r.path, r.ref_id) for r in store.load().orderBy("path").collect()]
    assert [p for p, _ in got] == [f"p{k:02}" for k in range(7)] and [i for _, i in got] == sorted({i for _, i in got})


def test_search_finds_turned_images_first(spark, tmp_path):
    folder = tmp_path / "lib"
    folder.mkdir()
    _library(folder)
    rows = index.numbered(I.described(images.contents(spark, images.files(spark, str(folder)), str(folder)))).persist()
    ids = {r["path"].rsplit("/", 1)[-1]: r["ref_id"] for r in rows.select("path", "ref_id").collect()}
    asked = {k: I.describe(I.on_background(np.rot90(png.decode((folder / f"i{k}.png").read_bytes())).copy()), True) for k in range(3)}
    plain = I.ranked(rows, asked, 2)
    assert {r["query_id"]: r["ref_id"] for r in plain.where("rank = 1").collect()} == {k: ids[f"i{k}.png"] for k in range(3)}
    net = Network.by_rule(RANKER, lambda r, c: 0.01 if c < 27 else 0.0, lambda r: 0.0)
    full = I.ranked(rows, asked, None, net, blend=0).toPandas()
    assert len(full) == 3 * 6 and (full.groupby("query_id")["rank"].max() == 6).all()
    assert {int(r.query_id): int(r.ref_id) for r in full[full["rank"] == 1].itertuples()} == {k: ids[f"i{k}.png"] for k in range(3)}


def test_search_by_shape(spark, tmp_path):
    folder = tmp_path / "lib"
    folder.mkdir()
    _library(folder, 4)
    rows = index.numbered(I.described(images.contents(spark, images.files(spark, str(folder)), str(folder)), extra=True)).persist()
    ids = {r["path"].rsplit("/", 1)[-1]: r["ref_id"] for r in rows.select("path", "ref_id").collect()}
    asked = {k: I.describe(I.on_background(png.decode((folder / f"i{k}.png").read_bytes())), True, True) for k in range(2)}
    got = I.expert_ranked(rows, asked, 2).collect()
    assert {r["query_id"]: r["ref_id"] for r in got if r["rank"] == 1} == {k: ids[f"i{k}.png"] for k in range(2)}
    assert len(I.expert_ranked(rows, asked, 9, cut=2.0).collect()) == 2 * 4  # nothing reaches the cut: all rows stay


def test_search_by_shape_weighs_200_rows(spark, monkeypatch):
    import inspect

    from facetline.plans import catalogue

    asked = inspect.signature(I.expert_ranked).parameters
    assert asked["cut"].default == 0.0 and asked["most"].default == 200
    seen = []
    monkeypatch.setattr(I, "drawings", lambda *a: spark.range(1))
    monkeypatch.setattr(I, "expert_ranked", lambda index, queries, *a, **b: seen.append((a, b)) or spark.createDataFrame([(1, 2, 0.5, 1)], "query_id long, ref_id long, score double, rank int"))
    catalogue.shape_search_e2e(spark, "/root/testdata/sf0.001")
    assert seen == [((5,), {})]


@pytest.mark.parametrize("depth", [1, 2, 4, 16])
@pytest.mark.parametrize("laced", [0, 1])
def test_png_depths_and_interlacing(depth, laced):
    import struct
    import zlib

    x = np.random.default_rng(depth).integers(0, 1 << depth, (11, 13))
    body = b""
    for left, top, right, down in png.ADAM7 if laced else ((0, 0, 1, 1),):
        for row in x[top::down, left::right]:
            bits = "".join(f"{v:0{depth}b}" for v in row)
            bits += "0" * (-len(bits) % 8)
            body += b"\0" + bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    data = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 11, depth, 0, 0, 0, laced)) + png._chunk(b"IDAT", zlib.compress(body)) + png._chunk(b"IEND", b"")
    want = x >> 8 if depth == 16 else x * 255 // ((1 << depth) - 1)
    assert (png.decode(data)[..., :3] == want[..., None]).all()


def test_hidden_files_are_read(spark, tmp_path):
    tree = tmp_path / "tree"
    for name in (".a.png", "_b.png", "_own/c d.png", "sub/.e.png", "f.png"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(tiny(8, 8))
    from facetline.api import Engine

    found = images.files(spark, str(tree), exact=True)
    assert all(bytes(r.content) == tiny(8, 8) for r in images.contents(spark, found, str(tree)).collect())
    e = Engine(spark, str(tmp_path / "index"))
    assert e.build(str(tree)) == 5 and e.errors().count() == 0


def test_prepared_queries_are_bounded(monkeypatch):
    monkeypatch.setattr(I, "KEPT", 2)
    ready, made = {}, []
    for name in (1, 2, 3, 1, 3):
        assert I._made(ready, name, lambda name=name: made.append(name) or {"name": name}) == {"name": name}
    assert made == [1, 2, 3, 3] and sorted(ready) == [1, 2]
