"""The engine over files: build, search, labelled queries, recall, streaming."""

import base64
import time

import numpy as np
import pytest

from facetline.api import Engine
from facetline.operators.mlp import RANKER, Network
from facetline.plans import image_search as I
from facetline.sources import generator, images, png
from facetline.sources.index import Store
from facetline.streaming.refresh import follow


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    folder = tmp_path_factory.mktemp("library")
    rng = np.random.default_rng(9)
    for k in range(8):
        (folder / f"i{k}.png").write_bytes(png.encode(I.from_grid(rng.normal(0, 0.12, 64), k)))
    (folder / "clear.png").write_bytes(png.encode(np.zeros((9, 9, 4), np.uint8)))
    return folder


@pytest.fixture(scope="module")
def engine(spark, library, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index")))
    assert e.build(str(library)) == 8
    return e


def test_state_and_names(engine):
    s = engine.status()
    assert s["images"] == 8 and s["version"] == 1 and s["build"]["state"] == "idle"
    assert [r.path.rsplit("/")[-1] for r in engine.names().collect()] == [f"i{k}.png" for k in range(8)]
    assert engine.errors().first().error == "nothing is covered"


def test_search_by_bytes_path_and_uri(engine, library):
    image = png.encode(I.on_background(np.rot90(png.decode((library / "i4.png").read_bytes())).copy()))
    hits = engine.search(image, 3)
    assert len(hits) == 3 and hits[0]["imageId"].endswith("i4.png")
    assert engine.search_uri("data:image/png;base64," + base64.b64encode(image).decode(), 3) == hits
    (library.parent / "q.png").write_bytes(image)
    assert engine.search_path(str(library.parent / "q.png"), 3) == hits
    assert len(engine.search(image, 0)) == 5
    with pytest.raises(ValueError):
        engine.search(png.encode(np.full((30, 30, 3), 200, np.uint8)))


def test_labelled_queries_and_recall(spark, engine, library):
    found = images.contents(spark, images.files(spark, str(library)), str(library))
    made = generator.generated(spark, found, 12, seed=3).persist()
    rows = made.orderBy("image").collect()
    again = generator.generated(spark, found, 12, seed=3).orderBy("image").collect()
    assert rows == again and 0 < len(rows) <= 12
    for r in rows:
        x = png.decode(bytes(r.content))
        assert x.shape[:2] == (r.canvas[1], r.canvas[0]) and not r.src.endswith("clear.png")
    recall = {r.k: r.recall for r in engine.evaluate(made).collect()}
    assert recall[3] >= recall[1] >= 0.5


def test_weights_are_checked(spark, engine, tmp_path):
    Network.random(RANKER, seed=1).to_frame(spark).write.parquet(str(tmp_path / "good"))
    Network.random((3, 1), seed=1).to_frame(spark).write.parquet(str(tmp_path / "bad"))
    assert Engine(spark, engine.store.root, str(tmp_path / "good")).network.widths == RANKER
    with pytest.raises(ValueError):
        Engine(spark, engine.store.root, str(tmp_path / "bad"))


def test_background_build(spark, library, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    e.start_build(str(library))
    for _ in range(300):
        if e.job.state != "running":
            break
        time.sleep(0.2)
    assert (e.job.state, e.job.done, e.job.total) == ("done", 8, 9)
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "none")).load()


def test_stream_takes_in_what_arrives(spark, library, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    store = Store(spark, str(tmp_path / "index"))
    for k in (0, 1):
        (folder / f"i{k}.png").write_bytes((library / f"i{k}.png").read_bytes())
    follow(spark, str(folder), store, str(tmp_path / "state")).awaitTermination(120)
    assert store.load().count() == 2
    (folder / "i2.png").write_bytes((library / "i2.png").read_bytes())
    follow(spark, str(folder), store, str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.path.rsplit("/")[-1] for r in store.load().collect()) == ["i0.png", "i1.png", "i2.png"] and store.version() == 2


@pytest.mark.parametrize("kind", ["jpg", "gif", "bmp", "tif"])
def test_kinds_of_the_jvm_are_built_and_searched(spark, tmp_path, kind):
    raster = np.full((48, 48, 3), 255, np.uint8)
    raster[8:40, 8:20] = raster[28:40, 8:40] = (200, 40, 30)
    io = spark._jvm.javax.imageio.ImageIO
    source = io.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(png.encode(raster))))
    (tmp_path / "lib").mkdir()
    file = tmp_path / "lib" / f"a é%20.{kind.upper()}"
    assert io.write(source, {"tif": "tiff"}.get(kind, kind), spark._jvm.java.io.File(str(file)))
    data = file.read_bytes()
    assert images.sniffed(data) == {"jpg": "jpeg", "tif": "tiff"}.get(kind, kind)
    e = Engine(spark, str(tmp_path / "index"))
    assert e.build(str(tmp_path / "lib")) == 1 and e.errors().count() == 0
    assert e.search(data)[0]["imageId"].endswith(file.name)
    got = images.decode_query(spark, data)
    assert got.shape == (48, 48, 4) and np.abs(got[..., :3].astype(int) - raster).mean() < 8
