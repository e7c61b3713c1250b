"""Image folders: which files count, what they are, and how their bytes become rasters.

PNG is decoded in the tasks. JPEG, GIF, BMP and TIFF go through Spark's image source, which decodes in the JVM, by their
extension; query images by their bytes. All other kinds need a converter: a function (bytes, kind) -> PNG bytes, which travels with the task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import png

Converter = Callable[[bytes, str], bytes]
JVM = (".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff")
LEADING = re.compile(rb"\A(?:[ \t\r\n]|\xef\xbb\xbf)+")


def sniffed(data: bytes) -> str:
    """As ``functions.scalars.sniff``, with png, jpeg, gif and tiff besides."""
    for kind, begins in (("png", png.SIGNATURE), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("tiff", b"II*\x00"), ("tiff", b"MM\x00*")):
        if data.startswith(begins):
            return kind
    low = LEADING.sub(b"", data[: S.HEAD]).lower()
    if low.startswith(b"riff") and low[8:12] == b"webp" and len(low) > 12:
        return "webp"
    if low[4:8] == b"ftyp" and low[8:12] in (b"avif", b"avis"):
        return "avif"
    if b"<svg" in low or b"<!doctype svg" in low:
        return "svg"
    return "bmp" if low.startswith(b"bm") else ""


def decode(data: bytes, hint: str = "", converter: Converter | None = None) -> np.ndarray:
    """(h, w, 4) uint8. What isn't PNG goes to the converter, with the kind its bytes show or else the hint."""
    try:
        return png.decode(data)
    except ValueError as e:
        if converter is None:
            raise ValueError(f"{sniffed(data) or hint or 'unknown'}: {e}") from e
    return png.decode(converter(data, sniffed(data) or hint.lstrip(".")))


def raster_of(image) -> np.ndarray:
    """Of a row of Spark's image source (BGR or BGRA, or grey)."""
    x = np.frombuffer(bytes(image["data"]), np.uint8).reshape(image["height"], image["width"], image["nChannels"])
    out = np.full((*x.shape[:2], 4), 255, np.uint8)
    out[..., :3] = x[..., 2::-1] if x.shape[2] >= 3 else x
    if x.shape[2] == 4:
        out[..., 3] = x[..., 3]
    return out


def decode_query(spark: SparkSession, data: bytes, converter: Converter | None = None) -> np.ndarray:
    """As ``decode``, on the driver; JPEG, GIF, BMP and TIFF by its JVM."""
    if sniffed(data) not in ("jpeg", "gif", "bmp", "tiff"):
        return decode(data, "", converter)
    io, out = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.ByteArrayOutputStream()
    found = io.read(spark._jvm.java.io.ByteArrayInputStream(bytearray(data)))
    if found is None or not io.write(found, "png", out):
        return decode(data, "", converter)
    return png.decode(bytes(out.toByteArray()))


def _as_png(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"].map(unquote), "as_png": [png.encode(raster_of(r)) for r in batch[["height", "width", "nChannels", "data"]].to_dict("records")]})


def through_jvm(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """``rows`` (path, content and others) with PNG as the content of the JPEG, GIF, BMP and TIFF files under root. What the JVM
    can't read keeps its content."""
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in JVM) + "}"
    image = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("_metadata.file_path", "image.*").where("height > 0")
    made = image.select(F.col("file_path").alias("path"), "height", "width", "nChannels", "data").mapInPandas(_as_png, "path string, as_png binary")
    return rows.join(made, "path", "left").withColumn("content", F.coalesce("as_png", "content")).drop("as_png")


def files(spark: SparkSession, root: str, exact: bool = False) -> DataFrame:
    """path, mtime and length of the supported files under root; folders that start with a dot are left out.

    Spark's listing also leaves out files that start with a dot or underscore, and folders with an underscore; with
    ``exact`` the driver lists the tree itself and they are kept."""
    if not exact:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("mtime"), "length")
        return found.where(S.supported("path"))
    jvm, rows = spark._jvm, []
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    todo = [top]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isDirectory():
                if not s.getPath().getName().startswith("."):
                    todo.append(s.getPath())
            else:
                rows.append((s.getPath().toString(), s.getModificationTime() / 1000, s.getLen()))
    listed = spark.createDataFrame(sorted(rows), "path string, seconds double, length long")
    return listed.select("path", F.timestamp_seconds("seconds").alias("mtime"), "length").where(S.supported("path"))


def _hidden_read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def read(path: str) -> bytes | None:
        try:
            local = path.startswith(("file:", "/"))
            files, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
            with files.open_input_file(name) as file:
                return file.read()
        except (OSError, ValueError):
            return None

    for batch in batches:
        content = [read(p) if c is None else c for p, c in zip(batch["path"], batch["content"], strict=True)]
        yield batch.assign(content=pd.Series(content, index=batch.index, dtype=object))


def contents(spark: SparkSession, found: DataFrame, root: str) -> DataFrame:
    """``found`` with content, read by the tasks; the join is by path, and content is read for matching files only. Files
    that Spark's listing hides are read by path in the tasks; their content is null if that fails. Kinds that the JVM
    decodes come as PNG."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    rows = found.join(raw, "path", "left")
    kind = rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    return through_jvm(spark, rows.mapInPandas(_hidden_read, kind), root)
