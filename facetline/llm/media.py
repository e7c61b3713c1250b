"""Media columns: texts stored as FLAC streams, read back and described."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from . import textkit as kit
from .shared import packed, table


def payload(text: bytes) -> bytes:
    """The text's bytes, with spaces up to a positive multiple of a block."""
    return text + b" " * (-len(text) % flac.BLOCK if text else flac.BLOCK)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kit.unpacked(batches):
        for part in kit.slices(batch, limit=1 << 20):
            texts = pc.fill_null(part.column("text").cast(pa.binary()), b"").to_pylist()
            streams = flac.encode([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(list(map(len, texts)), pa.int64()), pa.array(streams, pa.binary())], ["row", "n_bytes", "media"])


def stored(documents: DataFrame) -> DataFrame:
    """row (a struct of all columns), n_bytes and media (the FLAC stream of the text's payload). Null texts are empty."""
    rows, kind = packed(documents)
    return rows.mapInArrow(kit.tidied(_store), f"row {kind}, n_bytes long, media binary")


def _payloads(part: pa.RecordBatch) -> list[bytes]:
    return [(x.astype(np.int8).view(np.uint8) ^ np.uint8(0x80)).tobytes() for x in flac.decode(part.column("media").to_pylist())]


def feature(samples: bytes) -> str:
    """Blocks, energy and turns (changes of direction) of a payload, as whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    step = np.sign(np.diff(x))
    step = step[step != 0]
    return f"blocks={len(x) // flac.BLOCK};energy={int((x * x).sum())};turns={int((step[1:] != step[:-1]).sum())}"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in kit.slices(batch, "media", limit=4 << 20):
            back, media = _payloads(part), part.column("media").to_pylist()
            columns = [
                part.column("row"),
                part.column("n_bytes"),
                pa.array([len(x) for x in back], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()),
                pa.array([len(x) for x in media], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                pa.array([feature(x) for x in back]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def described(media: DataFrame) -> DataFrame:
    """Digests of what the streams of ``stored`` hold once they are read back. A stream that doesn't match one of its
    checksums raises. Equal texts have equal values; an empty table gives no rows."""
    kind = media.schema["row"].dataType.simpleString()
    return media.mapInArrow(kit.tidied(_describe), f"row {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, media in zip(batch.column("row").to_pylist(), batch.column("media").to_pylist(), strict=True):
            found = flac.pcm_blocks(media)
            yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * len(found), pa.int64()), pa.array([at for at, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["doc_id", "sample_offset", "pcm"])


def pcm(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset and pcm: the decoded blocks of every stream of ``stored``."""
    return media.mapInArrow(_blocks, "doc_id long, sample_offset long, pcm binary")


def op4_flac_media(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return described(stored(documents)).select("row.doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
