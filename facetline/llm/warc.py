"""WARC files of pages, and a Merkle fixity audit of their replicas.

Records are written as gzip members, one after the other. A catalogue has the offset range of each record. Over the
ranges of a file, in order, stands a tree: a leaf hashes a range's place, offset and length and its stored bytes, the last
leaf the file's length and what stands behind the last record, a node the hashes of up to 16 nodes below. Replicas are
compared by their roots, and only below nodes that differ is the next level compared, down to the damaged records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import NativeFile
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import Scratch, place, table

FAN = 16
#: bytes that are hashed at once
BLOCK = 1 << 20
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")


def record(page_id: int | None, url: str | None, body: bytes, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A resource record. Its id is made from page_id, url and body, so writing it again gives the same bytes."""
    name = uuid.uuid5(NAMESPACE, f"{page_id}\n{url}\n{hashlib.sha256(body).hexdigest()}")
    target = url.replace("\r", "%0D").replace("\n", "%0A") if url else ""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\n"
    head += f"WARC-Target-URI: {target}\r\n" if target else ""
    return f"{head}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member without a time, so that equal records are equal bytes."""
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(raw) + out.flush()


CATALOGUE = "file long, name string, place long, page_id long, offset long, length long"


def _write(root: str, replicas: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, outs, at, number = TaskContext.get(), [], 0, 0
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"  # only files that the catalogue lists count
        for batch in batches:
            for part in kit.slices(batch, "html"):
                if not outs:
                    for k in range(replicas):
                        files, path = place(f"{root}/{k}")
                        files.create_dir(path, recursive=True)
                        outs.append(files.open_output_stream(f"{path}/{name}", compression=None))
                rows = []
                for page_id, url, html, damaged in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "damaged")), strict=True):
                    stored = member(record(page_id, url, (html or "").encode()))
                    for k, out in enumerate(outs):
                        out.write(stored if not (k and damaged) else stored[:-9] + bytes([stored[-9] ^ 1]) + stored[-8:])
                    rows.append((task.partitionId(), name, number, page_id, at, len(stored)))
                    at, number = at + len(stored), number + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), *[pa.int64()] * 4), strict=True)], [c.split()[0] for c in CATALOGUE.split(", ")])
        for out in outs:
            out.close()

    return run


def write(pages: DataFrame, root: str, replicas: int = 1, damaged: Column | None = None) -> DataFrame:
    """Writes every page (page_id, url, html; other columns are ignored) to files under root/0, root/1 and so on, one
    for each partition, and gives the catalogue: file, name, place, page_id, offset and length of each record.

    ``damaged`` marks records of which replicas other than 0 get a wrong byte, for drills. Null html is an empty body,
    a null url no target; repeated rows are records of their own; an empty table writes no file."""
    place(root)  # raises here where no task could write
    flag = F.coalesce(damaged, F.lit(False)) if damaged is not None else F.lit(False)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), flag.alias("damaged"))
    return rows.mapInArrow(_write(root, replicas), CATALOGUE)


def _leaf(file: NativeFile | None, place: int, at: int, length: int) -> str:
    """Of a range, or from ``at`` to the end of the file if ``length`` is below 0."""
    size = -1 if file is None else file.size()
    out = hashlib.sha256(b"\x00" + struct.pack("<qqq", place, at, length if length >= 0 else -2 - size))
    end = at + length if length >= 0 else size
    while file is not None and at < min(end, size):
        raw = file.read_at(min(BLOCK, end - at), at)
        out.update(raw)
        at += len(raw)
    return out.hexdigest()


def _hash(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = place(root)
        name = file = None
        for batch in batches:
            hashes = []
            for here, number, at, length in zip(*(batch.column(c).to_pylist() for c in ("name", "place", "offset", "length")), strict=True):
                if here != name:
                    if file is not None:
                        file.close()
                    found = files.get_file_info(f"{path}/{here}").is_file
                    name, file = here, files.open_input_file(f"{path}/{here}") if found else None
                hashes.append(_leaf(file, number, at, length))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("place"), pa.array(hashes)], ["file", "place", "hash"])
        if file is not None:
            file.close()

    return run


def ranges(catalogue: DataFrame) -> DataFrame:
    """The catalogue with one more row for each file, without a page_id and with length -1: what is behind its records."""
    ends = catalogue.groupBy("file", "name").agg((F.max("place") + 1).alias("place"), F.max(F.col("offset") + F.col("length")).alias("offset"))
    return catalogue.unionByName(ends.withColumn("page_id", F.lit(None).cast("long")).withColumn("length", F.lit(-1).cast("long")))


def leaves(listed: DataFrame, root: str, files: int) -> DataFrame:
    """file, place and hash of every listed range as the replica under ``root`` has it; a lost file, or one that ends
    early, is hashed as if the range had what is left of it."""
    each = listed.select(F.col("file").cast("int").alias("file"), "name", "place", "offset", "length").repartitionById(files, F.col("file")).sortWithinPartitions("place")
    return each.select(F.col("file").cast("long").alias("file"), "name", "place", "offset", "length").mapInArrow(_hash(root), "file long, place long, hash string")


def extra_files(one: str, other: str) -> list[str]:
    """Names of files that only the replica under ``other`` has: a name for each file, not for each record."""

    def names(root: str) -> set[str]:
        files, path = place(root)
        found = files.get_file_info(FileSelector(path, recursive=True, allow_not_found=True))
        return {x.path.removeprefix(path).lstrip("/") for x in found if x.is_file}

    return sorted(names(other) - names(one))


def _above(nodes: DataFrame) -> DataFrame:
    """The next level: place div 16; at most 16 hashes meet in a group."""
    grouped = nodes.groupBy("file", F.floor(F.col("place") / FAN).cast("long").alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("below"))
    joined = F.concat_ws("", F.lit("01"), F.transform("below", lambda x: x["hash"]))
    return grouped.select("file", "place", F.sha2(F.unhex(joined), 256).alias("hash"))


def tree(bottom: DataFrame, depth: int, rows: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """The levels of every file's tree, leaves first, roots last; there are about ``rows`` leaves."""
    levels = [scratch.put(bottom, f"{name}-0")]
    for k in range(depth):
        rows = -(-rows // FAN)
        levels.append(scratch.put(_above(levels[-1]), f"{name}-{k + 1}", rows))
    return levels


def differing(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """(file, place) of the leaves that differ or that one side lacks: level by level from the roots, below differing nodes
    only."""
    suspects = None
    for mine, theirs in zip(reversed(one), reversed(other), strict=True):
        if suspects is not None:
            parent = suspects.select("file", F.col("place").alias("parent"))
            mine, theirs = (x.withColumn("parent", F.floor(F.col("place") / FAN).cast("long")).join(parent, ["file", "parent"], "left_semi").drop("parent") for x in (mine, theirs))
        suspects = mine.join(theirs.select("file", "place", F.col("hash").alias("their")), ["file", "place"], "full").where("NOT hash <=> their").select("file", "place")
    return suspects


def audited(catalogue: DataFrame, one: str, other: str, scratch: Scratch, others: DataFrame | None = None) -> DataFrame:
    """The ranges of the catalogue with the SHA-256 leaf of the replica under ``one``, and damaged: does ``other`` differ
    there? The row without a page_id of each file tells of bytes behind its records, or of missing ones.

    ``others`` is the catalogue of ``other`` where it has its own: a range that it has elsewhere then counts as damaged."""
    listed = scratch.put(ranges(catalogue), "ranges")
    theirs = listed if others is None else scratch.put(ranges(others), "their-ranges")
    most = listed.union(theirs).agg(F.max("place"), F.max("file")).first()
    depth, nodes, rows = 0, (most[0] or 0) + 1, listed.count()
    while nodes > 1:
        depth, nodes = depth + 1, -(-nodes // FAN)
    files = (most[1] or 0) + 1
    trees = [tree(leaves(x, root, files), depth, rows, scratch, name) for x, root, name in ((listed, one, "one"), (theirs, other, "other"))]
    found = scratch.put(differing(*trees), "found", rows)
    out = listed.join(trees[0][0], ["file", "place"]).join(found.withColumn("damaged", F.lit(True)), ["file", "place"], "left").withColumn("damaged", F.coalesce("damaged", F.lit(False)))
    scratch.drop(*(f"{name}-{k}" for name in ("one", "other") for k in range(1, depth + 1)), "other-0", "their-ranges")
    return out


def op9_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every page's record in a replica with one page of 64 damaged, as the audit finds it, and the rest of each file."""
    scratch = Scratch(spark, "warc")
    damaged = F.crc32(F.col("page_id").cast("string").cast("binary")) % 64 == 0
    catalogue = scratch.put(write(table(spark, sf_dir, "pages"), scratch.path("files"), 2, damaged), "catalogue")
    out = audited(catalogue, scratch.path("files/0"), scratch.path("files/1"), scratch)
    scratch.drop("files", "catalogue")
    return out.select("page_id", "file", "place", "offset", "length", F.col("hash").alias("leaf_sha256"), "damaged")
