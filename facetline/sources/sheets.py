"""Descriptors in files of a shared folder, each read by its place.

A descriptor is near 200 KB as Spark's arrays and some 15 KB here. Tables hold its file, offset and length only, so wide rows
are neither shuffled nor held by the JVM, nor do queries go to the tasks inside of a closure: a task reads those that it
works on.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: columns of a place
PLACE = ("file", "at", "size")
PLACE_SCHEMA = "file string, at long, size long"
#: schemes that Hadoop and Arrow spell in different ways
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}
#: files that a reader keeps open
OPEN = 64


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri(f"file://{os.path.abspath(uri)}")
    if scheme == "file":
        return fs.FileSystem.from_uri("file:///" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def made(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder."""
    from ..operators.search import shared

    home = f"{shared(spark)}/sheets-{uuid.uuid4().hex}"
    system, path = _opened(home)  # a store that Arrow doesn't know raises here, before any task runs
    system.create_dir(path, recursive=True)
    return home


@contextmanager
def folder(spark: SparkSession) -> Iterator[str]:
    """A new folder, deleted at the end: for results that are written meanwhile."""
    home = made(spark)
    try:
        yield home
    finally:
        system, path = _opened(home)
        system.delete_dir(path)


class Writer:
    """One file of a task. A task that is run again writes another; what the first wrote is not read."""

    def __init__(self, home: str):
        self.file, self.at = uuid.uuid4().hex, 0
        system, path = _opened(home)
        self.out = system.open_output_stream(f"{path}/{self.file}")

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.out.close()

    def put(self, sheet: dict, packed: bool = True) -> tuple[str, int, int]:
        """``packed`` is of no use to what hardly repeats."""
        data = pickle.dumps(sheet, pickle.HIGHEST_PROTOCOL)
        data = len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if packed else bytes(8) + data
        self.out.write(data)
        self.at += len(data)
        return self.file, self.at - len(data), len(data)


class Reader:
    def __init__(self, home: str):
        self.system, self.path = _opened(home)
        self.files: dict[str, fs.NativeFile] = {}

    def get(self, file: str, at: int, size: int) -> dict:
        if file not in self.files:
            if len(self.files) >= OPEN:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.system.open_input_file(f"{self.path}/{file}")
        data = memoryview(self.files[file].read_at(int(size), int(at)))
        length, data = int.from_bytes(data[:8], "little"), data[8:]
        return pickle.loads(pa.decompress(data, length, codec="zstd") if length else data)


class Sheets(Mapping):
    """Descriptors by id; what a closure takes along are their places. ``vectors`` (id, vector) is for the driver."""

    def __init__(self, home: str, table: DataFrame):
        rows = sorted(table.select("id", *PLACE).toLocalIterator())
        self.home, self.files = home, sorted({r["file"] for r in rows})
        number = {f: k for k, f in enumerate(self.files)}
        self.places = np.array([(r["id"], number[r["file"]], r["at"], r["size"]) for r in rows], np.int64).reshape(-1, 4)
        self.vectors, self._reader = table.select("id", "vector"), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"vectors": None, "_reader": None}

    def __getitem__(self, name: int) -> dict:
        k = int(np.searchsorted(self.places[:, 0], name))
        if k == len(self.places) or self.places[k, 0] != name:
            raise KeyError(name)
        self._reader = self._reader or Reader(self.home)
        _, file, at, size = self.places[k].tolist()
        return self._reader.get(self.files[file], at, size)

    def __iter__(self) -> Iterator[int]:
        return iter(self.places[:, 0].tolist())

    def __len__(self) -> int:
        return len(self.places)
