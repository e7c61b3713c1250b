"""Token files: one independent zstandard frame for each document, and a trailing seek table with checksums.

    frame 0 .. frame n-1     ids of one document, little-endian, ``width`` bytes each
    skippable frame A        width (1 byte), doc_ids (8 bytes each), 1 byte each: is the doc_id there
    skippable frame E        seek table as in the public seekable format: for each frame its compressed size, its size
                             and the low 32 bits of its XXH64; number of frames, descriptor, magic number

Any zstandard reader reads the whole; a reader of single documents reads the table and then only their frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x8F92EAB1, 0x80
TAIL = struct.Struct("<IBI")


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Appends documents to an open binary file; ``close`` writes the tables."""

    def __init__(self, out, width: int = 4, level: int = 1):
        self.out, self.width, self.kind = out, width, np.dtype(f"<u{width}")
        self.frames = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.doc_ids: list[int | None] = []
        self.entries = bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(self.kind).tobytes()
        frame = self.frames.compress(raw)
        self.out.write(frame)
        self.doc_ids.append(doc_id)
        self.entries += struct.pack("<III", len(frame), len(raw), checksum(raw))

    def close(self) -> None:
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        names = np.array([x or 0 for x in self.doc_ids], "<i8")
        body = bytes([self.width]) + names.tobytes() + known.tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE + 10, len(body)) + body)
        self.out.write(struct.pack("<II", SKIPPABLE + 14, len(self.entries) + TAIL.size) + self.entries + TAIL.pack(len(self.doc_ids), CHECKSUMS, SEEKABLE))


class Reader:
    """Reads documents of a seekable binary file; each frame is held against its checksum."""

    def __init__(self, file, size: int):
        self.file = file
        n, flags, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = size - TAIL.size - 12 * n - 8
        head = 9 * n + 1
        raw = self._at(table - head - 8, head + 8 + 8 + 12 * n)
        self.width = raw[8]
        self.kind = np.dtype(f"<u{self.width}")
        names = np.frombuffer(raw, "<i8", n, 9).tolist()
        known = np.frombuffer(raw, np.uint8, n, 9 + 8 * n).tolist()
        self.doc_ids = [name if there else None for name, there in zip(names, known, strict=True)]
        self.entries = np.frombuffer(raw, "<u4", 3 * n, 9 * n + 1 + 16).reshape(n, 3).astype(np.int64)
        self.starts = np.cumsum(self.entries[:, 0]) - self.entries[:, 0]
        self.frames = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _open(self, k: int, frame: bytes) -> np.ndarray:
        raw = self.frames.decompress(frame, max_output_size=int(self.entries[k, 1]))
        if len(raw) != self.entries[k, 1] or checksum(raw) != self.entries[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(raw, self.kind)

    def document(self, k: int) -> np.ndarray:
        """Ids of document ``k``; no other frame is read."""
        return self._open(k, self._at(int(self.starts[k]), int(self.entries[k, 0])))

    def documents(self, chunk: int = 8 << 20) -> Iterator[np.ndarray]:
        """Ids of all documents, read in runs of about ``chunk`` bytes."""
        k = 0
        while k < len(self):
            ends = self.starts[k:] + self.entries[k:, 0] - self.starts[k]
            many = max(1, int(np.searchsorted(ends, chunk, side="right")))
            raw = self._at(int(self.starts[k]), int(ends[many - 1]))
            for i in range(many):
                at = int(self.starts[k + i] - self.starts[k])
                yield self._open(k + i, raw[at : at + int(self.entries[k + i, 0])])
            k += many


def wanted(reader: Reader, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the documents with these doc_ids, each as often as the file has it."""
    out: dict[int, list[np.ndarray]] = {x: [] for x in doc_ids}
    for k, x in enumerate(reader.doc_ids):
        if x in out:
            out[x].append(reader.document(k))
    return out
