"""Vectorised text kernels shared by the document operators (Arrow and numpy, no Spark).

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``; a null text has none.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one struct column ``row`` with its field ``text`` as a column beside it; nothing is copied."""
    for batch in batches:
        row = batch.column("row")
        yield pa.RecordBatch.from_arrays([row, row.field("text").cast(pa.string())], ["row", "text"])


def tidied(run: Callable) -> Callable:
    """``run``, after which memory that is free goes back to the system: workers live on and have other tasks next."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidy


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one long row stays whole)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of many texts: those of text ``i`` are ``codes[starts[i]:starts[i+1]]``, codes index ``vocab``."""

    starts: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, all other bytes as they are (null: empty)."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    raw = np.frombuffer(data, np.uint8)
    raw = raw + ((raw >= 65) & (raw <= 90)).view(np.uint8) * np.uint8(32)
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(raw), offset=texts.offset)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    texts = lowered(texts) if lower else pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    encoded = flat.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, vocab = encoded.indices.to_numpy(), encoded.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index_in(pa.scalar("", pa.large_string()), vocab).as_py()
    if empty is None:
        return Words(offsets, codes, vocab)
    real = codes != empty  # leading and trailing white space leaves empty strings
    return Words(np.concatenate([[0], np.cumsum(real)])[offsets], codes[real], vocab)


def sum_by(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each run; 0 for an empty run."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes_of(vocab: pa.Array) -> np.ndarray:
    """One 64-bit hash for each string, the same in every process."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in vocab.to_pylist()), dtype=np.uint64, count=len(vocab))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent 64-bit hash of each run of ``width`` values; runs cross text borders, callers mask those."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + n]
    return mix64(out)


def window_mask(starts: np.ndarray, width: int) -> np.ndarray:
    """True where a window of ``width`` words begins and ends in the same text."""
    total = int(starts[-1])
    n = total - width + 1
    if n <= 0:
        return np.empty(0, bool)
    left = np.repeat(starts[1:], np.diff(starts))[:n]  # end of the owning text
    return np.arange(n) + width <= left


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
