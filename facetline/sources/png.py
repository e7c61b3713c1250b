"""PNG in both directions with zlib alone. Reads all depths and interlacing; of 16 bits the upper 8 count."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: first column and row and steps of the seven passes of an interlaced image
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(raster: np.ndarray) -> bytes:
    """(h, w, 4), (h, w, 3) or (h, w) uint8."""
    kind = 0 if raster.ndim == 2 else {3: 2, 4: 6}[raster.shape[2]]
    h, w = raster.shape[:2]
    rows = np.ascontiguousarray(raster).reshape(h, -1)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body, 6)) + _chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    out, above = [], np.zeros(rows.shape[1] - 1, np.int64)
    for row in rows.astype(np.int64):
        kind, x = row[0], row[1:].copy()
        if kind == 1:
            for c in range(step):
                x[c::step] = np.cumsum(x[c::step]) & 255
        elif kind == 2:
            x = (x + above) & 255
        elif kind in (3, 4):
            for i in range(len(x)):
                left, up, corner = (x[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))[2]
                x[i] = (x[i] + guess) & 255
        elif kind:
            raise ValueError("unknown filter")
        out.append(x)
        above = x
    return np.stack(out).astype(np.uint8) if out else np.empty((0, rows.shape[1] - 1), np.uint8)


def _samples(raw: np.ndarray, w: int, h: int, n: int, depth: int) -> tuple[np.ndarray, int]:
    """(h, w, n) values of an image or pass at the start of the bytes, and how many bytes it takes."""
    width = -(-w * n * depth // 8)
    x = _unfiltered(raw[: h * (1 + width)].reshape(h, 1 + width), max(1, n * depth // 8)).reshape(h, width)
    if depth == 16:
        x = x.reshape(h, -1, 2).astype(np.int64) @ np.array([256, 1])
    elif depth < 8:
        x = (x.astype(np.int64)[..., None] >> np.arange(8 - depth, -1, -depth) & ((1 << depth) - 1)).reshape(h, -1)
    return x[:, : w * n].reshape(h, w, n), h * (1 + width)


def decode(data: bytes) -> np.ndarray:
    """(h, w, 4) with straight alpha; raises ValueError for anything else than a sound PNG of the kinds above."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, head, body, palette, alpha = 8, None, [], None, None
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a chunk doesn't match its CRC")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] not in (1, 2, 4, 8, 16) or head[3] not in CHANNELS or head[6] > 1:
        raise ValueError("a PNG that isn't read here")
    w, h, depth, kind = head[:4]
    n = CHANNELS[kind]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if head[6]:
        x, at = np.zeros((h, w, n), np.int64), 0
        for left, top, right, down in ADAM7:
            if left < w and top < h:
                x[top::down, left::right], size = _samples(raw[at:], -(-(w - left) // right), -(-(h - top) // down), n, depth)
                at += size
    else:
        x = _samples(raw, w, h, n, depth)[0]
    out = np.full((h, w, 4), 255, np.uint8)
    if kind == 3:
        out[..., :3] = palette[x[..., 0]]
        if alpha:
            table = np.full(256, 255, np.uint8)
            table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            out[..., 3] = table[x[..., 0]]
    else:
        level = x >> 8 if depth == 16 else x * (255 // ((1 << depth) - 1))
        out[..., :3] = level[..., :3] if n >= 3 else level[..., :1]
        if n in (2, 4):
            out[..., 3] = level[..., -1]
        elif alpha:
            key = np.frombuffer(alpha, ">u2").astype(np.int64)
            out[..., 3] = np.where((x == key[None, None]).all(axis=-1), 0, 255)
    return out
