"""FLAC streams with numpy: an encoder of mono 8-bit blocks and a decoder of Rice residuals and linear predictors.

Both work on all blocks of many streams at once, sample by sample of a block. The decoder starts a lane at each point of
the streams' seek tables, follows it frame by frame, and holds every frame against its CRC-8 and CRC-16. It reads mono
streams of whole blocks with a seek table; ``decode_any`` reads all others (several channels, other sample sizes), one
sample after the other, and is the plain statement of the format that tests hold the fast one against.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

import numpy as np

from .textkit import ragged_take

BLOCK, ORDER, PRECISION, SHIFT, RATE = 192, 4, 12, 9, 8000
#: frames from one seek point to the next
SEEK = 4
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
MAX_RICE = 9


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, full = [], 1 << (bits - 1), (1 << bits) - 1
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & full
        out.append(crc)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[starts[i] : starts[i] + lengths[i]] for each i; leading zeros leave a CRC of zero as it is, so
    strings of differing lengths are aligned at their ends."""
    table, full = (CRC8, 0xFF) if bits == 8 else (CRC16, 0xFFFF)
    crc = np.zeros(len(starts), np.uint32)
    ends = starts + lengths
    for back in range(int(lengths.max(initial=0)), 0, -1):
        byte = np.where(lengths >= back, data[ends - back], 0).astype(np.uint32)
        crc = ((crc << np.uint32(8)) & np.uint32(full)) ^ table[(crc >> np.uint32(bits - 8)) ^ byte]
    return crc


# -- encoder ----------------------------------------------------------------------------------------------------------


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients (blocks, ORDER) by Levinson and Durbin's recursion; sums of products are exact."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : f.shape[1] - k]).sum(axis=1) for k in range(ORDER + 1)], axis=1)
    a, error = np.zeros((len(x), ORDER)), np.maximum(r[:, 0], 1.0)
    for m in range(ORDER):
        k = (r[:, m + 1] - (a[:, :m] * r[:, m:0:-1]).sum(axis=1)) / error
        a[:, :m] = a[:, :m] - k[:, None] * a[:, :m][:, ::-1]
        a[:, m] = k
        error = np.maximum(error * (1 - k * k), 1e-3)
    limit = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -limit, limit - 1).astype(np.int64)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(zigzag values, best parameter, bits) of each row."""
    u = (residual << 1) ^ (residual >> 63)
    bits = np.stack([(u >> k).sum(axis=1) + u.shape[1] * (k + 1) for k in range(MAX_RICE + 1)], axis=1)
    k = bits.argmin(axis=1)
    return u, k, bits[np.arange(len(k)), k]


class _Bits:
    def __init__(self, size: int):
        self.bits = np.zeros(size + 1, np.uint8)  # the last one takes what is written nowhere

    def put(self, at: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            self.bits[at + j] = (values >> (width - 1 - j)) & 1

    def rice(self, at: np.ndarray, u: np.ndarray, k: np.ndarray) -> None:
        k = k[:, None]
        q = u >> k
        lengths = q + 1 + k
        mark = at[:, None] + np.cumsum(lengths, axis=1) - lengths + q
        self.bits[mark] = 1
        for j in range(int(k.max(initial=0))):
            self.bits[np.where(j < k, mark + k - j, len(self.bits) - 1)] = (u >> j) & 1


def _numbers(numbers: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Frame numbers as in UTF-8, by length: (which frames, their bytes)."""
    out, low = [], 0
    for extra, high in ((0, 1 << 7), (1, 1 << 11), (2, 1 << 16), (3, 1 << 21), (4, 1 << 26), (5, 1 << 31)):
        at = np.flatnonzero((numbers >= low) & (numbers < high))
        n, low = numbers[at], high
        lead = (0xFF00 >> (extra + 1)) & 0xFF if extra else 0
        out.append((at, [lead | (n >> (6 * extra)), *(0x80 | ((n >> (6 * k)) & 0x3F) for k in range(extra - 1, -1, -1))]))
    return out


def encode_blocks(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of one frame for each row of ``x`` (blocks, BLOCK), signed 8-bit samples."""
    x = x.astype(np.int64)
    n = len(x)
    a = _predictors(x)
    guess = sum(a[:, i : i + 1] * x[:, ORDER - 1 - i : BLOCK - 1 - i] for i in range(ORDER)) >> SHIFT
    linear, linear_k, linear_bits = _rice(x[:, ORDER:] - guess)
    first, first_k, first_bits = _rice(np.diff(x, axis=1))
    head = 8 + 10  # subframe header; method, partition order and one parameter
    sizes = np.stack([head + 8 * ORDER + 9 + ORDER * PRECISION + linear_bits, head + 8 + first_bits, np.full(n, 8 + 8 * BLOCK), np.where((x == x[:, :1]).all(axis=1), 16, 1 << 40)], axis=1)
    kind = sizes.argmin(axis=1)
    numbered = _numbers(numbers)
    heads = np.zeros(n, np.int64)
    for at, columns in numbered:
        heads[at] = 5 + len(columns)
    lengths = heads + (sizes[np.arange(n), kind] + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = _Bits(8 * int(starts[-1]))
    base = 8 * (starts[:-1] + heads)

    at = np.flatnonzero(kind == 0)
    here = base[at]
    out.put(here, np.full(len(at), (32 + ORDER - 1) << 1), 8)
    for i in range(ORDER):
        out.put(here + 8 + 8 * i, x[at, i] & 0xFF, 8)
    here = here + 8 + 8 * ORDER
    out.put(here, np.full(len(at), ((PRECISION - 1) << 5) | SHIFT), 9)
    for i in range(ORDER):
        out.put(here + 9 + PRECISION * i, a[at, i] & ((1 << PRECISION) - 1), PRECISION)
    here = here + 9 + PRECISION * ORDER
    out.put(here, linear_k[at], 10)
    out.rice(here + 10, linear[at], linear_k[at])

    at = np.flatnonzero(kind == 1)
    out.put(base[at], np.full(len(at), (8 + 1) << 1), 8)
    out.put(base[at] + 8, x[at, 0] & 0xFF, 8)
    out.put(base[at] + 16, first_k[at], 10)
    out.rice(base[at] + 26, first[at], first_k[at])

    at = np.flatnonzero(kind == 2)
    out.put(base[at], np.full(len(at), 2), 8)
    out.put(base[at][:, None] + 8 + 8 * np.arange(BLOCK), x[at] & 0xFF, 8)

    at = np.flatnonzero(kind == 3)
    out.put(base[at] + 8, x[at, 0] & 0xFF, 8)

    data = np.packbits(out.bits[:-1])
    for k, byte in enumerate((0xFF, 0xF8, 0x14, 0x02)):  # fixed blocks of 192 samples, 8 kHz, mono, 8 bits
        data[starts[:-1] + k] = byte
    for at, columns in numbered:
        for k, column in enumerate(columns):
            data[starts[at] + 4 + k] = column
    data[starts[:-1] + heads - 1] = crcs(data, starts[:-1], heads - 1, 8)
    whole = crcs(data, starts[:-1], lengths - 2, 16)
    data[starts[1:] - 2], data[starts[1:] - 1] = whole >> 8, whole & 0xFF
    return data, starts


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (a positive multiple of BLOCK unsigned 8-bit samples). Equal payloads, equal streams."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8) ^ np.uint8(0x80)
    x = raw.view(np.int8).reshape(-1, BLOCK)
    begins = np.concatenate([[0], np.cumsum(counts)])
    data, starts = encode_blocks(x, np.arange(len(x)) - np.repeat(begins[:-1], counts))
    lengths, out = np.diff(starts), []
    for i, n in enumerate(counts.tolist()):
        a, b = int(begins[i]), int(begins[i + 1])
        own = lengths[a:b]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | (n * BLOCK)).to_bytes(8, "big") + hashlib.md5(raw[a * BLOCK : b * BLOCK].tobytes()).digest()
        points = np.arange(a, b, SEEK)
        table = np.zeros(len(points), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        table["sample"], table["offset"], table["n"] = (points - a) * BLOCK, starts[points] - starts[a], BLOCK
        out.append(b"".join((b"fLaC\x00\x00\x00\x22", info, b"\x83", (18 * len(points)).to_bytes(3, "big"), table.tobytes(), data[starts[a] : starts[b]].tobytes())))
    return out


# -- decoder ----------------------------------------------------------------------------------------------------------


@dataclass
class Info:
    min_block: int
    max_block: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: np.ndarray  # sample, offset of the frame that begins with it
    frames: int  # offset of the first frame in the stream


POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
NO_POINT = (1 << 64) - 1


def metadata(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, points, last = 4, None, np.empty((0, 2), np.int64), False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = (*struct.unpack(">HH", body[:4]), packed >> 44, ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), body[18:34])
        elif kind == 3:
            found = np.frombuffer(body, POINT)
            found = found[found["sample"] != NO_POINT]
            points = np.stack([found["sample"].astype(np.int64), found["offset"].astype(np.int64)], axis=1)
        at += 4 + size
    if info is None:
        raise ValueError("no STREAMINFO")
    return Info(*info, points, at)


class _Window:
    """64 bits from any byte on, for reads of up to 56 bits at many places at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.full(16, 0xFF, np.uint8)])  # ones, so that a damaged code ends
        self.words = np.zeros(len(data) + 8, np.uint64)
        for k in range(8):
            self.words |= padded[k : k + len(self.words)].astype(np.uint64) << np.uint64(56 - 8 * k)

    def at(self, p: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(p >> 3, len(self.words) - 1)] << (p & 7).astype(np.uint64)

    def unsigned(self, p: np.ndarray, width) -> np.ndarray:
        width = np.asarray(width).astype(np.uint64)
        return ((self.at(p) >> (np.uint64(63) - width)) >> np.uint64(1)).astype(np.int64) if width.ndim else (self.at(p) >> np.uint64(64 - int(width))).astype(np.int64)

    def signed(self, p: np.ndarray, width) -> np.ndarray:
        value = self.unsigned(p, width)
        half = np.int64(1) << (np.asarray(width, np.int64) - 1).clip(0)
        return np.where(np.asarray(width) > 0, (value ^ half) - half, 0)

    def zeros(self, p: np.ndarray) -> np.ndarray:
        """Number of zero bits from each place to the next one bit."""
        out, open_ = np.zeros(len(p), np.int64), None
        while True:
            here = self.at(p if open_ is None else p[open_] + out[open_]) >> np.uint64(11)
            lead = 52 - ((here.astype(np.float64).view(np.int64) >> 52) - 1023)
            lead = np.where(here == 0, 46, np.minimum(lead, 46))  # 46 bits are sure to be there
            if open_ is None:
                out += lead
                open_ = np.flatnonzero(lead == 46)
            else:
                out[open_] += lead
                open_ = open_[lead == 46]
            if not len(open_):
                return out


def _frame(window: _Window, data: np.ndarray, begin: np.ndarray, block: int, bits: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples (block, lanes), end) of the frame that begins at each byte; raises if one is not sound."""
    lead = data[begin + 4]
    extra = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, np.where(lead < 0xFE, 5, 6))))))
    number = np.where(extra == 0, lead, lead & (0x3F >> extra)).astype(np.int64)
    for k in range(int(extra.max(initial=0))):
        number = np.where(k < extra, (number << 6) | (data[begin + 5 + np.minimum(k, extra)] & 0x3F), number)
    code = data[begin + 2] >> 4
    more = np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.select([(data[begin + 2] & 15) == 12, ((data[begin + 2] & 15) == 13) | ((data[begin + 2] & 15) == 14)], [1, 2], 0)
    size = 5 + extra + more
    sound = (data[begin] == 0xFF) & (data[begin + 1] == 0xF8) & (data[begin + 3] >> 4 == 0) & (number == numbers)
    if not (sound & (crcs(data, begin, size, 8) == data[begin + size])).all():
        raise ValueError("a frame header doesn't match its CRC-8, or is not the expected one")

    p = 8 * (begin + size + 1)
    kind = window.unsigned(p + 1, 6)
    if window.unsigned(p + 7, 1).any():
        raise NotImplementedError("wasted bits")
    p = p + 8
    is_constant, is_raw = kind == 0, kind == 1
    is_fixed, is_linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (is_constant | is_raw | is_fixed | is_linear).all():
        raise ValueError("reserved kind of subframe")
    order = np.where(is_fixed, kind - 8, np.where(is_linear, kind - 31, np.where(is_constant, 1, 0)))
    most = int(order.max(initial=0))
    out = np.zeros((block, len(begin)), np.int64)
    for t in range(most):
        warm = t < order
        out[t] = np.where(warm, window.signed(p, bits), 0)
        p = p + np.where(warm, bits, 0)
    a, shift = np.zeros((most, len(begin)), np.int64), np.zeros(len(begin), np.int64)
    for known, row in enumerate(FIXED[: most + 1]):
        for i, value in enumerate(row):
            a[i, is_fixed & (order == known)] = value
    if most:
        a[0, is_constant] = 1
    at = np.flatnonzero(is_linear)
    if len(at):
        precision = window.unsigned(p[at], 4) + 1
        shift[at] = window.signed(p[at] + 4, 5)
        p[at] += 9
        for i in range(most):
            there = i < order[at]
            a[i, at] = np.where(there, window.signed(p[at], precision), 0)
            p[at] += np.where(there, precision, 0)
    # residuals: Rice parameter k, or plain numbers of ``plain`` bits (verbatim samples, escaped partitions), or none
    coded = is_fixed | is_linear
    wide = np.where(coded & (window.unsigned(p, 2) == 1), 5, 4)
    parts = np.where(coded, block >> window.unsigned(p + 2, 4), block)
    p = p + np.where(coded, 6, 0)
    k, plain = np.zeros(len(begin), np.int64), np.where(is_raw, bits, 0)
    due = np.where(coded, 0, block)  # sample at which the next partition begins
    any_plain = bool(is_raw.any() | is_constant.any())
    for t in range(block):
        new = np.flatnonzero(due == t)
        if len(new):
            width = wide[new]
            param = window.unsigned(p[new], width)
            p[new] += width
            escaped = param == (1 << width) - 1
            k[new] = np.where(escaped, 0, param)
            plain[new] = np.where(escaped, window.unsigned(p[new], 5), -1)
            p[new] += np.where(escaped, 5, 0)
            due[new] += parts[new]
            any_plain = bool((plain >= 0).any())
        if t < most or any_plain:
            live = t >= order
            rice = np.flatnonzero(live & (plain < 0))
            flat = np.flatnonzero(live & (plain > 0))
            residual = np.zeros(len(begin), np.int64)
            residual[flat] = window.signed(p[flat], plain[flat])
            p[flat] += plain[flat]
            residual[rice], used = _codes(window, p[rice], k[rice])
            p[rice] += used
        else:
            live = True
            residual, used = _codes(window, p, k)
            p = p + used
        guess = 0
        for i in range(min(most, t)):
            guess = guess + a[i] * out[t - 1 - i]
        value = residual + (guess >> shift if most else 0)
        out[t] = value if live is True else np.where(live, value, out[t])
    end = (p + 7) >> 3
    if (end > len(data) - 2).any() or not (crcs(data, begin, end - begin, 16) == (data[end].astype(np.uint32) << np.uint32(8) | data[end + 1])).all():
        raise ValueError("a frame doesn't match its CRC-16")
    return out, end + 2


def _codes(window: _Window, p: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, bits read) of one Rice code in each lane."""
    q = window.zeros(p)
    u = (q << k) | window.unsigned(p + q + 1, k)
    return (u >> 1) ^ -(u & 1), q + 1 + k


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Signed samples of each stream; every frame is held against its checksums, the whole against its length."""
    infos = [metadata(s) for s in streams]
    out: list = [None] * len(streams)
    fast = []
    for i, m in enumerate(infos):
        if m.channels == 1 and m.min_block == m.max_block and m.samples and m.samples % m.max_block == 0 and len(m.points) and m.points[0, 0] == 0 and m.bits <= 16:
            fast.append(i)
        else:
            out[i] = decode_any(streams[i])[0]
    for block, bits in sorted({(infos[i].max_block, infos[i].bits) for i in fast}):
        own = [i for i in fast if (infos[i].max_block, infos[i].bits) == (block, bits)]
        data = np.frombuffer(b"".join(streams[i] for i in own) + bytes(16), np.uint8)
        bases = np.cumsum([0] + [len(streams[i]) for i in own])
        totals = np.array([infos[i].samples // block for i in own])
        firsts = np.concatenate([[0], np.cumsum(totals)])
        begin = np.concatenate([bases[k] + infos[i].frames + infos[i].points[:, 1] for k, i in enumerate(own)])
        number = np.concatenate([infos[i].points[:, 0] // block for i in own])
        place = np.concatenate([firsts[k] + infos[i].points[:, 0] // block for k, i in enumerate(own)])
        until = np.append(place[1:], firsts[-1])
        samples, window = np.empty((int(firsts[-1]), block), np.int32), _Window(data)
        lanes = np.arange(len(begin))
        while len(lanes):
            got, ends = _frame(window, data, begin[lanes], block, bits, number[lanes])
            samples[place[lanes]] = got.T
            begin[lanes], number[lanes], place[lanes] = ends, number[lanes] + 1, place[lanes] + 1
            lanes = lanes[place[lanes] < until[lanes]]
        for k, i in enumerate(own):
            out[i] = samples[firsts[k] : firsts[k + 1]].reshape(-1)
    return out


def pcm_blocks(stream: bytes) -> list[tuple[int, bytes]]:
    """(sample offset, little-endian signed PCM) of each block of a mono stream, by the fast decoder."""
    info = metadata(stream)
    samples = decode([stream])[0]
    kind = "<i1" if info.bits <= 8 else "<i2" if info.bits <= 16 else "<i4"
    return [(at, samples[at : at + info.max_block].astype(kind).tobytes()) for at in range(0, len(samples), info.max_block)]


def seek(stream: bytes, sample: int) -> tuple[int, int]:
    """(first sample, offset in the stream) of the last seek point at or before ``sample``."""
    info = metadata(stream)
    k = int(np.searchsorted(info.points[:, 0], sample, side="right")) - 1
    return (int(info.points[k, 0]), info.frames + int(info.points[k, 1])) if k >= 0 else (0, info.frames)


class _Reader:
    def __init__(self, stream: bytes, at: int):
        self.value, self.size, self.at = int.from_bytes(stream, "big"), 8 * len(stream), 8 * at

    def bits(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the stream ends early")
        self.at += n
        return (self.value >> (self.size - self.at)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.bits(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.bits(1):
            n += 1
        return n


def _subframe(r: _Reader, block: int, bits: int) -> list[int]:
    r.bits(1)
    kind, wasted = r.bits(6), r.bits(1)
    wasted = r.zeros() + 1 if wasted else 0
    bits -= wasted
    if kind == 0:
        x = [r.signed(bits)] * block
    elif kind == 1:
        x = [r.signed(bits) for _ in range(block)]
    else:
        order = kind - 8 if kind < 32 else kind - 31
        if not (8 <= kind <= 12 or kind >= 32):
            raise ValueError("reserved kind of subframe")
        x, a, shift = [r.signed(bits) for _ in range(order)], FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = r.bits(4) + 1, r.signed(5)
            a = [r.signed(precision) for _ in range(order)]
        wide, parts = 5 if r.bits(2) else 4, r.bits(4)
        for part in range(1 << parts):
            k = r.bits(wide)
            plain = r.bits(5) if k == (1 << wide) - 1 else None
            for _ in range((block >> parts) - (order if not part else 0)):
                if plain is None:
                    u = r.zeros() << k
                    u |= r.bits(k) if k else 0
                    residual = (u >> 1) ^ -(u & 1)
                else:
                    residual = r.signed(plain)
                x.append(residual + (sum(c * v for c, v in zip(a, reversed(x[-order:] if order else []), strict=True)) >> shift))
    return [v << wasted for v in x]


def decode_any(stream: bytes) -> list[np.ndarray]:
    """Samples of every channel of any stream, sample by sample."""
    info, data = metadata(stream), np.frombuffer(stream, np.uint8)
    at, out = info.frames, [[] for _ in range(info.channels)]
    while at < len(stream) and (not info.samples or len(out[0]) < info.samples):
        r = _Reader(stream[at:], 0)
        if r.bits(15) != 0x7FFC:
            raise ValueError("no frame")
        r.bits(1)
        size_code, rate_code, channel_code, bits_code = r.bits(4), r.bits(4), r.bits(4), r.bits(3)
        r.bits(1)
        lead = r.bits(8)
        for _ in range(max(0, (~lead & 0xFF and 8 - (~lead & 0xFF).bit_length()) - 1)):
            r.bits(8)
        if not size_code:
            raise ValueError("reserved block size")
        block = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else r.bits(8 * (size_code - 5)) + 1 if size_code < 8 else 256 << (size_code - 8)
        r.bits({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        head = r.at // 8
        if int(crcs(data, np.array([at]), np.array([head]), 8)[0]) != r.bits(8):
            raise ValueError("a frame header doesn't match its CRC-8")
        bits = {0: info.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[bits_code]
        side = {8: 1, 9: 0, 10: 1}.get(channel_code)  # the channel that holds a difference has one bit more
        x = [np.array(_subframe(r, block, bits + (c == side)), np.int64) for c in range(info.channels)]
        if channel_code == 8:
            x[1] = x[0] - x[1]
        elif channel_code == 9:
            x[0] = x[0] + x[1]
        elif channel_code == 10:
            mid = (x[0] << 1) | (x[1] & 1)
            x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
        size = (r.at + 7) // 8
        if int(crcs(data, np.array([at]), np.array([size]), 16)[0]) != int.from_bytes(stream[at + size : at + size + 2], "big"):
            raise ValueError("a frame doesn't match its CRC-16")
        for channel, values in zip(out, x, strict=True):
            channel.extend(values.tolist())
        at += size + 2
    return [np.array(c, np.int64) for c in out]
