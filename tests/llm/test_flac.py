"""Streams against the plain decoder, damage, and streams of other shapes written bit by bit."""

import hashlib
import struct

import numpy as np
import pytest

from facetline.llm import flac, media

RNG = np.random.default_rng(0)
PAYLOADS = [media.payload(x) for x in (b"", b"hello", b"a" * 400, bytes(RNG.integers(0, 256, 3000, dtype=np.uint8)), "ünï ".encode() * 500, bytes([0, 255]) * 500, b" " * 192 * 130 + b"x" * 192 * 2200)]


def samples(payload):
    return (np.frombuffer(payload, np.uint8) ^ 0x80).view(np.int8).astype(np.int64)


def test_round_trip_by_both_decoders():
    streams = flac.encode(PAYLOADS)
    for p, s, fast in zip(PAYLOADS, streams, flac.decode(streams), strict=True):
        assert (fast == samples(p)).all()
        if len(p) < 10_000:
            assert (flac.decode_any(s)[0] == samples(p)).all()
        info = flac.metadata(s)
        assert (info.samples, info.bits, info.channels, info.min_block) == (len(p), 8, 1, 192)
        assert info.md5 == hashlib.md5(samples(p).astype(np.int8).tobytes()).digest()
    assert flac.encode(PAYLOADS[::-1])[::-1] == streams


def test_every_damaged_byte_of_a_frame_is_found():
    s = flac.encode([PAYLOADS[3][:192]])[0]
    for at in range(flac.metadata(s).frames, len(s)):
        bad = bytearray(s)
        bad[at] ^= 0x10
        with pytest.raises((ValueError, NotImplementedError)):
            flac.decode([bytes(bad)])


def test_seeking_and_blocks():
    s = flac.encode([PAYLOADS[4]])[0]
    first, offset = flac.seek(s, 900)
    assert first == 768 and s[offset : offset + 2] == b"\xff\xf8"
    blocks = flac.pcm_blocks(s)
    assert [at for at, _ in blocks] == list(range(0, len(PAYLOADS[4]), 192))
    assert b"".join(x for _, x in blocks) == samples(PAYLOADS[4]).astype("<i1").tobytes()


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, n):
        self.s += format(value & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, r, k):
        u = (r << 1) ^ (r >> 63)
        self.s += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def crc(data, bits):
    a = np.frombuffer(data, np.uint8)
    return int(flac.crcs(np.append(a, 0), np.array([0]), np.array([len(a)]), bits)[0])


def stream(channels, code, subframes, bits=16, block=16):
    """A stream of one frame; ``subframes`` write each channel."""
    head = bytes([0xFF, 0xF8, 0x60, (code << 4) | 8, 0, block - 1])
    body = Bits()
    for write in subframes:
        write(body)
    raw = head + bytes([crc(head, 8)]) + body.bytes()
    raw += struct.pack(">H", crc(raw, 16))
    info = struct.pack(">HH", block, block) + bytes(6) + ((8000 << 44) | ((channels - 1) << 41) | ((bits - 1) << 36) | block).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\x00\x00\x22" + info + raw


def fixed(x, order, bits, parts=0, k=3, escape=None, wide=4, wasted=0):
    def write(b):
        b.put(0, 1)
        b.put(8 + order, 6)
        b.put(1 if wasted else 0, 1)
        if wasted:
            b.put(1, wasted)
        v = [a >> wasted for a in x]
        for a in v[:order]:
            b.put(a, bits - wasted)
        b.put(1 if wide == 5 else 0, 2)
        b.put(parts, 4)
        res = [v[t] - sum(c * v[t - 1 - i] for i, c in enumerate(flac.FIXED[order])) for t in range(order, len(v))]
        at, size = 0, len(x) >> parts
        for p in range(1 << parts):
            n = size - (0 if p else order)
            if escape == p:
                b.put((1 << wide) - 1, wide)
                b.put(18, 5)
                for r in res[at : at + n]:
                    b.put(r, 18)
            else:
                b.put(k, wide)
                for r in res[at : at + n]:
                    b.rice(r, k)
            at += n

    return write


def test_stereo_partitions_escapes_and_wasted_bits():
    left = np.cumsum(RNG.integers(-20, 20, 16)).tolist()
    right = (np.array(left) + RNG.integers(-3, 3, 16)).tolist()
    side = [a - b for a, b in zip(left, right, strict=True)]
    mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    for code, x, y, more in ((1, left, right, (0, 0)), (8, left, side, (0, 1)), (9, side, right, (1, 0)), (10, mid, side, (0, 1))):
        s = stream(2, code, [fixed(x, 2, 16 + more[0], parts=2), fixed(y, 1, 16 + more[1], parts=1, escape=1, wide=5)])
        got = flac.decode([s])[0]
        a, b = flac.decode_any(s)
        assert a.tolist() == left and b.tolist() == right and got.tolist() == left
    four = [4 * v for v in left]
    assert flac.decode_any(stream(1, 0, [fixed(four, 3, 16, wasted=2)]))[0].tolist() == four


def test_fast_decoder_reads_partitions_and_escapes():
    x = np.cumsum(RNG.integers(-20, 20, 16)).tolist()
    for parts, escape in ((0, None), (2, None), (2, 0), (1, 1)):
        s = stream(1, 0, [fixed(x, 2, 16, parts=parts, escape=escape)])
        at = 4 + 4 + 34
        point = struct.pack(">QQH", 0, 0, 16)
        s = s[:4] + b"\x00" + s[5:at] + b"\x83\x00\x00\x12" + point + s[at:]
        # its header names the block in another way than the encoder does
        assert flac.decode([s])[0].tolist() == x == flac.decode_any(s)[0].tolist()


def test_media_rows(spark):
    texts = [(1, None, "a"), (2, "", "b"), (3, "hello", "c"), (3, "hello", "c"), (None, "é" * 300, "d"), (5, "long text " * 2000, "e")]
    df = spark.createDataFrame(texts, "doc_id long, text string, media string").repartition(2)
    stored = media.stored(df)
    got = media.described(stored).collect()
    for r in got:
        p = media.payload((r.row.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((r.row.text or "").encode()), len(p), hashlib.sha256(p).hexdigest())
    assert len({(r.media_sha256, r.feature) for r in got if r.row.doc_id == 3}) == 1
    assert len({r.media_sha256 for r in got if r.row.doc_id in (1, 2)}) == 1
    blocks = media.pcm(stored.where("row.doc_id = 5")).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == samples(media.payload(b"long text " * 2000)).astype("<i1").tobytes()
    assert media.described(media.stored(df.where("false"))).count() == 0
