"""Tokens against the library, files against what was put into them."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from facetline.llm import tokenfile
from facetline.llm.tokens import END, WordTokens, default_model, stored

TEXTS = [None, "", " ", "it's <|endoftext|> don't <|startoftext|>x", "É éa क़क़ İstanbul ΑΣ, ǅ", "a b　c\x85d\x1cE f1g22 @#$ '' 's", "하 ᄒ ᅡ", "Word, WORD. word!! c%%% %%%c ...", "x" * 3000, "the the the\nThe\tTHE"]


def test_words_give_the_librarys_tokens():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(default_model()), WordTokens(default_model())
    starts, ids = own.encode(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert ids[starts[i] : starts[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def file_of(docs, width=2):
    out = io.BytesIO()
    writer = tokenfile.Writer(out, width)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids))
    writer.close()
    return out.getvalue()


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_file_reads_single_documents_and_finds_damage():
    rng = np.random.default_rng(0)
    docs = [(k if k != 2 else None, rng.integers(0, 49408, n)) for k, n in enumerate((1, 5, 40_000, 3, 70_000))]
    raw = file_of(docs)
    file = Counted(raw)
    reader = tokenfile.Reader(file, len(raw))
    assert reader.doc_ids == [0, 1, None, 3, 4]
    table = file.read_bytes
    assert (reader.document(3) == docs[3][1]).all() and file.read_bytes - table < 100
    assert all((a == b[1]).all() for a, b in zip(reader.documents(chunk=1000), docs, strict=True))
    assert [x.tolist() for x in tokenfile.wanted(reader, [1, 9])[1]] == [docs[1][1].tolist()]
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)
    assert plain == b"".join(d.astype("<u2").tobytes() for _, d in docs)
    bad = bytearray(raw)
    bad[30] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokenfile.Reader(io.BytesIO(bytes(bad)), len(bad)).documents())
    assert len(tokenfile.Reader(io.BytesIO(file_of([])), len(file_of([])))) == 0


def test_stored_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_model())
    rows = [(int(10 * k), t, "c") for k, t in enumerate(TEXTS)] + [(20, " ", "d"), (None, "last", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in stored(df, default_model()).collect()), key=lambda r: r[1])
    at, ids_of = 0, {(-1 if i is None else i, t): library.encode(t or "", add_special_tokens=False).ids + [END] for i, t, _ in rows}
    assert [r[0] for r in got] == sorted(-1 if r[0] is None else r[0] for r in rows)
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
        assert any(n == len(v) and crc == zlib.crc32(np.array(v, "<u4").tobytes()) for (i, _), v in ids_of.items() if i == doc_id)
    assert stored(df.where("false"), default_model()).count() == 0
