"""Token ids of documents in seekable zstandard files, written in ascending order of doc_id and read back.

The tokenizer splits at white space before anything else, so distinct words are encoded once for each run of text and
texts are put together from them. Words of letters only are encoded many at a time: each is one
pre-token and thus ends where a token ends with the end-of-word mark; runs where the numbers differ go word by word.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import Scratch, place, table
from .tokenfile import Reader, Writer

END = 1
#: distinct words that are encoded at once
TOGETHER = 1024


class WordTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has)."""
        found = [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())), lengths

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a-z only: nothing is normalised or split, so the model itself is asked."""
        tokenize = self.library.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())), lengths

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or (len(ids) and cuts[-1] != len(ids)):
            return self._each(words)
        return ids, np.diff(cuts, prepend=0)

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of distinct words: those of letters only many at a time, the others one by one."""
        plain, letters = (pc.match_substring_regex(words, x).to_numpy(zero_copy_only=False) for x in (r"^[a-z]+$", r"^\p{L}+$"))
        found, lengths = [], np.zeros(len(words), np.int64)
        kinds = ((plain, self._plain), (letters & ~plain, self._together), (~letters, self._each))
        order = np.concatenate([np.flatnonzero(mask) for mask, _ in kinds])
        for mask, encode in kinds:
            at, some = np.flatnonzero(mask), words.filter(pa.array(mask)).to_pylist()
            for k in range(0, len(some), TOGETHER):
                ids, lengths[at[k : k + TOGETHER]] = encode(some[k : k + TOGETHER])
                found.append(ids)
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(found) if found else np.empty(0, np.int64), starts, lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids) of whole texts; null texts have none."""
        words = kit.words_of(texts, lower=True)  # of A-Z, as the tokenizer does
        if not len(words.vocab):
            return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64)
        # letters, then ASCII marks: two pre-tokens that don't touch each other
        parted = pc.match_substring_regex(words.vocab, r"^\p{L}+[!-/:-@\[-`{-~]+$")
        heads = pc.if_else(parted, pc.utf8_rtrim(words.vocab, characters=MARKS), words.vocab).dictionary_encode()
        tails = pc.if_else(parted, pc.replace_substring_regex(words.vocab, r"^\p{L}+", ""), "").dictionary_encode()
        both = pa.concat_arrays([heads.dictionary, tails.dictionary])
        pool, first, lengths = self.distinct(both)
        used = np.stack([heads.indices.to_numpy().astype(np.int64), tails.indices.to_numpy() + np.int64(len(heads.dictionary))], axis=1)[words.codes].reshape(-1)
        counts = lengths[used]
        ids = pool[kit.ragged_take(first[used], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[2 * words.starts]
        return ends, ids


MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokens:
    return WordTokens(path)


def _write(model: str, root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = tokenizer(model), TaskContext.get()
        # a name for each attempt: only files that the manifest lists count
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        writer, total = None, 0
        files, path = place(root)
        for batch in batches:
            for part in kit.slices(batch, limit=8 << 20):
                if writer is None:
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    writer = Writer(out, words.width)
                starts, ids = words.encode(part.column("text"))
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[starts[i] : starts[i + 1]], END)
                    writer.add(doc_id, own)
                    total += len(own)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([total], pa.int64())], ["shard", "name", "ids"])

    return run


def write(documents: DataFrame, model: str, root: str, shards: int) -> DataFrame:
    """Writes (doc_id, text) rows to files under ``root``; one manifest row (shard, name, ids) for each file.

    Rows stand in ascending order of doc_id, null first, then by a hash of the text and the text, over all files."""
    place(root)  # raises here where no task could write
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    placed = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)
    return placed.mapInArrow(_write(model, root), "shard int, name string, ids long")


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = place(root)
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with files.open_input_file(f"{path}/{name}") as file:
                    reader = Reader(file, file.size())
                    counts, crcs = [], []
                    for ids in reader.documents():
                        counts.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    starts = at + np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(manifest: DataFrame, root: str, shards: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files that the manifest lists."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = manifest.withColumn("before", before).repartitionById(shards, F.col("shard"))  # one row for each file
    return each.mapInArrow(_read(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(documents: DataFrame, model: str, shards: int | None = None) -> DataFrame:
    """Writes the tokens of ``documents`` (doc_id, text; other columns are ignored), reads the files back and gives one
    row for each document.

    Null and empty texts have the end id only; rows with a null doc_id come first; repeated rows are written as often as
    they stand there, rows that share a doc_id in order of their texts. An empty table writes no file."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "tokens")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), documents.rdd.getNumPartitions())
    manifest = scratch.put(write(documents, model, scratch.path("files"), shards), "manifest")
    return read(manifest, scratch.path("files"), shards)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"), default_model())
