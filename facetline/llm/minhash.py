"""Near-duplicate groups by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes). 128 minima of it give 32 band keys of four
   minima each, and their low four bits, packed into longs.
2. Texts with equal sets are one node, so exact copies never meet as pairs.
3. Each band bucket links its members to one hub, chosen by hash and thus another one in each band. Pairs whose
   collision-corrected estimate from the packed bits lies far below the threshold go; the others are confirmed on the
   full sets, and confirmed links are contracted into components.
4. What is left are bucket members of different components. Small buckets are joined with themselves; large ones are cut
   into blocks, each pair of blocks is one group, and within it all pairs are compared on packed bits of 1,024 minima.
   Members of a bucket's largest component have blocks of their own, which never meet each other. First the best pair of
   every two components is confirmed and contracted, then every pair that is left and not ruled out. Nothing is capped.

A node is a set of shingles with a number of its own; doc_ids, which rows with other texts may share, come back at the end.

The smaller of two probabilities of losing a link decides how far below the threshold an estimate must lie: 4.5 standard
deviations. A pair at exactly 0.75 shares no band with probability (1 - 0.75**4)**32, about 5e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as kit
from .components import connected
from .shared import Scratch

LANES = 0x1111111111111111  # the lowest bit of each 4-bit lane


@dataclass(frozen=True)
class Params:
    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    fine: int = 1024
    sigmas: float = 4.5
    block: int = 512
    #: buckets of up to so many members are joined with themselves on the short packed bits; larger ones go block by block
    small: int = 64
    #: ids of candidate documents are broadcast up to this number (8 bytes each); beyond it, they are joined by shuffle
    broadcast_ids: int = 1_000_000
    seed: int = 20240229

    def least_match(self, minima: int) -> float:
        """Share of equal lanes under which a pair is ruled out."""
        j = self.percent / 100
        lanes = 1 / 16 + 15 / 16 * j  # two unequal minima share their low four bits once in 16
        return lanes - self.sigmas * math.sqrt(lanes * (1 - lanes) / minima)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, hashes): the sorted distinct shingles of text i are hashes[cuts[i]:cuts[i+1]]."""
    words = kit.words_of(texts, lower=True)
    hashes = kit.hashes_of(words.vocab)[words.codes]
    windows = kit.window_hashes(hashes, width)
    counts, starts = words.counts, words.starts
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts):
        at = starts[i]
        if n >= width:
            one = np.sort(windows[at : at + n - width + 1])
            one = one[np.concatenate([[True], one[1:] != one[:-1]])]
        elif n:
            one = kit.mix64(kit.window_hashes(hashes[at : at + n], int(n)) + np.uint64(n))
        else:
            continue
        out.append(one)
        sizes[i] = len(one)
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(out) if out else np.empty(0, np.uint64)


def minima(cuts: np.ndarray, hashes: np.ndarray, count: int, seed: int) -> np.ndarray:
    """(texts, count) least values of each non-empty set under ``count`` hash functions."""
    rng = np.random.default_rng(seed)
    left, right = rng.integers(0, 1 << 32, (2, count), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    high, low = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)
    out = np.empty((count, len(cuts) - 1), np.uint32)
    value, other = np.empty_like(high), np.empty_like(high)
    for k in range(count):
        np.multiply(high, left[k], out=value)
        np.multiply(low, right[k], out=other)
        value += other
        out[k] = np.minimum.reduceat(value, cuts[:-1])
    return np.ascontiguousarray(out.T)


def packed(least: np.ndarray) -> np.ndarray:
    """Low four bits of each mixed minimum, 16 to a long."""
    bits = least * np.uint32(0x2C1B3C6D)
    bits = ((bits ^ (bits >> np.uint32(15))) & np.uint32(15)).astype(np.uint64)
    bits = bits.reshape(len(least), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=2)


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(least), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(least), band + 1, np.uint64)
        for k in range(rows):
            key = kit.mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, band * rows + k])
        keys[:, band] = key
    return keys


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)))


def _digests(cuts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two longs; 0 of an empty one."""
    live = np.flatnonzero(np.diff(cuts))
    out = np.zeros((2, len(cuts) - 1), np.uint64)
    for k in (1, 2):
        if len(live):
            out[k - 1, live] = np.add.reduceat(kit.mix64(hashes + np.uint64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)), cuts[live])
    return out[0], out[1]


def _sign(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slices(batch, limit=1 << 20):
                cuts, hashes = shingle_sets(part.column("text"), p.width)
                sizes = np.diff(cuts)
                live = np.flatnonzero(sizes)
                first, second = _digests(cuts, hashes)
                keys = bits = np.empty(0, np.uint64)
                if len(live):
                    least = minima(np.append(cuts[live], cuts[-1]), hashes, p.bands * p.rows, p.seed)
                    keys, bits = band_keys(least, p.bands, p.rows), packed(least)
                full = (sizes > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(sizes), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), _lists(keys, full * p.bands), _lists(bits, full * (p.bands * p.rows // 16))],
                    ["doc_id", "mark", "n_shingles", "digest_a", "digest_b", "keys", "bits"],
                )

    return run


def _sets(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kit.slices(batch, limit=1 << 20):
                cuts, hashes = shingle_sets(part.column("text"), p.width)
                yield pa.RecordBatch.from_arrays([part.column("node"), _lists(hashes, np.diff(cuts))], ["node", "shingles"])

    return run


def _fine(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                lists = part.column(1)
                cuts = lists.offsets.to_numpy().astype(np.int64)
                hashes = lists.values.to_numpy()[cuts[0] : cuts[-1]].view(np.uint64)
                bits = packed(minima(cuts - cuts[0], hashes, p.fine, p.seed + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(bits, np.full(len(part), bits.shape[1]))], ["node", "fine"])

    return run


PAIRS = ["a", "b", "low", "high", "match"]


def _pairs(p: Params, best_only: bool):
    """Pairs of one pair of blocks: other components, similar enough sizes, not ruled out, in no earlier large bucket."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bucket, i, j = key
        rows = rows.sort_values("node", kind="stable")
        left, right = rows[rows["block"] == i], rows[rows["block"] == j]
        nodes, labels, sizes = right["node"].to_numpy(), right["label"].to_numpy(), right["size"].to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in PAIRS})
        bits, own = (np.stack(side["bits"].to_numpy()).view(np.uint64) for side in (right, left))
        keys = np.stack(right["keys"].to_numpy())
        lanes = 16 * bits.shape[1]
        least, found = p.least_match(lanes), []
        for at, (node, label, size, own_keys) in enumerate(zip(left["node"], left["label"], left["size"], left["keys"], strict=True)):
            near = (labels != label) & (100 * np.minimum(sizes, size) >= p.percent * np.maximum(sizes, size))
            if i == j:
                near &= nodes > node
            near = np.flatnonzero(near)
            if not len(near):
                continue
            x = bits[near] ^ own[at]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            equal = 1 - np.bitwise_count(x & np.uint64(LANES)).sum(axis=1) / lanes
            near, equal = near[equal >= least], equal[equal >= least]
            if len(near):
                shared = keys[near] == own_keys
                first = own_keys[shared.argmax(axis=1)] == bucket
                found += [(node, nodes[k], min(label, labels[k]), max(label, labels[k]), e) for k, e in zip(near[first], equal[first], strict=True)]
        out = pd.DataFrame(found, columns=PAIRS)
        return out.sort_values(["match", "a", "b"], ascending=[False, True, True]).drop_duplicates(["low", "high"]) if best_only else out

    return run


def _small_pairs(mixed: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """As ``_pairs``, of buckets of at most ``small`` members: at most half as many pairs for each row."""
    rows = mixed.where(F.col("members") <= p.small).join(nodes, "node")
    a, b = (rows.select("bucket", F.col("node").alias(x), F.col("label").alias(f"{x}_label"), F.col("n_shingles").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    near = a.join(b, "bucket").where(F.expr("a < b AND a_label <> b_label") & _sizes_fit(p, "a_size", "b_size")).withColumn("match", _estimate(p))
    near = near.where(F.col("match") >= p.least_match(p.bands * p.rows))
    return near.select("a", "b", F.least("a_label", "b_label").alias("low"), F.greatest("a_label", "b_label").alias("high"), "match")


def _estimate(p: Params) -> Column:
    """Share of equal lanes of a_bits and b_bits."""

    def lanes(x: Column, y: Column) -> Column:
        x = x.bitwiseXOR(y)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(LANES)))

    unequal = F.aggregate(F.zip_with("a_bits", "b_bits", lanes), F.lit(0), lambda s, x: s + x)
    return 1 - unequal / F.lit(float(p.bands * p.rows))


def _sizes_fit(p: Params, a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= p.percent * F.greatest(a, b)


def _confirm(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    common, total = F.size(F.array_intersect("a_set", "b_set")).cast("long"), F.size("a_set") + F.size("b_set")
    return pairs.join(a, "a").join(b, "b").where(100 * common >= p.percent * (total - common)).select("a", "b").distinct()


def _blocks(large: DataFrame, p: Params) -> DataFrame:
    """Rows of large buckets with block (from 0, the blocks of the bucket's largest component first) and other, once
    for each block that a row's block is compared with."""
    blocks = {c: F.ceil(F.col(c) / p.block).cast("int") for c in ("most", "others")}
    rows = large.withColumn("others", F.col("members") - F.col("most"))
    spread = F.xxhash64("node")
    own = F.when(F.col("label") == F.col("main"), F.pmod(spread, blocks["most"])).otherwise(blocks["most"] + F.pmod(spread, blocks["others"])).cast("int")
    first = F.when(F.col("label") == F.col("main"), blocks["most"]).otherwise(F.lit(0))
    return rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(first, blocks["most"] + blocks["others"] - 1)))


def grouped(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each row of ``documents`` (columns doc_id and text; others are ignored): doc_id, mark (a hash of the
    text), n_shingles, component_id, kept, and first: has the row the doc_id and the text that stand for its component?

    Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows with a null
    doc_id are linked with nothing, are kept and have a null component_id. Repeated rows have equal results; rows that
    share a doc_id but not a text are grouped each by its own text. An empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    text = F.col("text").cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), marked(text).alias("mark"))
    signs = scratch.put(texts.mapInArrow(kit.tidied(_sign(p)), "doc_id long, mark long, n_shingles long, digest_a long, digest_b long, keys array<long>, bits array<long>"), "signs")

    same = ["n_shingles", "digest_a", "digest_b"]
    full = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = full.groupBy(same).agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    # numbers are given once, when the table is written
    nodes = scratch.put(nodes.select(F.monotonically_increasing_id().alias("node"), *same, "least.doc_id", "least.mark", "keys", "bits"), "nodes")

    buckets = nodes.select("node", F.explode("keys").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node"))["node"].alias("hub")).where("members > 1")
    live = scratch.put(buckets.join(hubs, "bucket"), "live")
    bound = live.count()  # of narrow tables to come

    alone = nodes.select("node", "doc_id", "mark")
    ids = scratch.put(alone.join(live.select("node").distinct(), "node", "left_semi"), "ids", bound)
    wanted = ids.count()
    chosen = texts.join(F.broadcast(ids) if wanted <= p.broadcast_ids else ids, ["doc_id", "mark"]).select("node", "text")
    sets = scratch.put(chosen.mapInArrow(kit.tidied(_sets(p)), "node long, shingles array<long>").where(F.size("shingles") > 0), "sets")
    if sets.count() > wanted:  # repeated rows; one set of each is enough
        sets = scratch.put(sets.dropDuplicates(["node"]), "sets-once")

    sides = [nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits")) for x in "ab"]
    stars = live.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stars.join(sides[0], "a").join(sides[1], "b").where(_sizes_fit(p, "a_size", "b_size") & (_estimate(p) >= p.least_match(p.bands * p.rows))).select("a", "b")
    links = scratch.put(_confirm(stars, sets, p), "links-0")
    labels = connected(links, scratch, "labels-0", bound)

    for step, best_only in ((1, True), (2, False)):
        tagged = live.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
        parts = tagged.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket")
        mixed = parts.agg(F.sum("n").alias("members"), F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("main")).where("labels > 1")
        mixed = scratch.put(tagged.join(mixed.select("bucket", "members", F.col("main.n").alias("most"), F.col("main.label").alias("main")), "bucket"), f"mixed-{step}", bound)
        if step == 1:  # later buckets are among these
            many = mixed.where(F.col("members") > p.small).select("node").distinct()
            fine = sets.join(many, "node", "left_semi").mapInArrow(_fine(p), "node long, fine array<long>")
            fine = scratch.put(fine.join(nodes.select("node", "n_shingles", "keys"), "node"), "fine")
        rows = _blocks(mixed.where(F.col("members") > p.small).join(fine, "node"), p)  # joined before rows are repeated
        rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", F.col("n_shingles").alias("size"), F.col("fine").alias("bits"), "keys")
        pairs = rows.groupBy("bucket", "i", "j").applyInPandas(_pairs(p, best_only), "a long, b long, low long, high long, match double").union(_small_pairs(mixed, nodes, p))
        if best_only:
            pairs = pairs.groupBy("low", "high").agg(F.max_by(F.struct("a", "b"), F.struct("match", "a", "b")).alias("best")).select("best.a", "best.b")
        pairs = scratch.put(pairs.select("a", "b").distinct(), f"pairs-{step}")
        more = _confirm(pairs, sets, p)
        links = scratch.put(links.union(more), f"links-{step}")
        labels = connected(links, scratch, f"labels-{step}", bound)

    named = nodes.select("node", *same, "doc_id", "mark").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = named.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("least"))
    named = named.join(firsts, "label").select(*same, F.col("least.doc_id").alias("component"), F.col("least.mark").alias("first_mark"))
    named = scratch.put(named, "named", signs.count())
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    found = signs.select("doc_id", "mark", *same).join(named, same, "left")
    found = found.select("doc_id", "mark", "n_shingles", F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("first_mark")).otherwise(F.col("mark")).alias("first_mark"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    found = found.select("doc_id", "mark", "n_shingles", "component_id", kept.alias("kept"), (kept & F.col("first_mark").eqNullSafe(F.col("mark"))).alias("first"))
    done = scratch.put(found, "result", signs.count())
    scratch.drop("signs", "nodes", "live", "ids", "sets", "sets-once", "fine", "mixed-1", "mixed-2", "pairs-1", "pairs-2", "links-0", "links-1", "links-2", "labels-0", "labels-1", "labels-2", "named")
    return done


def marked(text: Column) -> Column:
    """A hash of a text (null: 42, its seed)."""
    return F.xxhash64(text)


def near_duplicates(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (doc_id = component_id) of each row
    of ``documents``, as ``grouped`` finds them."""
    return grouped(documents, p).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """One row of each group of near-duplicates, all columns kept: of the least doc_id, of rows that share it one text, of
    rows with that text one. Rows without a doc_id, or without words, belong to no group and stay."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "one-of-each")
    rows = grouped(documents, p)
    counts = rows.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id", "mark").agg(F.first("first").alias("first"), F.count("*").alias("many")).where("NOT first OR many > 1")
    counts = scratch.put(counts, "counts")
    lost, many = counts.where("NOT first").select("doc_id", "mark"), counts.where("first").select("doc_id", "mark")
    few = counts.count() <= p.broadcast_ids
    mark = marked(F.col("text").cast("string"))

    def without(out: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
        gone = F.broadcast(gone) if few else gone
        return out.join(gone, (out["_row.doc_id"].cast("long") == gone["doc_id"]) & (out["_mark"] == gone["mark"]), how)

    out = documents.select(F.struct("*").alias("_row"), mark.alias("_mark"))
    stay = without(out, lost)
    if many.isEmpty():
        return stay.select("_row.*")
    turn = F.row_number().over(Window.partitionBy("_row.doc_id", "_mark").orderBy("_mark"))
    return without(stay, many).select("_row.*").unionByName(without(stay, many, "left_semi").withColumn("_turn", turn).where("_turn = 1").select("_row.*"))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT node, y FROM reached JOIN ways ON x = reach
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach) AS component_id, d.doc_id = min(reach) AS kept
FROM documents d JOIN reached ON node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
