"""SentencePiece encoding and decoding with N-best segmentation.

A text is normalised as the model does (a space first, spaces as U+2581) and read as a lattice of the model's pieces;
the score of a segmentation is the sum of its pieces' log probabilities, and a character without a piece is one unknown
piece, written as its bytes. Forward Viterbi scores are then the exact heuristic of a backward A* search, which gives
segmentations in order of score. A unigram model has log probabilities; a BPE model has ranks only, and its pieces get
the probabilities that Zipf's and Mandelbrot's law gives to ranks.

No piece crosses certain pairs of characters (a letter and the space after it, for one), so the lattice falls apart
there: the distinct parts of a run of texts are searched at once, position by position of all parts, and texts are put
together from them. A part's loss from its best to its second-best segmentation comes from forward and backward scores;
only the parts with the least losses can change among a text's N best, and only those are searched by A*; the N best of
a text are the best combinations of theirs.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import packed, table

SPACE = "▁"
#: stands for a U+2581 of the text itself, which is written as bytes; no valid text has a lone surrogate
OWN_SPACE = "\ud800"
UNKNOWN_PENALTY = 10.0
#: of Zipf's and Mandelbrot's law: a piece of rank r (from 0) has a probability in proportion to 1 / (r + OFFSET)
OFFSET = 100.0
#: scores are whole multiples of 1 / GRAIN, so that sums are exact whatever their order
GRAIN = 1 << 20
MARKS = ".,;:!?|%&$*#\"')(-"
LINES = re.compile("(\n)")
NO_LOSS = float("inf")
#: parts that are searched at once
TOGETHER = 4_096
Edge = tuple[int, int, int, float]  # start, end, piece id (below 0: minus the code point of an unknown character), score
Choice = tuple[float, tuple[tuple[int, int, list[int]], ...]]  # score; (from, to, ids) in place of the best one's ids


def changed(ids: np.ndarray, changes: tuple[tuple[int, int, list[int]], ...]) -> np.ndarray:
    """The ids of a segmentation, from those of the best and what is changed."""
    out, at = [], 0
    for a, b, own in changes:
        out += [ids[at:a], np.array(own, ids.dtype)]
        at = b
    return np.concatenate([*out, ids[at:]])


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


def is_bpe(raw: bytes) -> bool:
    """Does the model's trainer specification (field 2) say type 2?"""
    return any(number == 2 and dict(_fields(value)).get(3) == 2 for number, value in _fields(raw))


class Pieces:
    """The vocabulary of a model, with the pairs of characters that some piece has side by side."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, tuple[int, float]] = {}  # piece: id, score
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pairs: set[str] = set()
        self.raw: list[bytes] = []
        with open(path, "rb") as file:
            ranked = is_bpe(file.read())
        words = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = -np.log(np.arange(len(words)) + OFFSET) - np.log((1 / (np.arange(len(words)) + OFFSET)).sum()) if ranked else np.array([model.get_score(i) for i in words])
        score_of = dict(zip(words, (np.round(scores * GRAIN) / GRAIN).tolist(), strict=True))
        least = min(score_of.values(), default=0.0)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if i not in score_of:
                self.raw.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"")
                continue
            self.raw.append(piece.replace(SPACE, " ").encode())
            self.known[piece] = (i, score_of[i])
            self.pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
        self.longest = max(map(len, self.known), default=0)
        self.unknown = least - UNKNOWN_PENALTY
        self.lengths = np.array([len(x) for x in self.raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(self.raw), np.uint8)
        self.lines = not any("\n" in x for x in self.pairs)
        self.spaces = not any(x[0] != SPACE and x[1] == SPACE for x in self.pairs)
        self._tables()

    def _tables(self) -> None:
        """The pieces as a trie in arrays: children of the root by character, all others in a sorted list of (node,
        character)."""
        prefixes = sorted({p[:k] for p in self.known for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        characters = {c: k for k, c in enumerate(sorted({p[-1] for p in prefixes}))}
        self.code = np.full(0x110000, len(characters), np.int32)
        for c, k in characters.items():
            self.code[ord(c)] = k
        self.base = len(characters) + 1
        self.first = np.full(self.base, -1, np.int64)
        number = {p: k for k, p in enumerate(prefixes)}
        inner = [p for p in prefixes if len(p) > 1]
        for p in prefixes[: len(prefixes) - len(inner)]:
            self.first[characters[p]] = number[p]
        keys = np.array([number[p[:-1]] * self.base + characters[p[-1]] for p in inner], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([number[p] for p in inner], np.int64)[order]
        entries = [self.known.get(p, (-1, 0.0)) for p in prefixes]
        self.entry, self.entry_score = np.array([i for i, _ in entries], np.int64), np.array([score for _, score in entries])

    # -- lattice of one string ----------------------------------------------------------------------------------------

    def lattice(self, s: str) -> tuple[list[Edge], list[float], list[int]]:
        """Edges by start; the best score up to each position, and the edge by which it is reached."""
        n = len(s)
        edges: list[Edge] = []
        best, back = [-NO_LOSS] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            score = best[i]
            if s[i] not in self.known:
                if score + self.unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = score + self.unknown, len(edges)
                edges.append((i, i + 1, -ord(s[i]), self.unknown))
            for j in range(i + 1, min(n, i + self.longest) + 1):
                entry = self.known.get(s[i:j])
                if entry is not None:
                    piece, w = entry
                    if score + w > best[j]:
                        best[j], back[j] = score + w, len(edges)
                    edges.append((i, j, piece, w))
        return edges, best, back

    def nbest(self, s: str, n: int) -> Iterator[tuple[float, list[int]]]:
        """Up to ``n`` segmentations (score, piece ids) from the best down."""
        edges, best, _ = self.lattice(s)
        into: list[list[Edge]] = [[] for _ in best]
        for edge in edges:
            into[edge[1]].append(edge)
        agenda: list = [(-best[-1], 0, len(s), 0.0, None)]
        pushed = 0
        while agenda and n > 0:
            _, _, at, done, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path:
                    i, path = path
                    ids.append(i)
                yield done, self.expand(ids)
                n -= 1
                continue
            for i, _, piece, w in into[at]:
                pushed -= 1  # of equal ones the last is gone on with, so that ties don't all grow at once
                heapq.heappush(agenda, (-(done + w + best[i]), pushed, i, done + w, (piece, path)))

    def expand(self, ids: list[int]) -> list[int]:
        if min(ids, default=0) >= 0:
            return ids
        out = []
        for i in ids:
            if i >= 0:
                out.append(i)
            else:
                c = chr(-i)
                out += [self.byte[b] for b in (SPACE if c == OWN_SPACE else c).encode()]
        return out

    def cut(self, s: str) -> list[str]:
        """Parts of a unit that no piece crosses: lines, and marks at the end."""
        if s[-1].isalpha():
            cuts = [s]
        else:
            k = len(s.rstrip(MARKS))
            cuts = [s] if not 0 < k < len(s) or s[k - 1 : k + 1] in self.pairs else [s[:k], s[k:]]
        if self.lines and "\n" in s:
            cuts = [x for c in cuts for x in LINES.split(c) if x]
        return cuts

    # -- lattices of many strings ---------------------------------------------------------------------------------------

    def _edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, piece, score) of all edges; ``ends`` is the end of each position's part."""
        codes = self.code[points]
        at, node = np.arange(len(points)), self.first[codes]
        lone = np.flatnonzero((node < 0) | (self.entry[np.maximum(node, 0)] < 0))
        out = [(lone, np.ones(len(lone), np.int64), -points[lone].astype(np.int64), np.full(len(lone), self.unknown))]
        length = 1
        at, node = at[node >= 0], node[node >= 0]
        while len(at):
            hit = self.entry[node] >= 0
            out.append((at[hit], np.full(int(hit.sum()), length, np.int64), self.entry[node[hit]], self.entry_score[node[hit]]))
            on = at + length < ends[at]
            at, node = at[on], node[on]
            key = node * self.base + codes[at + length]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            at, node, length = at[on], self.to[k[on]], length + 1
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def search(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ids, scores, losses): the best segmentation of each part, and its lead over the second best. Of equal
        scores the one whose last piece is longest, and so on down."""
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        stops = np.cumsum(lengths)
        begins = stops - lengths
        owner = np.repeat(np.arange(len(parts)), lengths)
        start, size, piece, score = self._edges(points, stops[owner])
        part = owner[start]
        offset = start - begins[part]
        order = np.lexsort((start, offset))
        start, size, piece, score, part, offset = (x[order] for x in (start, size, piece, score, part, offset))
        source = start + part  # each part has a place more than characters
        target = source + size
        turns = np.searchsorted(offset, np.arange(int(lengths.max(initial=0)) + 1))
        best, back = np.full(len(points) + len(parts), -NO_LOSS), np.full(len(points) + len(parts), -1, np.int64)
        first, last = begins + np.arange(len(parts)), stops + np.arange(len(parts))
        best[first] = 0.0
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            through = best[source[a:b]] + score[a:b]
            better = np.flatnonzero(through > best[target[a:b]])
            best[target[a:b][better]] = through[better]
            back[target[a:b][better]] = a + better
        chosen, at = np.zeros(len(start), bool), last
        while len(at):
            edge = back[at]
            edge = edge[edge >= 0]
            chosen[edge] = True
            at = source[edge]
        onward = np.full(len(best), -NO_LOSS)
        onward[last] = 0.0
        rest = np.empty(len(start))
        for a, b in zip(turns[-2::-1].tolist(), turns[:0:-1].tolist(), strict=True):
            if a == b:
                continue
            rest[a:b] = score[a:b] + onward[target[a:b]]
            heads = np.flatnonzero(np.diff(source[a:b], prepend=-1))
            onward[source[a:b][heads]] = np.maximum.reduceat(rest[a:b], heads)
        second = np.full(len(parts), -NO_LOSS)
        other = np.flatnonzero(~chosen)
        np.maximum.at(second, part[other], best[source[other]] + rest[other])
        kept = np.flatnonzero(chosen)
        kept = kept[np.argsort(start[kept], kind="stable")]
        ids, many = piece[kept], np.ones(len(kept), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            spelt = {c: self.expand([c]) for c in np.unique(ids[unknown]).tolist()}
            many[unknown] = [len(spelt[c]) for c in ids[unknown].tolist()]
            whole = np.repeat(ids, many)
            at = np.cumsum(many) - many
            for k in unknown.tolist():
                whole[at[k] : at[k] + many[k]] = spelt[int(ids[k])]
            ids = whole
        counts = np.bincount(part[kept], many, len(parts)).astype(np.int64)
        return np.concatenate([[0], np.cumsum(counts)]), ids, best[last], best[last] - second

    # -- texts --------------------------------------------------------------------------------------------------------

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(starts, codes, units): every text as units that no piece crosses: a run of spaces and what follows it, or the
        whole text if a piece goes from a character on to a space."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.spaces:
            whole = [SPACE + t.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if t else "" for t in texts.to_pylist()]
            number = {u: k for k, u in enumerate(dict.fromkeys(u for u in whole if u))}
            return np.concatenate([[0], np.cumsum([u != "" for u in whole])]).astype(np.int64), np.array([number[u] for u in whole if u], np.int64), list(number)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        codes, words = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()
        offsets = offsets - offsets[0]
        empty = np.array([w == "" for w in words] or [False])[codes]
        units = [SPACE + w.replace(SPACE, OWN_SPACE) for w in words]
        if not empty.any():
            return offsets, codes, units
        number, out, starts = {u: k for k, u in enumerate(units)}, [], [0]
        for i, bare in enumerate(kit.sum_by(offsets, empty).tolist()):
            own = codes[offsets[i] : offsets[i + 1]]
            if bare:
                gap, own_units, empty_text = "", [], len(own) == 1
                for c in own.tolist():
                    gap += SPACE
                    if words[c]:
                        own_units.append(gap[1:] + units[c])
                        gap = ""
                if gap and not empty_text:
                    own_units.append(gap)
                own = np.array([number.setdefault(u, len(number)) for u in own_units], np.int64)
            out.append(own)
            starts.append(starts[-1] + len(own))
        return np.array(starts), np.concatenate(out), list(number)

    def encode(self, texts: pa.Array, n: int = 1) -> tuple[np.ndarray, np.ndarray, list[list[Choice]]]:
        """(starts, ids, choices): ids of the best segmentation of each text, and its ``n`` best as what they change."""
        starts, codes, units = self.units(texts)
        used, codes_used = np.unique(codes, return_inverse=True)
        number: dict[str, int] = {}
        cuts = [[number.setdefault(c, len(number)) for c in self.cut(units[k])] for k in used.tolist()]
        if not cuts:
            return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), [[(0.0, ())] for _ in range(len(texts))]
        parts_of = list(number)
        found = [self.search(parts_of[k : k + TOGETHER]) for k in range(0, len(parts_of), TOGETHER)]
        pool, scores, losses = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f[0]) for f in found]))])
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((c for cut in cuts for c in cut), np.int64, int(counts.sum()))
        heads = np.cumsum(counts) - counts
        unit_loss = np.minimum.reduceat(losses[flat], heads)
        parts = flat[kit.ragged_take(heads[codes_used], counts[codes_used])]
        lengths = np.diff(at)[parts]
        ids = pool[kit.ragged_take(at[:-1][parts], lengths)]
        of_units = np.concatenate([[0], np.cumsum(counts[codes_used])])  # where units begin among parts
        of_parts = np.concatenate([[0], np.cumsum(lengths)])  # where parts begin among ids
        places = of_parts[of_units]
        totals = np.concatenate([[0.0], np.cumsum(scores[parts])])[of_units[starts]]
        known: dict[int, list[tuple[float, list[int]]]] = {}

        def others(unit: int) -> list[tuple[float, list[int]]]:
            """(loss, ids) of the unit's segmentations behind the best."""
            code = int(codes_used[unit])
            if code not in known:
                own = ids[places[unit] : places[unit + 1]].tolist()
                ways = list(self.nbest(units[used[code]], n))
                known[code] = [(ways[0][0] - score, way) for score, way in ways if way != own][: n - 1]
            return known[code]

        ranked = []
        for i in range(len(texts)):
            choices: list[Choice] = [(0.0, ())]
            if n > 1 and starts[i] < starts[i + 1]:
                own = unit_loss[codes_used[starts[i] : starts[i + 1]]]
                near = np.sort(np.argpartition(own, n - 2)[: n - 1]) if len(own) >= n else np.arange(len(own))
                for k in near[own[near] < NO_LOSS].tolist():
                    unit = int(starts[i]) + k
                    place = (int(places[unit] - places[starts[i]]), int(places[unit + 1] - places[starts[i]]))
                    more = [(x + loss, (*changes, (*place, way))) for x, changes in choices for loss, way in others(unit)]
                    choices = sorted(choices + more, key=lambda c: c[0])[:n]
            best = float(totals[i + 1] - totals[i])
            ranked.append([(best - x, changes) for x, changes in choices])
        return places[starts], ids, ranked

    def decode(self, starts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for, without the space that normalising puts first."""
        lengths = self.lengths[ids]
        raw = self.pool[kit.ragged_take(self.starts[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[starts]
        return [raw[a + 1 : b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encode(path: str, n: int, with_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in kit.unpacked(batches):
            for part in kit.slices(batch, limit=1 << 19):
                texts = part.column("text")
                starts, ids, ranked = model.encode(texts, n)
                ids = ids.astype("<u4")
                back = model.decode(starts, ids)
                whole, crcs, ways, sizes, scores = [], [], [], [], []
                for k, text in enumerate(texts.to_pylist()):
                    own = ids[starts[k] : starts[k + 1]]
                    same = all(b"".join(model.raw[x] for x in way) == b"".join(model.raw[x] for x in own[a:b].tolist()) for _, changes in ranked[k] for a, b, way in changes)
                    whole.append(same and back[k] == (text or "").encode())
                    for rank, (score, changes) in enumerate(ranked[k]):
                        way = changed(own, changes) if changes else own
                        scores.append(score)
                        sizes.append(len(way))
                        crcs.append(zlib.crc32(way.tobytes()))
                        ways.append(way if rank < with_ids else way[:0])
                parts = [pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    parts.append(pa.ListArray.from_arrays(_offsets([len(x) for x in ways]), pa.array(np.concatenate(ways).view(np.int32) if ways else np.empty(0, np.int32))))
                heads = _offsets([len(x) for x in ranked])
                found = pa.ListArray.from_arrays(heads, pa.StructArray.from_arrays(parts, ["score", "n_tokens", "ids_crc32", "ids"][: len(parts)]))
                best = pa.array(crcs, pa.int64()).take(heads[:-1])
                columns = [part.column("row"), pa.array(np.diff(starts)), best, found, pa.array([zlib.crc32(x) for x in back], pa.int64()), pa.array(whole)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_tokens", "ids_crc32", "segmentations", "decoded_crc32", "round_trip"])

    return run


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(documents: DataFrame, path: str, n: int = 3, with_ids: int = 0) -> DataFrame:
    """row (a struct of all columns), n_tokens and ids_crc32 (of the ids of the best segmentation as little-endian unsigned
    32-bit integers), segmentations (score, n_tokens and ids_crc32 of the ``n`` best of the whole text, best first, and the
    ids of the first ``with_ids`` of them; fewer if there are no more), decoded_crc32 and round_trip (the decoded bytes of all of them are the
    text's) of every row of ``documents``.

    Null and empty texts have no tokens and one segmentation of score 0. Equal texts have equal results; an empty table
    gives no rows. ``path`` names the model's file on the executors."""
    rows, kind = packed(documents)
    ids = ",ids:array<int>" if with_ids else ""
    return rows.mapInArrow(kit.tidied(_encode(path, n, with_ids)), f"row {kind}, n_tokens long, ids_crc32 long, segmentations array<struct<score:double,n_tokens:bigint,ids_crc32:bigint{ids}>>, decoded_crc32 long, round_trip boolean")


def op8_sentencepiece_nbest(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encoded(documents, default_model())
    parts = (F.col(f"segmentations.{c}").alias(f"nbest_{c}") for c in ("score", "n_tokens", "ids_crc32"))
    return out.select("row.doc_id", "n_tokens", "ids_crc32", *parts, "decoded_crc32", "round_trip")
