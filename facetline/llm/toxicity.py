"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, intent); four sequential transducers rewrite
the symbols of a clause, and their composition is one table that reads a clause once:

    negation   an insult or threat within three words after a negation is negated
    reported   an insult or threat after a verb of saying in its clause is reported
    target     an insult within four words of a target is aimed
    threat     intent, then a threat, then a target, each within three words: a menace

What a clause does is the set of its arcs: which symbol was read and what was written for it. Each kind of arc has a
weight, which starts at the grammar's own and moves with the labels; a clause's weight is the sum over its kinds of arcs.
A text is scored by its best clause, and by the sum of the others', in a logistic model that is fitted anew as the weights
tell which clause of a text is its best. By the grammar's own weights, words that nobody is called, that are negated or
reported don't reach the threshold. Beginnings of words join the lexicon where they explain labelled texts that no pattern
matches: surely (next to no clean text has them) or likely.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import labelled, packed, table

#: symbols that the lexicon gives, and those that only transducers write
OTHER, STRONG, WEAK, SURE, LIKELY, THREAT, TARGET, NEGATION, SAYING, INTENT, NEGATED, REPORTED, AIMED, MENACE = SYMBOLS = range(14)
INSULTS = (STRONG, WEAK, SURE, LIKELY)
#: what reading a symbol weighs, whatever is written
GRAVITY = {STRONG: 1.0, WEAK: 0.25, SURE: 1.0, LIKELY: 0.1}
MATCHED = (*INSULTS, AIMED, NEGATED, REPORTED, MENACE)

LEXICON = {
    STRONG: "idiot idiots moron morons scum loser losers imbecile imbeciles cretin scumbag dumbass asshole bastard idiota imbécile crétin dummkopf vollidiot abschaum imbécil cabrón connard salaud arschloch",
    WEAK: "stupid worthless pathetic disgusting trash clown clowns garbage filth filthy vermin ugly dumb erbärmlich widerlich wertlos dégoûtant minable asqueroso patético estúpido inútil",
    THREAT: "kill hurt destroy beat crush stab shoot murder töten umbringen schlagen tuer frapper matar golpear",
    TARGET: "you your yours you're u ya them they him her he she these those du dich dir ihr euch sie tu te toi vous tú ti usted ustedes vosotros",
    NEGATION: "not no never don't doesn't didn't isn't aren't wasn't without nicht kein keine nie pas jamais sans nunca jamás sin",
    SAYING: "said says say told called calls calling wrote writes quoted quote claimed reported sagte sagt nannte schrieb dit appelé écrit dijo dice llamó escribió",
    INTENT: "will gonna going shall i'll we'll werde werden vais allons voy vamos",
}
STRIP = "\"'.,;:!?()[]{}<>*#$%&|-_~`“”„«»…¡¿"
ENDS = r"[.!?;:…]['\"”»)\]]*$"


@dataclass(frozen=True)
class Fst:
    """A sequential transducer: arcs[state][symbol] = (next state, output, weight)."""

    arcs: tuple[dict[int, tuple[int, int, float]], ...]

    def then(self, other: Fst) -> Fst:
        """The composition: what this writes, the other reads."""
        number, arcs, at = {(0, 0): 0}, [], 0
        while at < len(number):
            a, b = list(number)[at]
            row = {}
            for symbol, (to, written, weight) in self.arcs[a].items():
                beyond, out, more = other.arcs[b][written]
                row[symbol] = (number.setdefault((to, beyond), len(number)), out, weight + more)
            arcs.append(row)
            at += 1
        return Fst(tuple(arcs))


def _countdown(opens: int, reach: int, changes: dict[int, tuple[int, float]]) -> Fst:
    """After ``opens``, symbols in ``changes`` are rewritten for ``reach`` words."""
    arcs = []
    for left in range(reach + 1):
        row = {s: (max(0, left - 1), s, 0.0) for s in SYMBOLS}
        if left:
            row |= {s: (left - 1, out, weight) for s, (out, weight) in changes.items()}
        row[opens] = (reach, opens, 0.0)
        arcs.append(row)
    return Fst(tuple(arcs))


def _negation() -> Fst:
    return _countdown(NEGATION, 3, {s: (NEGATED, -2.0) for s in (*INSULTS, THREAT)})


def _reported() -> Fst:
    plain = {s: (0, s, 0.0) for s in SYMBOLS} | {SAYING: (1, SAYING, 0.0)}
    after = {s: (1, s, 0.0) for s in SYMBOLS} | {s: (1, REPORTED, -1.0) for s in (*INSULTS, THREAT)}
    return Fst((plain, after))


def _target(reach: int = 4) -> Fst:
    """States: nothing; 1..reach words left after a target; as many after an insult that had no target yet."""
    arcs = []
    for state in range(2 * reach + 1):
        left = state - 1 if 0 < state <= reach else reach + max(0, state - reach - 1) if state > reach else 0
        left = 0 if left == reach and state > reach else left
        row = {s: (left, s, 0.0) for s in SYMBOLS}
        row[TARGET] = (reach, AIMED, 1.25) if state > reach else (reach, TARGET, 0.0)
        for insult in INSULTS:
            row[insult] = (state, AIMED, 1.25) if 0 < state <= reach else (2 * reach, insult, 0.0)
        arcs.append(row)
    return Fst(tuple(arcs))


def _threat(reach: int = 3) -> Fst:
    arcs = []
    for state in range(2 * reach + 1):  # 1..reach after intent, reach+1..2*reach after a threat that was intended
        left = state - 1 if state and state != reach + 1 else 0
        row = {s: (left, s, 0.0) for s in SYMBOLS}
        row[INTENT] = (reach, INTENT, 0.0)
        row[THREAT] = (2 * reach, OTHER, 0.0) if 0 < state <= reach else (0, OTHER, 0.0)
        if state > reach:
            row[TARGET] = (0, MENACE, 2.0)
        arcs.append(row)
    return Fst(tuple(arcs))


@lru_cache
def grammar() -> Fst:
    return _negation().then(_reported()).then(_target()).then(_threat())


@lru_cache
def identity() -> Fst:
    """Writes what it reads, for comparison."""
    return Fst(({s: (0, s, 0.0) for s in SYMBOLS},))


def read_clause(symbols: list[int], fst: Fst) -> list[int]:
    state, out = 0, []
    for symbol in symbols:
        state, written, _ = fst.arcs[state][symbol]
        out.append(written)
    return out


#: (read, written) of the arcs that match something, and what they weigh by the grammar's own weights
KINDS = {(s, out): GRAVITY.get(s, 0.0) + weight for row in grammar().arcs for s, (_, out, weight) in sorted(row.items()) if s < NEGATED and out in MATCHED}
NUMBER = {kind: 1 << k for k, kind in enumerate(KINDS)}
#: of a weight of 1 in the logistic model
SCALE = 6.0


def arcs_of(symbols: list[int], fst: Fst) -> int:
    """The kinds of arcs on a clause's way, a bit for each."""
    out = 0
    for kind in zip(symbols, read_clause(symbols, fst), strict=True):
        out |= NUMBER.get(kind, 0)
    return out


def _rest(weights: list[float]) -> float:
    """What the clauses behind the best tell."""
    return float(np.log1p(sum(w for w in weights if w > 0)))


@dataclass(frozen=True)
class Model:
    #: of each kind of arc
    arcs: tuple[float, ...] = tuple(SCALE * w for w in KINDS.values())
    #: of log1p of the weights of clauses behind the best, and the constant
    more: float = 0.5
    constant: float = -8.0
    #: beginnings of words that give SURE and LIKELY
    sure: tuple[str, ...] = ()
    likely: tuple[str, ...] = ()

    def weight(self, arcs: int) -> float:
        return sum(w for k, w in enumerate(self.arcs) if arcs >> k & 1)

    def score(self, clauses: list[int]) -> float:
        """Of a text with these clauses."""
        weights = sorted((self.weight(c) for c in clauses), reverse=True)
        x = self.constant + (weights[0] if weights else 0.0) + self.more * _rest(weights[1:])
        return float(1 / (1 + np.exp(-x)))


@dataclass(frozen=True)
class Params:
    #: expected bound on the labelled rows that weights and beginnings of words are learned from
    sample: int = 20_000
    threshold: float = 0.7
    #: a beginning joins the lexicon if so many labelled texts without a match have it, and a share of them is toxic
    support: int = 5
    sure: float = 0.95
    likely: float = 0.4
    #: characters of a beginning
    lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8)


def _bare(vocab: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.utf8_trim(vocab, characters=STRIP))


def _begins(bare: pa.Array, beginnings: tuple[str, ...]) -> np.ndarray:
    if not beginnings:
        return np.zeros(len(bare), bool)
    return pc.match_substring_regex(bare, "^(?:" + "|".join(map(re.escape, beginnings)) + ")").to_numpy(zero_copy_only=False)


def _symbols(vocab: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each word, and whether a clause ends with it."""
    bare = _bare(vocab)
    words = [(w, s) for s, line in LEXICON.items() for w in line.split()]
    found = pc.fill_null(pc.index_in(bare, value_set=pa.array([w for w, _ in words], pa.large_string())), len(words)).to_numpy()
    out = np.array([s for _, s in words] + [OTHER], np.int64)[found]
    for beginnings, symbol in ((model.likely, LIKELY), (model.sure, SURE)):
        out[(found == len(words)) & _begins(bare, beginnings)] = symbol
    return out, pc.match_substring_regex(vocab, ENDS).to_numpy(zero_copy_only=False)


def clauses_of(texts: pa.Array, model: Model = Model(), fst: Fst | None = None) -> list[list[int]]:
    """The kinds of arcs of each clause of each whole text in which anything matches."""
    words, fst = kit.words_of(texts), fst or grammar()
    out: list[list[int]] = [[] for _ in range(len(texts))]
    if not len(words.vocab):
        return out
    symbols, ends = (x[words.codes] for x in _symbols(words.vocab, model))
    hits = np.flatnonzero(np.isin(symbols, (*INSULTS, THREAT)))
    owners = np.searchsorted(words.starts, hits, side="right") - 1
    edges = np.flatnonzero(ends)
    done = -1
    for hit, owner in zip(hits.tolist(), owners.tolist(), strict=True):
        if hit < done:
            continue  # in a clause that is read
        k = np.searchsorted(edges, hit)
        first = max(int(words.starts[owner]), int(edges[k - 1]) + 1 if k else 0)
        done = min(int(words.starts[owner + 1]), int(edges[k]) + 1 if k < len(edges) else len(symbols))
        if arcs := arcs_of(symbols[first:done].tolist(), fst):
            out[owner].append(arcs)
    return out


def _match(model: Model, fst: Fst | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kit.unpacked(batches):
            for part in kit.slices(batch, limit=1 << 20):
                found = clauses_of(part.column("text"), model, fst)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.list_(pa.int64())), pa.array([model.score(x) for x in found], pa.float64())], ["row", "clauses", "score"])

    return run


def scored(documents: DataFrame, model: Model, fst: Fst | None = None) -> DataFrame:
    """row (a struct of all columns), clauses (the kinds of arcs, by KINDS, of each clause in which anything matches) and
    score of every row of ``documents``, by the grammar or another transducer.

    Null and empty texts match nothing and get the score of a text without matches; equal texts have equal scores; an
    empty table gives no rows."""
    rows, kind = packed(documents)
    return rows.mapInArrow(kit.tidied(_match(model, fst)), f"row {kind}, clauses array<long>, score double")


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights at the posterior mode: Newton's method, steps halved until the loss falls, normal prior with a
    deviation of half a SCALE."""
    firm = 4 / SCALE**2
    loss = lambda w: float((np.logaddexp(0, x @ w) - y * (x @ w)).sum() + firm * ((w - prior) ** 2).sum() / 2)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + firm * np.eye(len(w)), x.T @ (p - y) + firm * (w - prior))
        while loss(w - step) > loss(w) and np.abs(step).max() >= 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fitted(model: Model, clauses: list[list[int]], toxic: np.ndarray, rounds: int = 8) -> Model:
    """The model with weights from texts' clauses and labels: the best clauses under the weights so far, and weights from
    those, in turn until they stay."""
    prior = np.array([*model.arcs, model.more, model.constant])
    now, before = prior, None
    for _ in range(rounds):
        x = np.zeros((len(clauses), len(prior)))
        x[:, -1] = 1
        for row, own in enumerate(clauses):
            by_weight = sorted(own, key=lambda c: (-model.weight(c), c))
            if by_weight:
                x[row, : len(KINDS)] = [by_weight[0] >> k & 1 for k in range(len(KINDS))]
                x[row, -2] = _rest([model.weight(c) for c in by_weight[1:]])
        if before is not None and (x == before).all():
            break
        now, before = _newton(x, toxic, prior), x
        model = replace(model, arcs=tuple(now[: len(KINDS)].tolist()), more=float(now[-2]), constant=float(now[-1]))
    return model


def _beginnings(p: Params, wanted: frozenset[str] | None, schema: list[str]):
    """(doc_id, beginning) for each text: of all beginnings of its words, or of those wanted; or only their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in kit.slices(batch, limit=1 << 20):
                words = kit.words_of(part.column("text"))
                of_word = [{w[:k] for k in p.lengths if len(w) >= k} for w in _bare(words.vocab).to_pylist()]
                if wanted is not None:
                    of_word = [x & wanted for x in of_word]
                some = np.array([bool(x) for x in of_word] or [False])
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    codes = np.unique(words.codes[words.starts[i] : words.starts[i + 1]])
                    own = sorted(set().union(*(of_word[c] for c in codes[some[codes]].tolist()))) if len(codes) else []
                    if schema[0] == "doc_id":
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(own), pa.int64()), pa.array(own, pa.string())], schema)
                    else:
                        counts.update(own)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], schema)

    return run


def _cover(sets: dict[str, set], p: Params) -> list[str]:
    """Greedy cover, done twice: the beginning of most texts, of equal ones the longest, until few texts are left; then
    once more with beginnings that have nothing to do with the first."""
    chosen: list[str] = []
    for _ in range(2):
        left = {w: s for w, s in sets.items() if not any(w.startswith(c) or c.startswith(w) for c in chosen)}
        while left:
            best = max(sorted(left), key=lambda w: (len(left[w]), len(w)))
            covered = left[best]
            if len(covered) < p.support:
                break
            chosen.append(best)
            left = {w: s - covered for w, s in left.items()}
    return chosen


def _explain(sample: DataFrame, p: Params) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Beginnings of words, sure and likely, that toxic texts without a match have. What reaches the driver is bounded
    by the sample: beginnings that at least ``support`` of its toxic texts share."""
    texts = sample.select("row.doc_id", "row.text", "row.toxic", "clauses")
    toxic = texts.where("toxic = 1 AND size(clauses) = 0").dropDuplicates(["text"]).select("doc_id", "text")
    clean = texts.where("toxic = 0").select("doc_id", "text")
    named = toxic.mapInArrow(_beginnings(p, None, ["doc_id", "beginning"]), "doc_id long, beginning string")
    shared = {r[0]: r[1] for r in named.groupBy("beginning").count().where(F.col("count") >= p.support).collect()}
    if not shared:
        return (), ()
    counted = clean.mapInArrow(_beginnings(p, frozenset(shared), ["beginning", "n"]), "beginning string, n long")
    others = {r[0]: r[1] for r in counted.groupBy("beginning").agg(F.sum("n")).collect()}
    share = {w: n / (n + others.get(w, 0)) for w, n in shared.items()}
    useful = frozenset(w for w in shared if share[w] >= p.likely)
    sets: dict[str, set] = {w: set() for w in useful}
    for doc_id, w in toxic.mapInArrow(_beginnings(p, useful, ["doc_id", "beginning"]), "doc_id long, beginning string").toLocalIterator():
        sets[w].add(doc_id)
    sure = _cover({w: s for w, s in sets.items() if share[w] >= p.sure}, p)
    explained = set().union(*(sets[w] for w in sure))
    likely = _cover({w: s - explained for w, s in sets.items() if share[w] < p.sure}, p)
    return tuple(sure), tuple(likely)


def learned(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model from a bounded sample of labelled documents of which crc32(doc_id) mod 3 is not 1; without such rows the
    grammar's own weights."""
    model = Model()
    sample = labelled(documents.select("doc_id", "text"), labels, "toxic", p.sample, "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1")

    def rows(m: Model) -> pd.DataFrame:
        return scored(sample, m).select("row.doc_id", "row.toxic", "clauses").toPandas().sort_values(["doc_id", "toxic"], kind="stable")

    found = rows(model)
    if not len(found):
        return model
    if ((found["toxic"].to_numpy() == 1) & (found["clauses"].map(len).to_numpy() == 0)).sum() >= p.support:
        sure, likely = _explain(scored(sample, model), p)
        model = replace(model, sure=sure, likely=likely)
        found = rows(model)
    return fitted(model, [list(x) for x in found["clauses"]], found["toxic"].to_numpy().astype(float))


def held_out() -> Column:
    return F.coalesce(F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1"), F.lit(False))


def op7_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    p = Params()
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(documents, table(spark, sf_dir, "labels"), p)
    out = scored(documents, model).select("row.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
