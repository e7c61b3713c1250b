"""Quality rules: a decision list learned by sequential covering (grow, then prune) from labelled statistics.

Each rule is a conjunction of thresholds on statistics and rejects what it matches. The list becomes one ordered Spark
conditional expression, so applying it needs no Python beyond the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as kit
from .shared import labelled, packed, table

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: Derived statistics that rules may test, as SQL over COUNTS.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}
REPEAT = 8


@dataclass(frozen=True)
class Params:
    #: expected bound on the labelled rows that the rules are learned from
    sample: int = 20_000
    conditions: int = 4
    rules: int = 24
    cuts: int = 64
    #: share of rejected rows that must carry label 0, on the rows a rule was grown from and on those it was pruned on
    precision: float = 0.9
    cover: int = 5


def _bytes_class(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Counted on the words' bytes: code points start where a byte is no continuation byte.
_CLASSES = {"word_chars": ~_bytes_class(range(0x80, 0xC0)), "n_symbols": _bytes_class(SYMBOLS), "n_upper": _bytes_class(range(65, 91)), "n_digits": _bytes_class(range(48, 58)), "n_marks": _bytes_class(b"!?")}
_SOLID = ~_bytes_class(b" \t\n\v\f\r")


def _class_counts(strings: pa.Array, members: np.ndarray) -> np.ndarray:
    """How many bytes of each string are in a class."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return kit.sum_by(offsets - offsets[0], members[raw[offsets[0] : offsets[-1]]])


def _repeated(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each text that stand in a window of eight words found more than once in it."""
    windows = kit.window_hashes(kit.mix64(codes.astype(np.uint64) + np.uint64(1)), REPEAT)
    out = np.zeros(len(starts) - 1, np.int64)
    for i in np.flatnonzero(np.diff(starts) > REPEAT):
        own = windows[starts[i] : starts[i + 1] - REPEAT + 1]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            edge = np.zeros(len(own) + REPEAT, np.int64)
            at = np.flatnonzero(np.isin(own, twice))
            edge[at] += 1
            edge[at + REPEAT] -= 1
            out[i] = np.count_nonzero(np.cumsum(edge) > 0)
    return out


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each whole text; a null text has no words."""
    words = kit.words_of(texts)
    out = {"n_words": words.counts}
    for name, members in _CLASSES.items():
        out[name] = kit.sum_by(words.starts, _class_counts(words.vocab, members)[words.codes])
    owners = words.owners()
    out["n_distinct"] = np.bincount(np.unique(owners * max(1, len(words.vocab)) + words.codes) // max(1, len(words.vocab)), minlength=len(texts))
    out["n_repeat_words"] = _repeated(words.codes, words.starts)

    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes = encoded.indices.to_numpy()
    solid = (_class_counts(encoded.dictionary, _SOLID) > 0)[codes]
    owners = np.repeat(np.arange(len(texts)), np.diff(offsets))[solid]
    lines = max(1, len(encoded.dictionary))
    out["n_lines"] = np.bincount(owners, minlength=len(texts))
    out["n_dup_lines"] = out["n_lines"] - np.bincount(np.unique(owners * lines + codes[solid]) // lines, minlength=len(texts))
    return {name: out[name].astype(np.int64) for name in COUNTS}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in kit.unpacked(batches):
        for part in kit.slices(batch):
            counts = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(counts[name]) for name in COUNTS)], ["row", *COUNTS])


def measured(documents: DataFrame) -> DataFrame:
    """row (a struct of all columns, whatever their names) and COUNTS."""
    rows, kind = packed(documents)
    return rows.mapInArrow(kit.tidied(_measure), f"row {kind}, " + ", ".join(f"{name} long" for name in COUNTS))


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


# -- learning ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        values = x[self.feature].to_numpy()
        return values >= self.cut if self.above else values <= self.cut

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _best_condition(x: pd.DataFrame, bad: np.ndarray, p: Params) -> Condition | None:
    """The condition of the largest information gain over the rows that the rule covers so far (Quinlan's FOIL)."""
    pos, total = bad.sum(), len(bad)
    before, best, gain = np.log2(pos / total), None, 1e-9
    for feature in FEATURES:
        values = x[feature].to_numpy()
        for cut in np.unique(np.quantile(values[bad], np.linspace(0, 1, p.cuts), method="nearest")).tolist():
            for above in (True, False):
                hit = values >= cut if above else values <= cut
                n, k = hit.sum(), (hit & bad).sum()
                if k and (g := k * (np.log2(k / n) - before)) > gain:
                    best, gain = Condition(feature, above, cut), g
    return best


def learn(rows: pd.DataFrame, p: Params = Params()) -> list[Rule]:
    """Ordered rules for label 0 from FEATURES and quality. Rows alternate between growing (two of three) and pruning."""
    rows, rules = rows.reset_index(drop=True), []
    prune = rows.index.to_numpy() % 3 == 2
    bad = rows["quality"].to_numpy() == 0
    left = np.ones(len(rows), bool)
    while len(rules) < p.rules and (bad & left & ~prune).sum() >= p.cover:
        inside, rule = left & ~prune, ()
        while len(rule) < p.conditions and (~bad[inside]).any():
            found = _best_condition(rows[inside], bad[inside], p)
            if found is None:
                break
            rule += (found,)
            inside &= found.holds(rows)

        def worth(r: Rule) -> tuple[float, int]:
            hit = _covered(r, rows) & left & prune
            n, k = hit.sum(), (hit & bad).sum()
            return ((2 * k - n) / n if n else -1.0, -len(r))

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())
        hit = _covered(rule, rows) & left
        if not rule or any((hit & bad & side).sum() < p.precision * max(1, (hit & side).sum()) for side in (prune, ~prune)):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def keeps(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: false where a rule matches."""
    whens = "".join(f" WHEN {' AND '.join(f'({c.sql()})' for c in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE{whens} ELSE true END") if rules else F.lit(True)


def learned(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> list[Rule]:
    """Rules from a bounded sample of labelled documents; none if labels have one class only.

    Labels other than 0 and 1 and documents without text are left out."""
    sample = labelled(documents.where("text IS NOT NULL"), labels, "quality", p.sample)
    rows = measured(sample).where(~base_failed()).select(*(F.expr(sql).alias(name) for name, sql in FEATURES.items()), F.col("row.quality").alias("quality"), F.col("row.doc_id").alias("doc_id"))
    return learn(rows.toPandas().sort_values(["doc_id", *FEATURES, "quality"], kind="stable"), p)


def rated(documents: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """row, COUNTS, base_failed and kept (false if base_failed, else what the rules say) of every row of ``documents``.

    Null and empty texts have no words and fail the base rule. Repeated rows get equal results; with no labels only the
    base rule rejects; an empty table gives no rows."""
    return measured(documents).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & keeps(learned(documents, labels, p)))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rated(documents, table(spark, sf_dir, "labels")).select("row.doc_id", *COUNTS[:5], "base_failed", "kept")
