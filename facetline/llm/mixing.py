"""Mixing sources to target weights by subset-sum budget fitting.

Per source: whole passes over it, then a subset of its documents for the rest of the budget. Documents are counted by
exact length; each length gives its share of the budget but for a range of words, and that range is filled by
bounded-knapsack dynamic programming over the documents that are left. A range that isn't filled to the word is doubled
until it is, or holds the whole budget. Which documents of a length are taken is decided by a seeded hash: all up to a
cut. Counts of hash ranges, as many as the rows need, tell in which range the cut of each (source, length) lies, and only
the rows of that range are put in order, so neither a source nor a length ever meets in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: words that the dynamic programme fills at first, and the most it goes up to (4 bytes of memory each)
RANGE, MOST_RANGE = 1 << 16, 1 << 26
#: rows of a hash range, on average, if all were of one length
RANGE_ROWS = 1 << 16
#: (source, length) pairs are broadcast up to this number; beyond it, they are joined by shuffle
BROADCAST = 500_000


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take for the largest sum of at most ``budget``."""
    taken = np.zeros(len(lengths), np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by = np.full(budget + 1, -1, np.int64)
    steps: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        count, part = min(count, budget // length), 1
        while count > 0 and not reached[budget]:
            many = min(part, count)  # counts in binary parts
            count, part = count - many, 2 * part
            new = np.zeros_like(reached)
            new[many * length :] = reached[: budget + 1 - many * length]
            new &= ~reached
            by[new] = len(steps)
            steps.append((i, many))
            reached |= new
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, many = steps[by[at]]
        taken[i] += many
        at -= many * int(lengths[i])
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = MOST_RANGE) -> np.ndarray:
    """Number of documents of each length whose lengths sum to ``budget``, or to the largest sum below it. Lengths are
    distinct.

    The sum is the largest one possible if it is the budget (rounded down to a multiple of all lengths' divisor), or if
    the range that was searched, at most ``most`` words and the longest length, held the whole budget."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = sum(int(x) * int(n) for x, n in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    unit = int(np.gcd.reduce(lengths))
    lengths, budget, total = lengths // unit, budget // unit, total // unit
    span, best, least = RANGE, np.zeros(len(lengths), np.int64), budget + 1
    order = np.argsort(-lengths, kind="stable")
    while True:
        share = max(0, budget - span)
        taken = np.array([int(n) * share // total for n in counts], np.int64)
        rest = budget - sum(int(x) * int(n) for x, n in zip(lengths, taken, strict=True))
        for i in order:  # one more of each length, so that no length stands out
            if share and taken[i] < counts[i] and rest - int(lengths[i]) >= span:
                taken[i] += 1
                rest -= int(lengths[i])
        small = order[(lengths[order] > 0) & (lengths[order] <= rest) & (taken[order] < counts[order])]
        more = _knapsack(lengths[small], counts[small] - taken[small], rest)
        taken[small] += more
        rest -= sum(int(x) * int(n) for x, n in zip(lengths[small], more, strict=True))
        if rest < least:
            best, least = taken, rest
        if not rest or not share or span >= most:
            return best
        span *= 8


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    sizes, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    own, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = min(int(target // own), MOST) if own else 0
    extra = fit(sizes, counts, round(target - passes * own))
    return pd.DataFrame({"key": rows["key"], "size": sizes, "passes": np.int64(passes), "extra": extra, "source_size": np.int64(own), "target": target})


def targets(sources: DataFrame) -> DataFrame:
    """key, source and source_size of each source to key, source_size, weight, target.

    Sources by code point, null last, weigh 3, 1, 2, repeating. A target is min(2 * source_size, weight * level) with
    the level at which targets sum to 150% of all sizes: sorted by size over weight, each source gives the level that
    holds if all before it stand at their limit, and the largest of these is the one. One row for each source.
    """
    by_name, by_limit = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    every = Window.partitionBy()
    weights = F.array(*map(F.lit, WEIGHTS))
    limit = MOST * F.col("source_size")
    return (
        sources.withColumn("weight", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
        .withColumn("before", F.coalesce(F.sum(limit).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("onwards", F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((SHARE * F.sum("source_size").over(every) - F.col("before")) / F.col("onwards")).over(every))
        .select("key", "source_size", "weight", F.least(limit.cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def _tagged(documents: DataFrame, seed: int) -> DataFrame:
    """With key (a source's name that is never null), size and the seeded hash."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))
    return documents.select(F.struct("*").alias("row"), key.alias("key"), words_in().alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64(text)).alias("h"))


def _before(n: Column | str, by: Window) -> Column:
    return F.coalesce(F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _plan(narrow: DataFrame, scratch: Scratch) -> DataFrame:
    """For each (key, size): passes; cut, up to which hash one more is taken (null: none); many rows have just that hash,
    and ties of them are taken."""
    rows = narrow.count()
    bits = max(0, (-(-rows // RANGE_ROWS) - 1).bit_length())
    placed = narrow.withColumn("part", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long"))
    parts = scratch.put(placed.groupBy("key", "size", "part").agg(F.count("*").alias("n")), "parts", rows)
    counts = parts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    sources = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = sources.withColumn("source", F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)))
    budgets = counts.join(targets(named), "key").groupBy("key").applyInPandas(_fit_source, "key string, size long, passes long, extra long, source_size long, target double")
    budgets = scratch.put(budgets, "budgets", rows)
    few = budgets.count() <= BROADCAST
    of_length = Window.partitionBy("key", "size")
    last = parts.join(budgets.select("key", "size", "extra"), ["key", "size"]).withColumn("before", _before("n", of_length.orderBy("part")))
    last = last.where("before < extra AND extra <= before + n").select("key", "size", "part", (F.col("extra") - F.col("before")).alias("wanted"))
    in_part = placed.join(F.broadcast(last) if few else last, ["key", "size", "part"]).groupBy("key", "size", "h").agg(F.count("*").alias("many"), F.max("wanted").alias("wanted"))
    cuts = in_part.withColumn("before", _before("many", of_length.orderBy("h"))).where("before < wanted AND wanted <= before + many")
    cuts = cuts.select("key", "size", F.col("h").alias("cut"), "many", (F.col("wanted") - F.col("before")).alias("ties"))
    plan = scratch.put(budgets.drop("extra").join(cuts, ["key", "size"], "left"), "plan", rows)
    scratch.drop("parts", "budgets")
    return plan


def _decided(tagged: DataFrame, plan: DataFrame) -> DataFrame:
    """``tagged`` with the columns of its plan, and copies. Only where rows with the very same hash are taken in part are
    those, and no others, numbered."""
    few = plan.count() <= BROADCAST
    parted = F.col("cut").isNotNull() & (F.col("h") == F.col("cut")) & (F.col("ties") < F.col("many"))

    def copies(more: Column) -> Column:
        return F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")

    each = tagged.join(F.broadcast(plan) if few else plan, ["key", "size"])
    if plan.where("ties < many").isEmpty():
        return each.withColumn("copies", copies(F.col("h") <= F.col("cut")))
    turn = F.row_number().over(Window.partitionBy("key", "size").orderBy(F.xxhash64(F.to_json("row"))))
    plain = each.where(~F.coalesce(parted, F.lit(False))).withColumn("copies", copies(F.col("h") <= F.col("cut")))
    return plain.unionByName(each.where(parted).withColumn("turn", turn).withColumn("copies", copies(F.col("turn") <= F.col("ties"))).drop("turn"))


def mix(documents: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (0, 1 or 2) of each row of ``documents`` (doc_id, text, source).

    Null texts, empty texts and texts without words have size 0; null sources are one source, weighed last. Sources
    without words have target 0 and nothing is taken. Ties and repeated rows are told apart by hash order, and equal
    rows are interchangeable. An empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    narrow = scratch.put(_tagged(documents.select("doc_id", "text", "source"), seed).select(F.struct(F.col("row.doc_id").alias("doc_id")).alias("row"), "key", "size", "h"), "narrow")
    done = _decided(narrow, _plan(narrow.drop("row"), scratch))
    return done.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(documents: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``documents`` as the mix takes them: each as often as its copies say, all columns kept. Rows are decided
    where they lie: what is joined to them is a row for each (source, length)."""
    scratch = Scratch(documents.sparkSession, "mixing")
    tagged = _tagged(documents, seed)
    narrow = scratch.put(tagged.select("key", "size", "h"), "narrow")
    done = _decided(tagged, _plan(narrow, scratch)).where("copies > 0")
    scratch.drop("narrow")
    return done.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
