"""Ranking stages over pairs (query_id, ref_id, ...): gates, per-query statistics, adaptive weights, blends, tails.

All are windows or aggregates by query_id, so one exchange by query serves a whole chain of them; only ids and scores are
moved, never vectors. Every order ends with ref_id, which makes ties the same on any number of machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query() -> Window:
    return Window.partitionBy("query_id")


def family_gate(score: str, least: float = 0.015, start: float = 0.7, slope: float = 0.15) -> Column:
    """1 for rows within a margin of the query's best score, else 0; the margin widens as the best grows."""
    best = F.max(score).over(per_query())
    return F.when(F.col(score) >= best - F.greatest(F.lit(least), (best - start) * slope), 1).otherwise(0)


def leads(pairs: DataFrame, features: str) -> DataFrame:
    """query_id, dim, best and gap: for each dimension of a feature vector its best value over the query's rows and how
    far the second lies below (equal values count twice); both start at -1 and are at least 0."""
    each = pairs.select("query_id", F.posexplode(features).alias("dim", "v"))
    place = F.row_number().over(Window.partitionBy("query_id", "dim").orderBy(F.desc("v")))
    top = each.withColumn("place", place).where("place <= 2")  # two rows of each leave a task
    two = top.groupBy("query_id", "dim").agg(F.max(F.when(F.col("place") == 1, F.col("v"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("v"))).alias("second"))
    first, second = (F.greatest(F.lit(0.0), F.coalesce(c, F.lit(-1.0))) for c in ("first", "second"))
    return two.select("query_id", "dim", first.alias("best"), (first - second).alias("gap"))


def with_leads(pairs: DataFrame, features: str) -> DataFrame:
    """Pairs with the vector extended to three times its width: values, bests and gaps of their query."""
    rows = leads(pairs, features).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("dim", "best", "gap"))).alias("s"))
    return pairs.join(rows, "query_id").withColumn(features, F.concat(features, F.col("s.best"), F.col("s.gap"))).drop("s")


def spread_of_others(dims: DataFrame, most: int = 10) -> DataFrame:
    """query_id, dim, rows, top, mean and std of ranks 2..most of each (query_id, dim, ref_id, score)."""
    order = Window.partitionBy("query_id", "dim").orderBy(F.desc("score"), "ref_id")
    near = dims.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    rest = F.col("place") > 1
    return near.groupBy("query_id", "dim").agg(
        F.count("*").alias("rows"), F.max(F.when(~rest, F.col("score"))).alias("top"), F.avg(F.when(rest, F.col("score"))).alias("mean"), F.stddev_pop(F.when(rest, F.col("score"))).alias("std")
    )


def adaptive_weights(dims: DataFrame, prior: dict[str, float], most: int = 10, temperature: float = 1.0, mix: float = 0.5, least: float = 0.05, largest: float = 0.5) -> DataFrame:
    """query_id, dim, weight: how much each dimension sets the query's best row apart, mixed with a prior.

    z is how many deviations the first lies above ranks 2..most; softmax of z, averaged with the prior, clipped and made
    to sum to 1. With under three rows, or without any spread, a dimension has z 0; if all have, the prior holds."""
    per = spread_of_others(dims, most)
    z = F.when((F.col("rows") >= 3) & (F.col("std") > 1e-9), F.greatest(F.lit(0.0), (F.col("top") - F.col("mean")) / F.col("std"))).otherwise(0.0)
    known = F.lit(0.0)
    for name, w in prior.items():
        known = F.when(F.col("dim") == name, w).otherwise(known)
    raised = F.exp((F.col("z") - F.max("z").over(per_query())) / temperature)
    soft = per.withColumn("z", z).withColumn("prior", known / F.sum(known).over(per_query())).withColumn("soft", raised / F.sum(raised).over(per_query()))
    clipped = F.least(F.lit(largest), F.greatest(F.lit(least), mix * F.col("prior") + (1 - mix) * F.col("soft")))
    weight = F.when(F.max("z").over(per_query()) > 0, clipped / F.sum(clipped).over(per_query())).otherwise(F.col("prior"))
    return soft.select("query_id", "dim", weight.alias("weight"))


def dispersion_weights(dims: DataFrame) -> DataFrame:
    """query_id, dim, weight: lead of the best row over the mean of the others, by the spread of all rows around that
    mean; weights of a query sum to 1, evenly if no dimension leads. One row: weight 1 each before that."""
    per = dims.groupBy("query_id", "dim").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max("score").alias("top"))
    centre = (F.col("s") - F.col("top")) / (F.col("n") - 1)
    per = per.withColumn("centre", F.when(F.col("n") > 1, centre))
    apart = dims.join(per, ["query_id", "dim"]).groupBy("query_id", "dim").agg(
        F.max("n").alias("n"), (F.max("top") - F.max("centre")).alias("lead"), F.sqrt(F.avg((F.col("score") - F.col("centre")) * (F.col("score") - F.col("centre")))).alias("spread")
    )
    raw = F.when(F.col("n") == 1, 1.0).when((F.col("spread") > 0) & (F.col("lead") > 0), F.col("lead") / (F.col("spread") + 1e-9)).when(F.col("lead") > 0, F.col("lead")).otherwise(0.0)
    w = apart.withColumn("raw", raw).withColumn("all", F.sum("raw").over(per_query())).withColumn("dims", F.count("*").over(per_query()))
    return w.select("query_id", "dim", F.when(F.col("all") <= 1e-9, 1 / F.col("dims")).otherwise(F.col("raw") / F.col("all")).alias("weight"))


def fused(dims: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, ref_id, score: sum of a row's dimensions by weight. Weights are one row a query and dimension."""
    return dims.join(weights, ["query_id", "dim"]).groupBy("query_id", "ref_id").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))


def cut_or_all(pairs: DataFrame, score: str, cut: float) -> DataFrame:
    """Rows that reach the cut; all rows of a query of which none does."""
    return pairs.withColumn("_best", F.max(score).over(per_query())).where((F.col(score) >= cut) | (F.col("_best") < cut)).drop("_best")


def blended(head: DataFrame, first: int = 12, share: float = 0.7) -> DataFrame:
    """head (query_id, ref_id, score, hist, gate, second) re-ranked: rows of rank 1..first get
    (1 - share) * score + share * second, then all are sorted anew; rows that are equal keep their earlier order."""
    order = [F.desc("score"), F.desc("hist"), F.desc("gate")]
    once = head.withColumn("earlier", F.row_number().over(per_query().orderBy(*order, "ref_id")))
    mixed = F.when(F.col("earlier") <= first, (1 - share) * F.col("score") + share * F.col("second")).otherwise(F.col("score")) if share > 0 else F.col("score")
    return once.withColumn("score", mixed).withColumn("rank", F.row_number().over(per_query().orderBy(*order, "earlier"))).drop("earlier")


def with_tail(head: DataFrame, all_rows: DataFrame, k: int | None = None) -> DataFrame:
    """The head by its rank, then all other rows by their cheap score ``pref``: query_id, ref_id, score, stage, rank."""
    tail = all_rows.join(head.select("query_id", "ref_id"), ["query_id", "ref_id"], "left_anti").select("query_id", "ref_id", F.col("pref").alias("score"), F.lit(2).alias("stage"), F.lit(0).alias("rank"))
    both = head.select("query_id", "ref_id", "score", F.lit(1).alias("stage"), "rank").unionByName(tail)
    out = both.withColumn("rank", F.row_number().over(per_query().orderBy("stage", "rank", F.desc("score"), "ref_id")))
    return out if k is None else out.where(F.col("rank") <= k)


def gate_first(pairs: DataFrame, score: str, gate: str) -> DataFrame:
    """Rank with all rows of the gate's group first."""
    return pairs.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc(gate), F.desc(score), "ref_id")))


def tie_band(pairs: DataFrame, second: str, band: float = 0.02, first: int = 8) -> DataFrame:
    """Rows (with score and rank) among the first few that lie within a band of the best are put in order of another
    score; all others keep their places after them."""
    best = F.max("score").over(per_query())
    inside = pairs.withColumn("inside", ((F.col("rank") <= first) & (F.col("score") >= best - band)).cast("int"))
    order = per_query().orderBy(F.desc("inside"), F.desc(F.when(F.col("inside") == 1, F.col(second))), "rank")
    return inside.withColumn("rank", F.row_number().over(order)).drop("inside")


def recall(ranked: DataFrame, truth: DataFrame, at: tuple[int, ...] = (1, 3)) -> DataFrame:
    """k and recall: share of queries in ``truth`` (query_id, ref_id) with a right row among the first k."""
    hits = truth.join(ranked, ["query_id", "ref_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    each = hits.select("rank", F.explode(F.array(*map(F.lit, at))).alias("k"))
    return each.groupBy("k").agg(F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("recall"))
