"""Statistics over relations: modes, histograms, thresholds, exact percentiles, islands.

Each groups by the given keys; aggregates have a partial step before the exchange, and what is ordered in windows are
bins (at most 256) or, for islands, rows of one key in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import cut


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and n of the most frequent value; of equally frequent ones the least."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("best"))
    return best.select(*keys, "best.*")


def histogram(rows: DataFrame, keys: list[str], value: Column, bins: int) -> DataFrame:
    """keys, bin and share of values from 0 to 1; the last bin is closed."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(value * bins))).cast("int")
    counts = rows.select(*keys, at.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return counts.select(*keys, "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("share"))


def otsu(rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    """keys and threshold: the level (0..255) that best parts levels below it from the others, by variance between the
    two sides to six places, as sums differ in their last bits; of equal ones the largest. Both sides must have rows; keys
    with one level have no row."""
    w = Window.partitionBy(*keys)
    run = w.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    n = rows.groupBy(*keys, level).agg(F.count("*").alias("n"))
    # a threshold between two levels is as good as the upper of them, but of equal ones the largest counts
    sums = n.select(*keys, level, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("nb"), F.coalesce(F.sum(F.col("n") * F.col(level)).over(run), F.lit(0)).alias("sb"), F.sum("n").over(w).alias("na"), F.sum(F.col("n") * F.col(level)).over(w).alias("sa"))
    nf, sf = F.col("na") - F.col("nb"), F.col("sa") - F.col("sb")
    apart = F.col("sb") / F.col("nb") - sf / nf
    rated = sums.where("nb > 0").withColumn("between", F.round(F.col("nb").cast("double") * nf * apart * apart * 1e6))
    return rated.groupBy(*keys).agg(F.max_by(level, F.struct("between", level)).alias("threshold"))


def positional_percentile(rows: DataFrame, keys: list[str], value: str, place: Column, slots: int = 64) -> DataFrame:
    """keys and value at a 0-based place of the sorted values; ``place`` is an expression of their number n.

    Values are counted before they are ranked, so a key's many equal values are one row. A key's values are cut into slots
    at approximate percentiles; counts of the slots tell which one has the place, and only its values are put in order, so
    the result is exact and few keys with many values keep no task alone."""
    cuts = F.percentile_approx(value, F.array(*[F.lit(k / slots) for k in range(1, slots)]), F.lit(20 * slots)).alias("cuts")
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("m")))
    bounds = counts.groupBy(*keys).agg(cuts, F.sum("m").alias("n"))
    slotted = counts.join(bounds, keys).withColumn("slot", F.size(F.filter("cuts", lambda c: c < F.col(value))))
    of_key = Window.partitionBy(*keys)
    sums = slotted.groupBy(*keys, "slot", "n").agg(F.sum("m").alias("in_slot"))
    sums = sums.withColumn("before", F.coalesce(F.sum("in_slot").over(of_key.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    chosen = sums.where((F.col("before") <= place) & (place < F.col("before") + F.col("in_slot"))).select(*keys, "slot", "before")
    inside = slotted.join(chosen, [*keys, "slot"])
    upto = inside.withColumn("upto", F.col("before") + F.sum("m").over(of_key.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where(F.col("upto") > place).groupBy(*keys).agg(F.min(value).alias("value"))


def islands(rows: DataFrame, keys: list[str], order: list[str], present: Column, gap: int = 1) -> DataFrame:
    """keys, island, first, last, n: runs of rows that are ``present``, by their place (0-based) in order. Runs that
    fewer than ``gap`` absent rows part are one."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).where(present)
    by_place = w.orderBy("place")
    begins = F.coalesce((F.col("place") - F.lag("place").over(by_place) > gap).cast("int"), F.lit(1))
    named = placed.withColumn("begins", begins).withColumn("island", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*keys, "island").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))


def heaviest(bands: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """The heaviest island of each key; of equal ones the first."""
    w = Window.partitionBy(*keys).orderBy(F.desc(weight), "island")
    return bands.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def merged_bands(bands: DataFrame, keys: list[str], thin: Column, near: Column) -> DataFrame:
    """Islands without those that are ``thin``, those with fewer than ``near`` rows between them taken together."""
    by_first = Window.partitionBy(*keys).orderBy("first")
    kept = bands.where(~thin)
    begins = F.coalesce((F.col("first") - F.lag("last").over(by_first) - 1 >= near).cast("int"), F.lit(1))
    named = kept.withColumn("begins", begins).withColumn("band", F.sum("begins").over(by_first.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy(*keys, "band").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def clear_main(bands: DataFrame, keys: list[str], times: float = 2.0) -> DataFrame:
    """The heaviest band, where it has at least ``times`` the rows of the second."""
    w = Window.partitionBy(*keys)
    ranked = bands.withColumn("_row", F.row_number().over(w.orderBy(F.desc("n"), "band"))).withColumn("_next", F.lead("n").over(w.orderBy(F.desc("n"), "band")))
    return ranked.where((F.col("_row") == 1) & (F.col("n") >= times * F.coalesce("_next", F.lit(0)))).drop("_row", "_next")


def latest_unique(rows: DataFrame, keys: list[str], value: str, order: list[str], most: int = 8) -> DataFrame:
    """The ``most`` values that were seen last, the latest first, each once: keys, value, place."""
    seen = rows.groupBy(*keys, value).agg(F.max(F.struct(*order)).alias("seen"))
    w = Window.partitionBy(*keys).orderBy(F.desc("seen"), value)
    return seen.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*keys, value, "place")


def components(cells: DataFrame, key: str, diagonal: bool = True) -> DataFrame:
    """key, x, y and label (least y * 2^32 + x of the component) of grid cells joined to their neighbours.

    Labels spread to neighbours and, through the cell they name, by jumps; the number of rounds grows with the logarithm
    of a component's extent for compact ones. Needs spark.checkpoint.dir."""
    code = (F.col("y").cast("long") * F.lit(1 << 32) + F.col("x")).cast("long")
    now = cells.select(key, "x", "y", code.alias("code"), code.alias("label"))
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0) and (diagonal or 0 in (dx, dy))]
    moved = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])
    while True:
        now = cut(now)
        told = now.select(key, "label", F.explode(moved).alias("to")).select(key, "to.x", "to.y", "label").groupBy(key, "x", "y").agg(F.min("label").alias("near"))
        spread = now.join(told, [key, "x", "y"], "left").withColumn("near", F.least("label", F.coalesce("near", "label")))
        of = now.select(key, F.col("code").alias("near"), F.col("label").alias("far"))
        new = spread.join(of, [key, "near"], "left").select(key, "x", "y", "code", F.least("near", F.coalesce("far", "near")).alias("new"), "label")
        new = cut(new)
        if not new.where("new < label").limit(1).count():
            return now.select(key, "x", "y", "label")
        now = new.select(key, "x", "y", "code", F.col("new").alias("label"))


def boxes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, area, bounding box, centroid (of cell centres) and the side of the square that a rotation stays inside."""
    box = cells.groupBy(*keys).agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg(F.col("x") + 0.5).alias("cx"), F.avg(F.col("y") + 0.5).alias("cy"))
    reach = cells.join(box.select(*keys, "cx", "cy"), keys).groupBy(*keys).agg(F.max(F.hypot(F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy"))).alias("reach"))
    return box.join(reach, keys).withColumn("side", 2.02 * F.col("reach"))
