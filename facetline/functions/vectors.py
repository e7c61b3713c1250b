"""Array-valued Column functions. Each works within a row and stays in the JVM.

Vectors of differing length, and vectors without length, have similarity 0 rather than null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """f(value) with value computed once; inside of lambdas nothing else would keep it from being computed anew."""
    return F.element_at(F.transform(F.array(value), f), 1)


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def _zipped(a: Column | str, b: Column | str, f) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _zipped(a, b, lambda x, y: x * y)


def positive_dot(a: Column | str, b: Column | str) -> Column:
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.greatest(F.lit(0.0), dot(a, b))).otherwise(0.0)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.when(F.size(_c(a)) == F.size(_c(b)), let(norm(a) * norm(b), lambda length: F.when(length > 0, dot(a, b) / length).otherwise(0.0))).otherwise(0.0)


def intersection(a: Column | str, b: Column | str) -> Column:
    """Overlap of two histograms."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), _zipped(a, b, lambda x, y: F.least(x, y))).otherwise(0.0)


def chi_square(a: Column | str, b: Column | str) -> Column:
    """Half the sum of (x-y)^2/(x+y); bins that are empty on both sides don't count; 1 for differing lengths."""
    apart = _zipped(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))
    return F.when(F.size(_c(a)) == F.size(_c(b)), 0.5 * apart).otherwise(1.0)


def l1(v: Column | str) -> Column:
    """Divided by its sum, or as it is if that isn't positive."""
    v = _c(v)
    return let(total(v), lambda s: F.when(s > 0, F.transform(v, lambda x: x / s)).otherwise(v))


def l2(v: Column | str, without: float | None = None) -> Column:
    """Divided by its length. Without length it is as it is, or ``without`` in each place."""
    left = lambda v: v if without is None else F.transform(v, lambda _: F.lit(without))
    return let(_c(v), lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).when(n == 0, left(v)).otherwise(v)))


def centred(v: Column | str, places: int | None = None, without: float | None = None) -> Column:
    """Mean taken away, then unit length: dot products of such vectors are normalised cross-correlations. The mean is over
    ``places``, if they are given, however many elements there are; what doesn't vary is ``without``, or zeros."""
    v = _c(v)
    return l2(let(total(v) / (F.greatest(F.size(v), F.lit(1)) if places is None else places), lambda mean: F.transform(v, lambda x: x - mean)), without)


def rolled(v: Column | str, steps: Column | int) -> Column:
    """Circular shift: element i goes to i + steps."""
    v = _c(v)
    return F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.element_at(v, (F.pmod(i - steps, F.size(v)) + 1).cast("int")))


def best_roll(a: Column | str, b: Column | str, similarity=cosine) -> Column:
    """The largest similarity over all circular shifts of b."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.size(_c(b)) - 1), lambda k: similarity(a, rolled(b, k))))


def cells(v: Column | str, side: int, to: int) -> Column:
    """A side x side grid as the means of to x to blocks, at unit length."""
    v, step = _c(v), side // to
    blocks = [[y * side + x + 1 for y in range(r * step, (r + 1) * step) for x in range(c * step, (c + 1) * step)] for r in range(to) for c in range(to)]
    means = F.array(*[sum((F.element_at(v, i) for i in block[1:]), F.element_at(v, block[0])) / float(len(block)) for block in blocks])
    return l2(means)


def quarter_turns(v: Column | str, side: int) -> Column:
    """The grid turned by 0, 90, 180 and 270 degrees; no resampling."""
    v = _c(v)
    at = [[(y, x) for y in range(side) for x in range(side)]]
    for _ in range(3):
        at.append([(x, side - 1 - y) for y, x in at[-1]])
    return F.array(*[F.transform(F.array(*[F.lit(y * side + x + 1) for y, x in turn]), lambda i: F.element_at(v, i)) for turn in at])


def softmax(v: Column | str, temperature: float = 1.0) -> Column:
    v = _c(v)
    raised = let(F.array_max(v), lambda most: F.transform(v, lambda x: F.exp((x - most) / temperature)))
    return let(raised, lambda r: let(total(r), lambda s: F.transform(r, lambda x: x / s)))


def positional(v: Column | str, place: Column) -> Column:
    """Element of the sorted vector at a 0-based place; exact, unlike percentile functions that interpolate."""
    return F.element_at(F.array_sort(_c(v)), place.cast("int") + 1)


def upper_median(v: Column | str) -> Column:
    return positional(v, F.floor(F.size(_c(v)) / 2))


def strided(v: Column | str, most: int) -> Column:
    """At most ``most`` elements, evenly spread."""
    v = _c(v)
    return F.when(F.size(v) <= most, v).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(v, (F.floor(i * F.size(v) / most) + 1).cast("int"))))


def weighted(parts: dict[str, float]) -> Column:
    """Sum of columns by weight."""
    terms = [w * F.col(c) for c, w in parts.items()]
    return sum(terms[1:], terms[0])


def relu(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), _c(x))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))
