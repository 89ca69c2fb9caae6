"""Vectors as arrays of doubles: a deterministic sentence encoder, similarities and smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F



def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apart(value: Column) -> Column:
    """A column that Catalyst leaves where it is: not being deterministic, it isn't merged into what uses it.

    Needed before a Python function whose argument holds a lambda, which Spark would else leave unextracted.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


WORD = r"[\p{L}\p{N}]+"
#: Similarities are rounded to so many digits before they are compared, so that engines agree.
DIGITS = 9


def word_dimensions(sentence: Column, dimensions: int = 64) -> Column:
    """The dimension of each word of a sentence, that its MD5 gives."""
    words = F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int"))


def hashed(sentence: Column, dimensions: int = 64) -> Column:
    """Unit vector of word counts, each word in the dimension that its MD5 gives; all zero without words."""
    zero = F.array_repeat(F.lit(0.0), dimensions)
    places = F.array(*[F.lit(d) for d in range(dimensions)])
    counts = let(word_dimensions(sentence, dimensions), lambda bs: F.when(F.size(bs) > 0, F.transform(places, lambda d: (F.size(bs) - F.size(F.array_remove(bs, d))).cast("double"))).otherwise(zero))
    return unit(counts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    scaled = lambda v: let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))
    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector is zero, rounded."""

    def of(p: Column) -> Column:
        size = F.sqrt(dot(p["a"], p["a"])) * F.sqrt(dot(p["b"], p["b"]))
        return let(size, lambda n: F.round(F.when(n > 0, dot(p["a"], p["b"]) / n).otherwise(F.lit(0.0)), DIGITS))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def mean(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors."""

    def of(vs: Column) -> Column:
        total = F.aggregate(F.slice(vs, F.lit(2), F.size(vs)), F.element_at(vs, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        return F.transform(total, lambda x: x / F.size(vs))

    return let(vectors, of)


def adjacent(vectors: Column) -> Column:
    """Cosine of each vector and the next."""
    none = F.array().cast("array<double>")
    return let(vectors, lambda v: F.when(F.size(v) > 1, F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), cosine)).otherwise(none))


#: Gaps up to which the dot products of vectors and those after them are made: what the widest scale needs.
BANDS = 4


def bands(vectors: Column) -> Column:
    """For each vector its dot products with itself and the next ``BANDS``: array of array of double, null beyond the end."""

    def of(vs: Column) -> Column:
        each = lambda v, i: F.transform(F.array(*[F.lit(k) for k in range(BANDS + 1)]), lambda k: F.when(i + k < F.size(vs), dot(v, F.get(vs, i + k))))
        return F.transform(vs, each)

    return let(vectors, of)


def from_bands(dots: Column, scale: int) -> Column:
    """:func:`at_scale` from the vectors' dot products: those of means are means of dot products."""
    h = scale // 2
    if 2 * h > BANDS:
        raise ValueError(f"scale {scale} needs dot products over {2 * h} places")

    def product(dots: Column, a: Column, b: Column) -> Column:
        return F.get(F.get(dots, F.least(a, b)), F.abs(a - b))

    def total(dots: Column, rows: list, columns: list) -> Column:
        """Sum of dot products over two ranges, given as places and whether each is in the text."""
        out = F.lit(0.0)
        for a, a_in in rows:
            for b, b_in in columns:
                out = out + F.when(a_in & b_in, product(dots, a, b)).otherwise(F.lit(0.0))
        return out

    def of(dots: Column) -> Column:
        n = F.size(dots)

        def here(i: Column) -> Column:
            left = [(i - k, i - k >= 0) for k in range(h, -1, -1)] if scale > 1 else [(i, i >= 0)]
            right = [(i + k, i + k < n) for k in range(h + 1)] if scale > 1 else [(i + 1, i + 1 < n)]
            size = F.sqrt(total(dots, left, left)) * F.sqrt(total(dots, right, right))
            return let(size, lambda z: F.round(F.when(z > 0, total(dots, left, right) / z).otherwise(F.lit(0.0)), DIGITS))

        return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), here)).otherwise(F.array().cast("array<double>"))

    return let(dots, of)


def at_scale(vectors: Column, scale: int) -> Column:
    """Cosine at each gap i of the means of vectors i - h to i and i to i + h, h half the scale; both include i. Scale 1 is :func:`adjacent`."""
    return from_bands(bands(vectors), scale)


def windowed_boundaries(vectors: Column, window: int, threshold: float) -> Column:
    """Places i at which the means of the ``window`` vectors before i and from i on are less alike than ``threshold``; none in fewer than two windows."""

    def sim(i: Column) -> Column:
        return cosine(mean(F.slice(vectors, i - window + 1, window)), mean(F.slice(vectors, i + 1, window)))

    return F.when(F.size(vectors) >= 2 * window + 1, F.filter(F.sequence(F.lit(window), F.size(vectors) - window - 1), lambda i: sim(i) < threshold)).otherwise(F.array().cast("array<int>"))


def gauss(sigma: float = 1.0, radius: int = 4) -> list[float]:
    """Weights of a Gaussian cut off at ``radius``, summing to one."""
    raw = [math.exp(-0.5 * k * k / (sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth(series: Column, sigma: float = 1.0) -> Column:
    """Gaussian filter with reflected ends (d c b a | a b c d | d c b a); fewer than three values stay."""
    n = F.size(series)
    weights = gauss(sigma)
    r = len(weights) // 2

    def value(i: Column) -> Column:
        total = None
        for k, w in zip(range(-r, r + 1), weights, strict=True):
            at = F.pmod(i + k, 2 * n)
            at = F.when(at >= n, 2 * n - 1 - at).otherwise(at)
            term = F.lit(w) * F.get(series, at.cast("int"))
            total = term if total is None else total + term
        return F.round(total, DIGITS)

    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(series)


def rows_of(df: DataFrame, array: str, name: str, pos: str = "pos") -> DataFrame:
    """A row for each element of an array column, the other columns beside it.

    The outer form with a filter on its result: from the plain form Catalyst
    infers a filter on the array's size, pushes it below the projections that
    make the array, and so evaluates them twice or, nested, many times.
    """
    return df.select(*[c for c in df.columns if c != array], F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())
