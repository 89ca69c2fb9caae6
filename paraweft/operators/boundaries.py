"""Boundaries from similarity series, votes of scales, structure and length; each document's in its own row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paraweft.config import DROP, SCALES, VOTES
from paraweft.functions import text as T, vectors as V

_NONE = "array<int>"


def _positions(series: Column) -> Column:
    return F.when(F.size(series) > 0, F.sequence(F.lit(0), F.size(series) - 1)).otherwise(F.array().cast(_NONE))


def is_valley(s: Column, i: Column) -> Column:
    """Lower than both neighbours."""
    return F.coalesce((i > 0) & (F.get(s, i) < F.get(s, i - 1)) & (F.get(s, i) < F.get(s, i + 1)), F.lit(False))


def is_drop(s: Column, i: Column) -> Column:
    """Lower than the value before by more than a set share of it."""
    before = F.get(s, i - 1)
    return F.coalesce((i > 0) & (before > 0) & (F.round((before - F.get(s, i)) / before, V.DIGITS) > DROP), F.lit(False))


def is_candidate(s: Column, i: Column, threshold: Column) -> Column:
    return is_valley(s, i) | is_drop(s, i) | ((threshold > 0) & (F.get(s, i) < threshold))


def candidates(series: Column, threshold: Column, min_distance: int = 1) -> Column:
    """Valleys, drops and values below the threshold, ascending; with a distance, greedily from the left."""
    found = F.filter(_positions(series), lambda i: is_candidate(series, i, threshold))
    if min_distance <= 1:
        return found
    far = lambda acc, i: F.when((F.size(acc) == 0) | (i - F.element_at(acc, -1) >= min_distance), F.concat(acc, F.array(i))).otherwise(acc)
    return F.aggregate(found, F.array().cast(_NONE), far)


def _by_type(text_type: Column, value) -> Column:
    out = None
    for name, row in VOTES.items():
        out = F.when(text_type == name, F.lit(value(row))) if out is None else out.when(text_type == name, F.lit(value(row)))
    return out.otherwise(F.lit(value(VOTES["unknown"])))


def vote(series: dict[int, Column], text_type: Column, shift: float = 0.0) -> Column:
    """Positions at which the scales' weighted strengths reach the type's score; ``shift`` moves all thresholds."""

    def score(i: Column) -> Column:
        total = F.lit(0.0)
        for k, scale in enumerate(SCALES):
            s = series[scale]
            weight, threshold = _by_type(text_type, lambda r, k=k: r[k][0]), _by_type(text_type, lambda r, k=k: r[k][1]) + F.lit(shift)
            total = total + F.when(is_candidate(s, i, threshold), weight * (1 - F.get(s, i))).otherwise(F.lit(0.0))
        return F.round(total, V.DIGITS)

    any_candidate = lambda i: is_candidate(series[1], i, _by_type(text_type, lambda r: r[0][1]) + shift) | is_candidate(series[3], i, _by_type(text_type, lambda r: r[1][1]) + shift) | is_candidate(series[5], i, _by_type(text_type, lambda r: r[2][1]) + shift)
    return F.filter(_positions(series[1]), lambda i: any_candidate(i) & (score(i) >= _by_type(text_type, lambda r: r[3])))


LIST_MARKS = r"^(?:[•\-*]|1\.|2\.|3\.|一、|二、|三、|（一）|（二）)"


def structure(sentences: Column) -> Column:
    """Sentences, but the first, that look like a title (short and with a mark, a colon at the end or up to five words) or a list item."""

    def hint(i: Column) -> Column:
        s = F.get(sentences, i)
        words = F.size(F.regexp_extract_all(s, F.lit(f"{T.NOT_WS}+"), F.lit(0)))
        title = (F.length(s) < 50) & (s.startswith("#") | s.endswith("：") | s.endswith(":") | (words <= 5))
        return title | F.trim(s).rlike(LIST_MARKS)

    return F.filter(_positions(sentences), lambda i: (i > 0) & hint(i))


def _sums(sentences: Column) -> Column:
    """Characters before each sentence, and in all."""
    return F.aggregate(sentences, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.length(s))))


def _length(sums: Column, start: Column, end: Column) -> Column:
    """Length of the sentences joined by single spaces."""
    return F.get(sums, end) - F.get(sums, start) + F.greatest(end - start - 1, F.lit(0))


def repair(sentences: Column, boundaries: Column, shortest: Column, longest: Column) -> Column:
    """Fold over boundaries: a paragraph that is too short goes on, unless short ones are allowed; one that is too long is also cut in the middle."""

    def run(sums: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            n = _length(sums, acc["start"], b)
            middle = F.when(b - acc["start"] > 2, F.array(acc["start"] + F.floor((b - acc["start"]) / 2).cast("int"), b)).otherwise(F.array(b))
            skip = (n < shortest) & (shortest > 50)
            out = F.when(skip, acc["out"]).when(n > longest, F.concat(acc["out"], middle)).otherwise(F.concat(acc["out"], F.array(b)))
            return F.struct(F.when(skip, acc["start"]).otherwise(b).alias("start"), out.alias("out"))

        return F.aggregate(boundaries, F.struct(F.lit(0).alias("start"), F.array().cast(_NONE).alias("out")), step, lambda a: a["out"])

    return F.get(F.transform(F.array(_sums(sentences)), run), F.lit(0))


def repair_by_lag(sentences: Column, boundaries: Column, shortest: Column, longest: Column) -> Column:
    """The other rule: every paragraph starts at the boundary before, kept or not; too short ones lose theirs."""

    def run(sums: Column) -> Column:
        def each(b: Column, k: Column) -> Column:
            start = F.coalesce(F.get(boundaries, k - 1), F.lit(0))
            n = _length(sums, start, b)
            middle = F.when(b - start > 2, F.array(start + F.floor((b - start) / 2).cast("int"), b)).otherwise(F.array(b))
            return F.when(n < shortest, F.array().cast(_NONE)).when(n > longest, middle).otherwise(F.array(b))

        return F.flatten(F.transform(boundaries, each))

    return F.get(F.transform(F.array(_sums(sentences)), run), F.lit(0))


def blended(boundary: Column, similarity: Column, alpha: float = 0.3) -> Column:
    """Boundary scores mixed with what similarities lack to one."""
    return F.zip_with(boundary, similarity, lambda b, s: alpha * b + (1 - alpha) * (1 - s))


def by_scores(boundary: Column, consistency: Column, above: float, below: float) -> Column:
    """i + 1 for each gap i whose boundary score is above and whose consistency is below a limit."""

    def hits(both: Column) -> Column:
        found = F.filter(_positions(both["b"]), lambda i: (F.get(both["b"], i) > above) & (F.get(both["c"], i) < below))
        return F.transform(found, lambda i: i + 1)

    return V.let(F.struct(boundary.alias("b"), consistency.alias("c")), hits)
