"""Quality by hierarchical empirical Bayes: a document classifier's evidence under the priors of its host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from paraweft.llm import words as W
from paraweft.llm.spread import spread_join
from paraweft.scratch import Scratch

#: Labelled documents the classifier is fitted on at most, in the order of a hash of their ids.
TRAIN = 4_000
#: Sites (hosts or paths) up to which their posteriors are broadcast; beyond it they are joined by shuffle.
BROADCAST_SITES = 200_000
#: Bounds of a prior's weight in documents.
WEAKEST, STRONGEST = 4.0, 1e4
REJECT_BELOW = 0.3
#: Words and word pairs are counted in so many bins.
BINS = 1 << 15
#: Standard errors from which a bin's ratio counts.
SURE = 3.0

FEATURES = ["symbols", "capitals", "digits", "spaces", "word_length", "distinct_words", "repeated_word", "distinct_pairs", "symbol_tails", "distinct_lines", "log_words", "some"]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values among those of each row, told apart by 40 bits of their hashes."""
    key = W.distinct((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=rows).astype(float)


def features(data: np.ndarray, offsets: np.ndarray, words: tuple) -> np.ndarray:
    """One row of ``FEATURES`` for each text, given with its words: shares between 0 and 1, besides lengths."""
    rows = len(offsets) - 1
    n = np.diff(offsets).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return (upto[offsets[1:]] - upto[offsets[:-1]]).astype(float)

    letter, space = _LETTER[data], W.SPACE[data]
    letters, capitals, digits, spaces = total(letter), total(_CAPITAL[data]), total(_DIGIT[data]), total(space)
    h, row, begin, end = words
    words = np.bincount(row, minlength=rows).astype(float)
    pairs, first = W.ngrams(h, row, 2)
    same = h[first] == h[np.minimum(first + 1, len(h) - 1)] if len(first) else np.zeros(0, bool)
    tail = np.zeros(len(begin), bool)
    if len(begin):  # the last two bytes of a longer word are neither letters nor digits
        plain = letter | _DIGIT[data]
        tail = (end - begin > 1) & ~plain[end - 1] & ~plain[np.maximum(end - 2, 0)]
    line_begin, line_end, line_row = W.spans(data, offsets, _LINE)
    lines = np.bincount(line_row, minlength=rows).astype(float)

    def share(a: np.ndarray, b: np.ndarray, empty: float = 0.0) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), empty)

    return np.stack(
        [
            share(n - letters - digits - spaces, n),
            share(capitals, letters),
            share(digits, n),
            share(spaces, n),
            np.minimum(share(n - spaces, words), 40) / 10,
            share(_distinct(h, row, rows), words, 1.0),
            share(np.bincount(row[first][same], minlength=rows).astype(float), np.maximum(words - 1, 0)),
            share(_distinct(pairs, row[first], rows), np.maximum(words - 1, 0), 1.0),
            share(np.bincount(row[tail], minlength=rows).astype(float), words),
            share(_distinct(W.hashes(data, line_begin, line_end), line_row, rows), lines, 1.0),
            np.log1p(words) / 5,
            (words > 0).astype(float),
        ],
        axis=1,
    )


def grams(rows: int, words: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of each text's words and word pairs in one array, and where each text's begin and the last's end."""
    h, row, _, _ = words
    pairs, first = W.ngrams(h, row, 2)
    code = W.distinct(np.concatenate([row * BINS + (h % BINS).astype(np.int64), row[first] * BINS + (pairs % BINS).astype(np.int64)]))
    return code % BINS, np.searchsorted(code, np.arange(rows + 1) * BINS)


def ratios(bins: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log ratio of each bin's smoothed document frequency among good and bad texts.

    0 where it lies within ``SURE`` standard errors of 0, and everywhere if there are no texts of a kind.
    """
    good = np.repeat(y > 0.5, np.diff(starts))
    n = np.array([(y <= 0.5).sum(), (y > 0.5).sum()])
    if not n.all():
        return np.zeros(BINS)
    g, b = np.bincount(bins[good], minlength=BINS) + 1, np.bincount(bins[~good], minlength=BINS) + 1
    ratio = np.log(g / (n[1] + 2)) - np.log(b / (n[0] + 2))
    return np.where(np.abs(ratio) > SURE * np.sqrt(1 / g + 1 / b), ratio, 0)


def content(ratio: np.ndarray, bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the ratios of each text's bins, at most 10 either way, in tenths of that; 0 for a text without words."""
    upto = np.concatenate([[0], np.cumsum(ratio[bins])])
    return np.clip(upto[starts[1:]] - upto[starts[:-1]], -10, 10) / 10


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and an intercept: shares that are odd at either end are told apart."""
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a penalised logistic regression over :func:`expand`, by Newton steps; the intercept isn't penalised."""
    z = expand(x)
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    if not len(y):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """A document classifier: the shape of a text, and its words and word pairs by their log ratios as one more feature."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray):
        self.ratio, self.weights = ratio, weights

    def odds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of good quality by the text alone."""
        words = W.words(data, offsets)
        x = np.concatenate([features(data, offsets, words), content(self.ratio, *grams(len(offsets) - 1, words))[:, None]], axis=1)
        return np.clip(expand(x) @ self.weights, -12, 12)


def learn(x: np.ndarray, bins: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Model:
    """The model of texts given by their shape, their bins and their labels.

    A text's own label must not reach it through the ratios, so for the fit each
    half of the texts, in turn, has the ratios of the other one.
    """
    own = np.zeros(len(y))
    half = np.arange(len(y)) % 2 == 0
    for side in (half, ~half):
        mine, others = np.repeat(side, np.diff(starts)), ~np.repeat(side, np.diff(starts))
        sizes = np.diff(starts)
        ratio = ratios(bins[others], np.concatenate([[0], np.cumsum(sizes[~side])]), y[~side])
        own[side] = content(ratio, bins[mine], np.concatenate([[0], np.cumsum(sizes[side])]))
    return Model(ratios(bins, starts, y), fit(np.concatenate([x, own[:, None]], axis=1), y))


def _scored(shared, column: int):
    """Arrow function: puts the log odds by the text alone in place of the first of the appended columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = W.strings(batch.column(column))
            odds = [np.zeros(0)]
            for i, j in W.blocks(offsets):
                odds.append(model.odds(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            rest = batch.drop_columns([batch.schema.names[column]])
            yield rest.append_column("\x01odds", pa.array(np.concatenate(odds)))

    return run


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to the text's shape and bins."""
    for batch in batches:
        data, offsets = W.strings(batch.column(2))
        for i, j in W.blocks(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            words = W.words(d, o)
            bins, starts = grams(j - i, words)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(bins.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(list(features(d, o, words)), pa.list_(pa.float64())), lists], names=["id", "y", "x", "bins"])


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """A model from at most ``TRAIN`` labelled ids, one text each; only their shape and bins come to the driver.

    Ids are taken in the order of their hash, with the mean of their labels
    rounded (a tie is good), and of the rows of an id that repeats the least text.
    """
    known = labels.select(F.col(id_col).alias("\x01id"), F.col(label_col).cast("double").alias("y")).where("y in (0, 1) and `\x01id` is not null")
    known = known.groupBy("\x01id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    texts = docs.select(F.col(id_col).alias("\x01id"), F.col(text_col).cast("string").alias("text"))
    # labels of ids that have no document would fill the sample with nothing
    here = known.join(texts.select("\x01id"), "\x01id", "left_semi").orderBy(F.xxhash64("\x01id"), "\x01id").limit(TRAIN)
    chosen = texts.join(F.broadcast(here), "\x01id").groupBy("\x01id", "y").agg(F.min("text").alias("text"))
    id_type = chosen.schema["\x01id"].dataType.simpleString()
    got = chosen.mapInArrow(_described, f"id {id_type}, y double, x array<double>, bins array<int>").orderBy(F.xxhash64("id"), "id").toArrow()
    y, rows = got.column("y").to_numpy(), got.num_rows
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, len(FEATURES))
    lists = got.column("bins").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False) if rows else np.zeros(0, np.int64)
    return learn(x, lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), y)


def _strength(sites: DataFrame, mean: Column, n: str, s: str, q: str) -> float:
    """Weight of the prior, in documents, from how far sites' means lie apart beyond what chance makes of them (method of moments)."""
    got = sites.where(F.col(n) > 1).agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2)).alias("between"), F.sum((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)).alias("chance"), F.sum(n).alias("n"), F.sum(F.col(n) * mean * (1 - mean)).alias("spread")).first()
    if not got.n:
        return STRONGEST
    beyond = (got.between - got.chance) / got.n
    return STRONGEST if beyond <= 0 else float(np.clip(got.spread / got.n / beyond - 1, WEAKEST, STRONGEST))


def url_levels(url: Column, depth: int = 3) -> list[Column]:
    """Host of a URL (lower case, without user, port and ``www.``) and its first ``depth`` - 1 levels of path, as sites for :func:`classify`."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return [host, *[F.regexp_extract(path, rf"^((?:/[^/]+){{{k}}})/", 1) for k in range(1, depth)]]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sites: list[Column] | None = None, label_col: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """Posterior probability that each document is good, and ``kept``: whether it reaches ``REJECT_BELOW``.

    1. A logistic regression on shape, words and word pairs of whole texts is
       fitted to at most ``TRAIN`` labelled documents (``label_col`` 0 or 1; others,
       and null ids, are not used). Its probability is a document's own evidence.
    2. Over all documents, grouped sums of that probability give each site of each
       level of ``sites`` (host, then levels of path; see :func:`url_levels`) its
       mean. Hosts are shrunk toward the global mean and every level below toward
       the one above it, by as many documents' weight as the sums' variance beyond
       chance supports (empirical Bayes); a site with few documents is thus near its
       parent. A document's own share is left out of its sites.
    3. The lowest site's posterior replaces the global mean as the prior in the document's odds.

    Texts go through Python once; their odds are written beside ``columns`` and
    read again. Returns ``columns`` (all, if none are named) and ``evidence``,
    ``site_prior``, ``score``, ``kept``; columns of the input with these names are
    replaced. Without ``sites`` there is one site for all; null is a site of its own.
    Null and empty texts have no words, a shape that is judged like any other.
    Without labels of both kinds everything is as likely as the labels (0.5
    without any). Rows that repeat count as often as they come. Empty tables give empty results.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    added = ["evidence", "site_prior", "score", "kept"]
    columns = [c for c in columns or docs.columns if c not in added]
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    levels = [f"\x01site{k}" for k in range(len(sites or []) or 1)]
    named = [F.coalesce(F.concat(F.lit("s"), c.cast("string")), F.lit("n")).alias(k) for c, k in zip(sites or [F.lit("")], levels, strict=True)]
    kept = docs.select(*[docs[c] for c in columns], *named, docs[text_col].cast("string").alias("\x01text"))
    schema = kept.drop("\x01text").schema.add("\x01odds", "double")
    p = F.col("\x01p")
    rows = scratch.write(kept.mapInArrow(_scored(model, len(kept.columns) - 1), schema), "odds").withColumn("\x01p", 1 / (1 + F.exp(-F.col("\x01odds"))))

    depth = len(levels)
    lowest = scratch.write(rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), "lowest")
    overall = lowest.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max((overall.s or 0.0) / overall.n, 1e-6), 1 - 1e-6) if overall.n else 0.5
    table, above, weights = lowest.select(*levels), F.lit(mean), []
    for k in range(depth):
        here = lowest.groupBy(*levels[: k + 1]).agg(F.sum("n").alias(f"\x01n{k}"), F.sum("s").alias(f"\x01s{k}"), F.sum("q").alias("q"))
        # the level above is joined once a site, not once a document
        parents = here if not k else here.join(table.select(*levels[:k], "\x01mean").distinct(), levels[:k])
        weights.append(_strength(parents, above, f"\x01n{k}", f"\x01s{k}", "q"))
        own = (F.col(f"\x01s{k}") + weights[k] * above) / (F.col(f"\x01n{k}") + weights[k])
        here = parents.withColumn("\x01own", own).select(*levels[: k + 1], f"\x01n{k}", f"\x01s{k}", "\x01own")
        table = scratch.write(table.drop("\x01mean").join(here, levels[: k + 1]).withColumnRenamed("\x01own", "\x01mean"), f"sites-{k}")
        above = F.col("\x01mean")
    table = table.drop("\x01mean")
    out = rows.join(F.broadcast(table), levels) if table.count() <= BROADCAST_SITES else spread_join(rows, table, levels, scratch, "sites")
    prior = F.lit(mean)
    for k in range(depth):
        prior = (F.col(f"\x01s{k}") - p + weights[k] * prior) / (F.col(f"\x01n{k}") - 1 + weights[k])
    prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("\x01odds") + F.ln(F.col("site_prior") / (1 - F.col("site_prior"))) - F.lit(float(np.log(mean / (1 - mean))))
    out = out.withColumns({"evidence": p, "site_prior": prior}).withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("score") >= REJECT_BELOW)
    return out.select(*columns, *added)
