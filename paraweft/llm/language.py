"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from paraweft.llm import words as W

#: Labelled documents, and characters, that a language is learned from at most, in the order of a hash of their ids; one document at least.
PER_LANGUAGE, CHARACTERS = 300, 2_000_000
#: Words that are scored side by side. What is known at the end of so many words goes on to the next.
CHAIN = 32
#: Times that a word must stand in the sample, and share of them in one language, to be in the lexicon.
TIMES, SHARE = 3, 0.8
#: Weights in all are at most 2**WEIGHT_BITS, whatever the number of languages.
WEIGHT_BITS = 21
ROUNDS = 40

_STOP = np.ones(256, bool)
_STOP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each place of each chain (-1 beyond its end) for words given by their row."""
    if not len(row):
        return np.zeros((0, CHAIN), np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(first, len(row)))
    count = -(-size // CHAIN)
    begin = np.repeat(first, count) + CHAIN * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    end = np.repeat(first + size, count)
    at = begin[:, None] + np.arange(CHAIN)
    return np.where(at < end[:, None], at, -1), row[begin]


def code_points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text's code points, and where runs of bytes begin and end among them."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, upto[begin], upto[end]


def word_features(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray], mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words, one word after another, and where each word's begin.

    The word itself, what the lexicon says of it, its first and last 1 to 3
    characters, and its character pairs and triples, in which its ends count as characters.
    """
    points, begin, end = code_points(data, begin, end)
    n, size, last = len(begin), end - begin, len(points) - 1
    keys, says = lexicon
    place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
    known = np.where(keys[place] == hashes, says[place] + 1, 0) if len(keys) else np.zeros(n, np.int64)
    fixed = [hashes, W.mix(known.astype(np.uint64) + np.uint64(1 << 50))]
    wide = points.astype(np.uint64)
    for k in (1, 2, 3):
        for side in (0, 1):
            key = np.full(n, 2 * k + side, np.uint64)
            for i in range(k):
                key = W.mix(key ^ (wide[np.clip(begin + i if side == 0 else end - 1 - i, 0, last)] + np.uint64(1 << 40)))
            fixed.append(np.where(size >= k, key, np.uint64(0)))
    count = len(fixed) + (size + 1) + size
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(starts[-1], np.int64)
    for i, key in enumerate(fixed):
        out[starts[:-1] + i] = (key & np.uint64(mask)).astype(np.int64)

    def at(first: np.ndarray, inner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Characters at places of words, 1 beyond their ends."""
        inside = (inner >= 0) & (inner < sizes)
        return np.where(inside, wide[np.clip(first + inner, 0, last)], np.uint64(1))

    for k, per in ((2, size + 1), (3, size)):
        inner = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        first, sizes = np.repeat(begin, per), np.repeat(size, per)
        key = np.full(len(inner), k, np.uint64)
        for i in range(k):
            key = W.mix(key + (at(first, inner + i - 1, sizes) << np.uint64(3)))
        base = starts[:-1] + len(fixed) + (0 if k == 2 else size + 1)
        out[np.repeat(base, per) + inner] = (key & np.uint64(mask)).astype(np.int64)
    return out, starts


class Model:
    """Weights of features by language, of transitions and of a chain's first label."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        n = max(1, len(languages))
        self.mask = (1 << max(8, WEIGHT_BITS - int(np.ceil(np.log2(n))))) - 1
        self.weights = np.zeros((self.mask + 1, n), np.float32)
        self.moves, self.first = np.zeros((n, n)), np.zeros(n)
        #: hashes of the words that stand nearly only in one language's sample, and that language
        self.lexicon = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def emissions(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros((0, self.weights.shape[1]), np.float32)
        return np.add.reduceat(self.weights[features], starts[:-1], axis=0)

    def marginals(self, e: np.ndarray, at: np.ndarray, pairs: bool = False, start: np.ndarray | None = None, end: np.ndarray | None = None):
        """Posterior of each label at each place of each chain, by the forward and backward recursions.

        ``e`` are the scores of words, ``at`` the chains; ``start`` and ``end`` are
        what is known of each chain's labels from the words before and after it.
        Every step is scaled to sum to one. With ``pairs``, also the expected
        transitions and the log-likelihood's normaliser.
        """
        n, steps = at.shape
        real = at >= 0
        x = e[np.maximum(at, 0)].astype(np.float64)
        top = x.max(2, keepdims=True)
        x = np.exp(x - top)
        x[~real] = 1.0
        move = np.exp(self.moves)
        alpha, scale = np.empty_like(x), np.empty((n, steps))
        a = x[:, 0] * (np.exp(self.first) if start is None else start)
        for t in range(steps):
            if t:
                a = np.where(real[:, t, None], (a @ move) * x[:, t], a)
            s = a.sum(1)
            scale[:, t] = s
            a = a / s[:, None]
            alpha[:, t] = a
        beta, expected = np.ones((n, x.shape[2])) if end is None else end, np.zeros_like(move)
        gamma = np.empty_like(x)
        gamma[:, -1] = alpha[:, -1] * beta / (alpha[:, -1] * beta).sum(1, keepdims=True)
        for t in range(steps - 2, -1, -1):
            onward = beta * x[:, t + 1]
            if pairs:
                live = real[:, t + 1]
                p = alpha[live, t][:, :, None] * move * onward[live][:, None, :]
                expected += (p / p.sum((1, 2), keepdims=True)).sum(0)
            b = onward @ move.T
            beta = np.where(real[:, t + 1, None], b / b.sum(1, keepdims=True), beta)
            g = alpha[:, t] * beta
            gamma[:, t] = g / g.sum(1, keepdims=True)
        if pairs:
            return gamma, expected, float((np.log(scale) * real).sum() + (top[..., 0] * real).sum())
        return gamma

    def through(self, e: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each chain of a text learns from the chains before and after it; ``first`` marks the first chain of each text.

        A chain acts on the labels as a product of matrices, which is made for all
        chains at once; only these products are then gone through one after another.
        """
        n, k = len(at), self.weights.shape[1]
        move = np.exp(self.moves)
        x = e[np.maximum(at, 0)].astype(np.float64)
        x = np.exp(x - x.max(2, keepdims=True))
        product = x[:, 0, :, None] * np.eye(k)
        for t in range(1, at.shape[1]):
            step = (product @ move) * x[:, t, None, :]
            product = np.where((at[:, t] >= 0)[:, None, None], step / step.sum((1, 2), keepdims=True), product)
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, n))
        start, end = np.tile(np.exp(self.first), (n, 1)), np.ones((n, k))
        for j in range(1, int(sizes.max(initial=0))):
            c = heads[sizes > j] + j
            s = np.einsum("nk,nkl->nl", start[c - 1], product[c - 1]) @ move
            start[c] = s / s.sum(1, keepdims=True)
        lasts = heads + sizes - 1
        for j in range(1, int(sizes.max(initial=0))):
            c = lasts[sizes > j] - j
            s = np.einsum("nkl,nl->nk", product[c + 1], end[c + 1]) @ move.T
            end[c] = s / s.sum(1, keepdims=True)
        return start, end

    def fit(self, texts: list[str], labels: list[int], seed: int = 7) -> Model:
        """Maximise the penalised likelihood of the labels of all words by Adam over all chains.

        A word's label is its text's. The sample is learned from in chains of
        ``CHAIN`` words. As such chains never switch, each third chain is completed, from a random place on, by words of another chain of
        another language: the transitions are learned from code-switched chains.
        """
        data, offsets = W.strings(pa.array(texts, pa.string()))
        begin, end, row = W.spans(data, offsets, _STOP)
        hashes = W.hashes(data, begin, end)
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, of = chains(row)
        if not len(at):
            return self
        label_of = np.asarray(labels)
        seen = np.bincount(back * self.weights.shape[1] + label_of[row], minlength=len(first) * self.weights.shape[1]).reshape(len(first), -1)
        sure = (seen.max(1) >= SHARE * seen.sum(1)) & (seen.sum(1) >= TIMES)
        keys = hashes[first]  # ascending, as np.unique gives them
        self.lexicon = keys[sure], seen.argmax(1)[sure]
        features, starts = word_features(data, begin[first], end[first], keys, self.lexicon, self.mask)
        rng = np.random.default_rng(seed)
        words = np.where(at >= 0, back[np.maximum(at, 0)], -1)
        gold = np.repeat(label_of[of][:, None], CHAIN, axis=1)
        other = rng.permutation(len(words))
        place = rng.integers(1, CHAIN, len(words))
        switch = (rng.random(len(words)) < 1 / 3) & (gold[:, 0] != gold[other, 0])
        swap = switch[:, None] & (np.arange(CHAIN) >= place[:, None]) & (words >= 0) & (words[other] >= 0)
        gold, words = np.where(swap, gold[other], gold), np.where(swap, words[other], words)
        real = words >= 0
        n, u = self.weights.shape[1], len(first)
        counts = np.stack([np.bincount(words[real & (gold == k)], minlength=u) for k in range(n)], 1).astype(float)
        both = real[:, 1:] & real[:, :-1]
        gold_moves = np.bincount(gold[:, :-1][both] * n + gold[:, 1:][both], minlength=n * n).reshape(n, n)
        gold_first = np.bincount(gold[:, 0], minlength=n)
        total, per_word = real.sum(), np.diff(starts)
        params = [self.weights.astype(np.float64), self.moves, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, ROUNDS + 1):
            e = self.emissions(features, starts)
            gamma, expected, _ = self.marginals(e, words, pairs=True)
            g = counts.copy()
            flat = words[real]
            for k in range(n):
                g[:, k] -= np.bincount(flat, gamma[..., k][real], minlength=u)
            gw = np.stack([np.bincount(features, np.repeat(g[:, k], per_word), minlength=self.mask + 1) for k in range(n)], 1)
            grads = [gw - 0.05 * params[0], gold_moves - expected - 0.05 * params[1], gold_first - gamma[:, 0].sum(0) - 0.05 * params[2]]
            for i, grad in enumerate(grads):
                grad = grad / total
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.98 * v[i] + 0.02 * grad * grad
                params[i] += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.98**step)) + 1e-9)
            self.weights, self.moves, self.first = params[0].astype(np.float32), params[1], params[2]
        return self

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Words of texts (begin, end, row) and the posterior of each language for each word."""
        begin, end, row = W.spans(data, offsets, _STOP)
        if not len(begin):
            return begin, end, row, np.zeros((0, self.weights.shape[1]))
        hashes = W.hashes(data, begin, end)
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        e = self.emissions(*word_features(data, begin[first], end[first], hashes[first], self.lexicon, self.mask))
        at, of = chains(row)
        words = np.where(at >= 0, back[np.maximum(at, 0)], -1)
        start, stop = self.through(e, words, np.append(True, of[1:] != of[:-1]))
        gamma = np.empty((len(begin), e.shape[1]))
        real = at >= 0
        gamma[at[real]] = self.marginals(e, words, start=start, end=stop)[real]
        return begin, end, row, gamma


def _letters(column: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: runs of ASCII letters do; characters beyond ASCII are looked at."""
    out = counts > 0
    for r in np.flatnonzero(out):
        text = column[int(r)].as_py()
        out[r] = any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text)
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = W.strings(batch.column(1))
            for i, j in W.blocks(offsets):
                _, _, row, gamma = model.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts = np.bincount(row, minlength=j - i)
                share = np.stack([np.bincount(row, gamma[:, k], minlength=j - i) for k in range(gamma.shape[1])], 1) / np.maximum(counts, 1)[:, None]
                best = share.argmax(1)
                known = _letters(batch.column(1).slice(i, j - i), counts) & bool(model.languages)
                names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.clip(np.where(known, share[np.arange(j - i), best], 0.0), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(counts, pa.int64())], names=["id", "lang_pred", "score", "n_words"])

    return run


def _runs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = W.strings(batch.column(1))
            for i, j in W.blocks(offsets):
                d = data[offsets[i] : offsets[j]]
                begin, end, row, gamma = model.words(d, offsets[i : j + 1] - offsets[i])
                if not len(begin) or not model.languages:
                    continue
                label = gamma.argmax(1)
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])]))
                stop = np.append(new[1:], len(row)) - 1
                sure = np.add.reduceat(gamma[np.arange(len(row)), label], new) / (stop - new + 1)
                texts = [d[begin[a] : end[b]].tobytes().decode() for a, b in zip(new, stop, strict=True)]
                nth = np.arange(len(new)) - np.searchsorted(row[new], row[new])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row[new])), pa.array(nth, pa.int64()), pa.array([model.languages[k] for k in label[new]], pa.string()), pa.array(stop - new + 1, pa.int64()), pa.array(texts, pa.string()), pa.array(sure)], names=["id", "run", "lang", "n_words", "text", "score"])

    return run


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most ``PER_LANGUAGE`` documents and ``CHARACTERS`` characters of each non-null language among those for which ``learn`` holds.

    The sample is fixed by a hash of the ids: languages are counted over all
    documents, then each is thinned by hash to about twice the bound, and the
    first by hash, whole texts up to both bounds, come to the driver. So does a
    row for each language, of which there are as many as the model has labels.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang"), learn.alias("learn")).where("learn and lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    bound = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * PER_LANGUAGE / n + 50 / n) * (1 << 31)))]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy("draw", "id", "text")
    sample = rows.withColumn("draw", draw).where(F.col("draw") < bound).withColumns({"nth": F.row_number().over(order), "before": F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    sample = sample.where((F.col("nth") <= PER_LANGUAGE) & (F.col("before") < CHARACTERS))
    got = sorted((r.lang, r.nth, r.text) for r in sample.select("lang", "nth", "text").collect())
    languages = sorted(counts, key=lambda s: [ord(c) for c in s])
    return Model(languages).fit([t for _, _, t in got], [languages.index(lang) for lang, _, _ in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, n_words)``: the language with the largest mean posterior over all words of the text.

    Words are runs of letters of the lower-cased text; a word's posterior comes
    from all words of its text by forward-backward. ``score`` is that mean, 0 to
    1; of languages that are equal, the first by code point is named. Null texts
    and texts without a letter are ``und`` with score 0, as is everything if no
    language was learned. Nothing but the text is read; rows aren't shuffled, and
    rows that repeat give repeated results. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    out = rows.mapInArrow(_predict(shared), f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, n_words long")
    return out.withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, run, lang, n_words, text, score)``: the runs of words of one language in each (code-switched) text, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    out = rows.mapInArrow(_runs(shared), f"id {docs.schema[id_col].dataType.simpleString()}, run long, lang string, n_words long, text string, score double")
    return out.withColumnRenamed("id", id_col)
