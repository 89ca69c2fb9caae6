"""How consistent a segmentation is: similarities within and between paragraphs, words, topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paraweft.functions import vectors as V
from paraweft.operators.segment import Encoder, average, clamp, hashed_encoder
from paraweft.operators.terms import blocks, term_name

#: Words of no weight.
STOP_WORDS = frozenset("的 了 在 是 我 有 和 就 不 人 都 一 the a an of to and in is it that".split())


def pair_similarities(vectors: Column) -> Column:
    """Cosines of all pairs i < j of a document's paragraphs: array of struct(i, j, sim). Grows with the square of one document's paragraphs."""
    return V.let(vectors, _pairs)


def _pairs(vectors: Column) -> Column:
    n = F.size(vectors)
    pairs = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    return F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), V.cosine(F.get(vectors, p["i"]), F.get(vectors, p["j"])).alias("sim")))


def mean_cosine(vectors: Column) -> Column:
    """Mean cosine of all pairs of unit (or zero) vectors, from their sum: linear in their number. 1 for up to one vector."""

    def of(vs: Column) -> Column:
        n = F.size(vs)
        total = F.aggregate(F.slice(vs, F.lit(2), n), F.element_at(vs, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
        own = F.aggregate(vs, F.lit(0.0), lambda s, v: s + V.dot(v, v))
        return F.when(n > 1, V.let(total, lambda t: (V.dot(t, t) - own) / (n * (n - 1)))).otherwise(F.lit(1.0))

    return V.let(vectors, of)


def internal_consistency(sentence_vectors: Column) -> Column:
    """Mean pairwise cosine of a paragraph's sentences, given as unit vectors; 1 for up to one sentence."""
    return mean_cosine(sentence_vectors)


def terms(text: Column) -> Column:
    """Words of two or more letters or digits, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*sorted(STOP_WORDS)))


def grams(words: Column, n: int) -> Column:
    """The words and, for n = 2, each with the one after it."""
    if n == 1:
        return words
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return V.let(words, lambda w: F.concat(w, pairs(w)))


def tfidf(paragraphs: DataFrame, id_col: str = "doc_id", most: float = 0.9, n: int = 2, features: int = 1000) -> DataFrame:
    """``(id, para, term, weight)``: each paragraph's unit vector of term frequency times smoothed inverse frequency over its document's paragraphs.

    Input rows are (id, para, text). Terms are words and pairs of words. Those in
    more than the share ``most`` of a document's paragraphs fall away, and of the
    others the ``features`` most frequent in the document stay, ties by name.
    """
    tf = paragraphs.select(id_col, "para", F.explode(grams(terms(F.col("text")), n)).alias("term")).groupBy(id_col, "para", "term").agg(F.count(F.lit(1)).alias("tf"))
    sizes = paragraphs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    by_term = tf.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all")).join(sizes, id_col).where(F.col("df") <= most * F.col("n"))
    order = Window.partitionBy(id_col).orderBy(F.desc("all"), "term")
    kept = by_term.withColumn("place", F.row_number().over(order)).where(F.col("place") <= features).select(id_col, "term", "df", "n")
    raw = tf.join(kept, [id_col, "term"]).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col, "para")))
    return raw.select(id_col, "para", "term", F.round(F.col("w") / norm, 9).alias("weight"))


def lexical_similarity(weights: DataFrame, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """``(id, i, j, sim)`` of paragraph pairs i < j of a document that share a term."""
    a = weights.select(id_col, F.col("para").alias("i"), "term", F.col("weight").alias("wa"))
    b = weights.select(id_col, F.col("para").alias("j"), "term", F.col("weight").alias("wb"))
    return a.join(b, [id_col, "term"]).where("i < j").groupBy(id_col, "i", "j").agg(F.round(F.sum(F.col("wa") * F.col("wb")), digits).alias("sim"))


def top_terms(paragraphs: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """``(id, para, words)``: the ``k`` terms of each paragraph with the most occurrences, ties by name."""
    tf = paragraphs.select(id_col, "para", F.explode(terms(F.col("text"))).alias("term")).groupBy(id_col, "para", "term").agg(F.count(F.lit(1)).alias("tf"))
    order = Window.partitionBy(id_col, "para").orderBy(F.desc("tf"), "term")
    best = tf.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.groupBy(id_col, "para").agg(F.array_sort(F.collect_list("term")).alias("words"))


def keyword_overlap(paragraphs: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """``(id, para, overlap)``: Jaccard of the top terms of each paragraph and the next."""
    rows = paragraphs.select(id_col, "para").join(top_terms(paragraphs, k, id_col), [id_col, "para"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    nxt = F.lead("words").over(Window.partitionBy(id_col).orderBy("para"))
    union = F.size(F.array_union("words", "after"))
    return rows.withColumn("after", nxt).where(F.col("after").isNotNull()).select(id_col, "para", F.round(F.when(union > 0, F.size(F.array_intersect("words", "after")) / union).otherwise(F.lit(0.0)), 9).alias("overlap"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence of two distributions, with a floor so that no logarithm is of zero."""
    eps = 1e-10

    def kl(a: Column, m: Column) -> Column:
        return F.aggregate(F.zip_with(a, m, lambda x, y: (x + eps) * F.ln((x + eps) / (y + eps))), F.lit(0.0), lambda s, x: s + x)

    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return 0.5 * kl(p, m) + 0.5 * kl(q, m)


def topic_scores(topics: Column) -> Column:
    """struct(coherence, smoothness, boundaries) of an array of topic distributions in order.

    Mean cosine of neighbours; mean exp(-JS) of neighbours; i + 1 where the cosine is below 0.3.
    """
    return V.let(topics, _topic_scores)


def _topic_scores(topics: Column) -> Column:
    n = F.size(topics)
    gaps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    sims = F.transform(gaps, lambda i: V.cosine(F.get(topics, i), F.get(topics, i + 1)))
    smooth = F.transform(gaps, lambda i: F.exp(-jensen_shannon(F.get(topics, i), F.get(topics, i + 1))))
    cuts = F.transform(F.filter(gaps, lambda i: F.get(sims, i) < 0.3), lambda i: i + 1)
    one = n <= 1
    return F.struct(F.when(one, 1.0).otherwise(average(sims)).alias("coherence"), F.when(one, 1.0).otherwise(average(smooth)).alias("smoothness"), cuts.alias("boundaries"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, for positive numbers."""
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1 / x
        x = x + 1
    y = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def fit_topics(weights: np.ndarray, k: int, iterations: int = 100, seed: int = 42, inner: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Batch variational Bayes of a topic model: each row's topics, and each topic's words, both as shares."""
    rng = np.random.default_rng(seed)
    n, m = weights.shape
    words = rng.gamma(100.0, 0.01, (k, m))
    for step in range(iterations + 1):
        beta = np.exp(digamma(words) - digamma(words.sum(1, keepdims=True)))
        gamma = np.ones((n, k))
        for _ in range(inner):
            theta = np.exp(digamma(gamma) - digamma(gamma.sum(1, keepdims=True)))
            new = 1 / k + theta * ((weights / (theta @ beta + 1e-100)) @ beta.T)
            moved, gamma = np.abs(new - gamma).mean(), new
            if moved < 1e-3:
                break
        if step == iterations:
            break
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(1, keepdims=True)))
        words = 1 / k + beta * (theta.T @ (weights / (theta @ beta + 1e-100)))
    return gamma / gamma.sum(1, keepdims=True), words / words.sum(1, keepdims=True)


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(:func:`digamma`), its six first terms as one fraction."""
    y, z = x * (x + 5), x + 6
    u = 1 / (z * z)
    return z * np.exp(-(2 * x + 5) * (3 * y * y + 20 * y + 24) / (y * (y + 4) * (y + 6)) - 0.5 / z - u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u / 240))))


#: A step that moves no word by more than this share has come to where each later step would stay: what is left is rounding.
SETTLED = 1e-14


def fit_many(docs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], k: int, iterations: int = 100, seed: int = 42, inner: int = 100) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`fit_topics` of each document, all steps made for many at once and on the weights that aren't zero.

    A document is (rows, columns, row, column and weight of each weight, by row).
    One whose topics have settled leaves the inner steps, as if it had been fitted
    alone. A step starts from the words alone, so one that leaves them as they are
    is the same as all after it, and the document is done.
    """
    ns, ms = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
    first_row, first_col = np.append(0, np.cumsum(ns)), np.append(0, np.cumsum(ms))
    row = np.concatenate([d[2] + a for d, a in zip(docs, first_row, strict=False)])
    col = np.concatenate([d[3] + a for d, a in zip(docs, first_col, strict=False)])
    weight = np.concatenate([d[4] for d in docs])
    start = np.random.default_rng(seed)
    state = start.bit_generator.state
    words = []
    for m in ms.tolist():
        start.bit_generator.state = state
        words.append(start.gamma(100.0, 0.01, (k, m)))
    words = np.concatenate(words, 1)
    out: list = [None] * len(docs)
    which = np.arange(len(docs))
    for step in range(iterations + 1):
        beta = exp_digamma(words) / np.repeat(exp_digamma(np.add.reduceat(words, first_col[:-1], axis=1)), ms, axis=1)
        at = beta[:, col]
        gamma = _shares(ns, row, weight, at, k, inner)
        done = np.full(len(ns), step == iterations)
        if step < iterations:
            theta = exp_digamma(gamma)
            parts = [np.take(theta[t], row) * at[t] for t in range(k)]
            ratio = weight / sum(parts[1:], parts[0])
            moved = 1 / k + np.stack([np.bincount(col, x * ratio, first_col[-1]) for x in parts])
            change = np.maximum.reduceat((np.abs(moved - words) / moved).max(0), first_col[:-1])
            words, done = moved, change <= SETTLED
        for d in np.flatnonzero(done):
            g, w = gamma[:, first_row[d] : first_row[d + 1]], words[:, first_col[d] : first_col[d + 1]]
            out[which[d]] = ((g / g.sum(0)).T, w / w.sum(1, keepdims=True))
        if done.all():
            break
        if done.any():
            rows, cols = np.repeat(~done, ns), np.repeat(~done, ms)
            kept = rows[row]
            row, col, weight = (np.cumsum(rows) - 1)[row[kept]], (np.cumsum(cols) - 1)[col[kept]], weight[kept]
            words, ns, ms, which = words[:, cols], ns[~done], ms[~done], which[~done]
            first_row, first_col = np.append(0, np.cumsum(ns)), np.append(0, np.cumsum(ms))
    return out


def _shares(ns: np.ndarray, row: np.ndarray, weight: np.ndarray, at: np.ndarray, k: int, inner: int) -> np.ndarray:
    """The topics of all rows, from ones on; a document's as they are when they move by less than 0.001 on average. at: the words' weights in each topic."""
    out = np.ones((k, ns.sum()))
    rows, n, r, w, b, g = np.arange(out.shape[1]), ns, row, weight, at, out
    first = np.append(0, np.cumsum(n))
    begins = np.flatnonzero(np.append(True, r[1:] != r[:-1])[: len(r)])
    full, size = r[begins], np.diff(np.append(begins, len(r)))
    waits = np.ones(len(n), bool)  # documents that still move
    for _ in range(inner):
        theta = exp_digamma(g)  # not over their sums, which cancel out
        new = np.zeros_like(g)
        if len(r):
            parts = np.repeat(theta[:, full], size, axis=1)
            parts *= b
            p = np.add.reduce(parts, 0)
            np.divide(w, p, out=p)
            for t in range(k):
                new[t, full] = np.add.reduceat(np.multiply(p, b[t], out=parts[t]), begins)
        new = 1 / k + theta * new
        ends = waits & (np.add.reduceat(np.abs(new - g).sum(0), first[:-1]) / (n * k) < 1e-3)
        g = new
        if ends.any():
            ended = np.repeat(ends, n)
            out[:, rows[ended]] = g[:, ended]
            waits &= ~ends
            if not waits.any():
                return out
            if 4 * n[waits].sum() < 3 * n.sum():  # those that have ended leave, a quarter at a time
                stay = np.repeat(waits, n)
                kept = np.flatnonzero(np.repeat(stay[full], size))
                full, size = (np.cumsum(stay) - 1)[full[stay[full]]], size[stay[full]]
                begins, r, w, b = np.cumsum(size) - size, kept, w[kept], np.take(b, kept, axis=1)
                rows, g, n = rows[stay], g[:, stay], n[waits]
                waits, first = np.ones(len(n), bool), np.append(0, np.cumsum(n))
    last = np.repeat(waits, n)
    out[:, rows[last]] = g[:, last]
    return out


#: Weights times topics of the documents that are fitted together (memory and speed only).
TOGETHER = 1 << 19


def topic_count(n: int) -> int:
    """Topics of a document of n paragraphs: half as many, within 2 and 8."""
    return min(max(2, n // 2), 8)


def paragraph_words(paras: Column) -> Column:
    """Array of struct(para, words) of an array of struct(para, text, ..)."""
    return F.transform(paras, lambda p: F.struct(p["para"].alias("para"), terms(p["text"]).alias("words")))


def topic_model(paragraphs: DataFrame, k: int | None = None, iterations: int = 100, id_col: str = "doc_id") -> DataFrame:
    """``(id, para, topics, main_topic, confidence, words)``: one topic model a document over its TF-IDF weights.

    ``words`` are the eight of most weight in the paragraph's main topic, ties by
    name. A document's model is fitted in one task, from its text; its rows are its
    paragraphs and at most a thousand terms, weighed as by :func:`tfidf`.
    Paragraphs without a term have all topics alike.
    """
    docs = paragraphs.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("para", "text"))).alias("paras"))
    docs = docs.select(id_col, paragraph_words(F.col("paras")).alias("paras"))

    def fitted(mine: list[tuple]) -> pa.RecordBatch:
        """Results of documents of one number of topics: (topics, id, paras, keys of terms, what is fitted, words)."""
        topics, main, tops = [], [], []
        for (_, _, _, keys, _, names), (shares, words) in zip(mine, fit_many([d[4] for d in mine], mine[0][0], iterations), strict=True):
            best = np.argsort(-np.round(words, V.DIGITS), axis=1, kind="stable")[:, :8] if len(keys) else np.zeros((len(words), 0), int)
            named = [[term_name(names, keys[j]) for j in js] for js in best]
            topics.append(shares)
            main.append(shares.argmax(1))
            tops += [named[t] for t in main[-1]]
        topics, main = np.concatenate(topics), np.concatenate(main)
        ids = pa.concat_arrays([d[1] for d in mine]).take(pa.array(np.repeat(np.arange(len(mine)), [len(d[2]) for d in mine])))
        shares = pa.ListArray.from_arrays(pa.array(np.arange(len(topics) + 1) * topics.shape[1], pa.int32()), pa.array(topics.ravel()))
        arrays = [ids, pa.concat_arrays([d[2] for d in mine]), shares, pa.array(main.astype("int32")), pa.array(topics.max(1)), pa.array(tops, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "para", "topics", "main_topic", "confidence", "words"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[int, list[tuple]] = {}
            sizes: dict[int, int] = {}
            for first, block in blocks(batch, id_col, "paras"):
                block.weigh()
                for d, (paras, keys, what) in enumerate(block.documents()):
                    n = k or topic_count(len(paras))
                    waiting.setdefault(n, []).append((n, batch.column(id_col).slice(first + d, 1), paras, keys, what, block.names))
                    sizes[n] = sizes.get(n, 0) + n * len(what[4])
                    if sizes[n] >= TOGETHER:
                        del sizes[n]
                        yield fitted(waiting.pop(n))
            for mine in waiting.values():  # nothing of a batch is kept beyond it
                yield fitted(mine)

    types = {c: paragraphs.schema[c].dataType.simpleString() for c in (id_col, "para")}
    return docs.mapInArrow(fit, f"`{id_col}` {types[id_col]}, para {types['para']}, topics array<double>, main_topic int, confidence double, words array<string>")


def overall(semantic: Column, lexical: Column, coherence: Column, smoothness: Column, internal: Column, keywords: Column) -> Column:
    """Weighted score of the six measures, within 0 and 1."""
    return clamp(0.3 * semantic + 0.2 * lexical + 0.2 * coherence + 0.15 * smoothness + 0.1 * internal + 0.05 * keywords)


def grade(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def consistency(paragraphs: DataFrame, encoder: Encoder | None = None, id_col: str = "doc_id", topics: DataFrame | None = None) -> DataFrame:
    """``(id, n_paragraphs, semantic, lexical, internal, keywords, coherence, smoothness, n_boundaries, score, grade)`` of documents of two paragraphs or more.

    Input rows are (id, para, text, sentences). ``topics`` are rows (id, para,
    topics) of :func:`topic_model`; without them a paragraph's shares of the
    encoder's dimensions stand for its topics. Texts are shuffled once, to the
    row of their document, and all measures are made there.
    """
    encoder = encoder or hashed_encoder()
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))
    shares = lambda v: V.let(size(v), lambda n: F.transform(v, lambda x: F.when(n > 0, F.abs(x) / n).otherwise(F.lit(0.0))))
    rows = paragraphs.select(id_col, F.struct("para", "text", internal_consistency(encoder(F.col("sentences"))).alias("inner")).alias("row"))
    docs = rows.groupBy(id_col).agg(F.array_sort(F.collect_list("row")).alias("paras"), F.avg("row.inner").alias("internal"), F.count(F.lit(1)).cast("int").alias("n_paragraphs")).where("n_paragraphs > 1")
    both = lambda vs: F.struct(mean_cosine(vs).alias("semantic"), (topic_scores(F.transform(vs, shares)) if topics is None else F.lit(None)).alias("t"))
    docs = docs.withColumn("v", V.let(encoder(F.col("paras.text")), both)).select(id_col, "n_paragraphs", "internal", "v.semantic", "v.t", paragraph_words(F.col("paras")).alias("paras"))
    if topics is not None:
        docs = docs.drop("t")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in blocks(batch, id_col, "paras"):
                block.weigh()
                kept = batch.slice(first, len(block.n)).drop_columns(["paras"])
                yield kept.append_column("sims", pa.array(block.similarity())).append_column("keywords", pa.array(block.overlap()))

    made = docs.drop("paras").schema
    out = docs.mapInArrow(weighed, StructType([*made, StructField("sims", DoubleType()), StructField("keywords", DoubleType())]))
    if topics is not None:
        told = topics.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("para", "topics"))).alias("ts"))
        out = out.join(told.select(id_col, topic_scores(F.col("ts.topics")).alias("t")), id_col)
    pairs = F.col("n_paragraphs") * (F.col("n_paragraphs") - 1) / 2
    out = out.withColumn("lexical", F.col("sims") / pairs)
    score = overall(F.col("semantic"), F.col("lexical"), F.col("t.coherence"), F.col("t.smoothness"), F.col("internal"), F.col("keywords"))
    cols = {"semantic": "semantic", "lexical": "lexical", "internal": "internal", "keywords": "keywords", "coherence": "t.coherence", "smoothness": "t.smoothness"}
    return out.withColumn("s", F.round(score, 6)).select(id_col, "n_paragraphs", *[(F.round(v, 6) + 0.0).alias(k) for k, v in cols.items()], F.size("t.boundaries").alias("n_boundaries"), F.col("s").alias("score"), grade(F.col("s")).alias("grade"))
