"""Benchmark decontamination: a bound from pairs of words, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paraweft.llm import words as W

#: Words from which an item is aligned; a shorter one must stand in a text whole.
SEED = 4
MATCH, MISMATCH, GAP = 2, -1, 1
#: Characters of benchmark text in a block; a larger benchmark is taken in several blocks.
BLOCK_CHARS = 16_000_000
#: Places of items that are looked at together (memory only).
EXPANDED = 4_000_000

_STOP = np.ones(256, bool)
_STOP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word: a run of ASCII letters, digits and characters beyond ASCII."""
    data = W.LOWER[data]
    begin, end, row = W.spans(data, offsets, _STOP)
    return W.hashes(data, begin, end), row


def _pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word with the next one and with the one after that, the index of its first word and whether they are neighbours."""
    first = [np.flatnonzero(row[:-g] == row[g:]) for g in (1, 2)]
    pairs = [W.sequence([h[f], h[f + g]]) for g, f in zip((1, 2), first, strict=True)]
    return np.concatenate(pairs), np.concatenate(first), np.repeat([True, False], [len(f) for f in first])


def _weighed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``codes >> 1`` and their greatest weight: 2 where a code is odd, 1 else."""
    codes = np.unique(codes)
    last = np.append(np.diff(codes >> 1) != 0, True) if len(codes) else np.zeros(0, bool)
    return codes[last] >> 1, (codes[last] & 1) + 1


class Index:
    """A block of benchmark items: their words, and where each pair of words stands in them.

    An alignment with m matches and e other columns scores 2m - e. Of its m - 1
    pairs of successive matches, x have no other column between them and y have
    one, so e >= y + 2 (m - 1 - x - y), and 2x + y >= score - 2. Each such pair is
    a pair of the item and of the text, both of neighbours (x) or at least one of
    them with a word between (y), and begins at a place of its own in either. So
    a text in which places of the item weigh less than ``need`` has no alignment
    of ``least`` or more.
    """

    def __init__(self, ids: list, texts: list[str], least: float):
        data, offsets = W.strings(pa.array(texts, pa.string()))
        h, row = _words(data, offsets)
        self.ids, self.words, self.item = ids, h, row
        self.starts = np.searchsorted(row, np.arange(len(ids) + 1))
        size = np.diff(self.starts)
        self.need = np.maximum(np.ceil(MATCH * least * size - 2 - 1e-9), 1).astype(np.int64)
        #: words of a text that an alignment spans at most
        self.reach = np.ceil(size + np.maximum(MATCH * size * (1 - least), 0)).astype(np.int64) + 1
        pairs, first, near = _pairs(h, row)
        long = size[row[first]] >= SEED
        pairs, first, near = pairs[long], first[long], near[long]
        order = np.argsort(pairs, kind="stable")
        self.grams, self.counts = np.unique(pairs, return_counts=True)
        self.places, self.near = first[order].astype(np.int32), near[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        key = np.repeat(np.arange(len(self.grams)), self.counts)
        by_item = np.argsort(row[self.places] * len(self.grams) + key, kind="stable")
        self.own_keys, self.own_at = key[by_item].astype(np.int32), by_item.astype(np.int32)
        self.own = np.searchsorted(row[self.places[by_item]], np.arange(len(ids) + 1))
        #: for each number of words below SEED, the items of that many by the hash of all their words
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, SEED):
            items = np.flatnonzero(size == k)
            if len(items):
                keys = W.sequence([h[self.starts[items] + i] for i in range(k)])
                by_key = np.argsort(keys, kind="stable")
                self.short[k] = keys[by_key], items[by_key]
        self.rare(np.zeros(len(self.grams), np.int64))

    def whole(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
        """(row, match) of the short items that stand in texts, at the first place of each."""
        for k, (keys, items) in self.short.items():
            grams, first = W.ngrams(h, row, k)
            lo, hi = np.searchsorted(keys, grams), np.searchsorted(keys, grams, "right")
            reps = hi - lo
            if not reps.sum():
                continue
            item = items[np.repeat(lo - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())]
            at = np.repeat(first, reps)
            _, once = np.unique(row[at] * len(self.ids) + item, return_index=True)
            for i in once.tolist():
                r = int(row[at[i]])
                yield r, (int(item[i]), 1.0, int(at[i] - np.searchsorted(row, r)), k)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``grams`` are in the index, and where."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[k] == grams[at]
        return at[same], k[same]

    def rare(self, df: np.ndarray) -> Index:
        """Choose by document frequency the places that are looked at first.

        The most frequent places of an item, a quarter of ``need``, are left out. They
        weigh 2 each at most, so what the others must weigh is less by that and
        nothing is lost, whatever the frequencies are.
        """
        of_place = np.bincount(self.places, np.repeat(df, self.counts).astype(float), len(self.words))
        keep = np.ones(len(self.words), bool)
        for i, n in enumerate(self.need // 4):
            if n and self.own[i] < self.own[i + 1]:
                begin, end = self.starts[i], self.starts[i + 1] - 1
                keep[begin + np.argsort(-of_place[begin:end], kind="stable")[:n]] = False
        kept = keep[self.places]
        self.first_need = self.need - 2 * (self.need // 4)
        self.first_places, self.first_near = self.places[kept], self.near[kept]
        self.first_counts = np.bincount(np.repeat(np.arange(len(self.grams)), self.counts)[kept], minlength=len(self.grams))
        self.first_heads = np.concatenate([[0], np.cumsum(self.first_counts)])
        return self

    def likely(self, doc: np.ndarray, k: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) of which enough places are met, from the pairs ``k`` found in documents (in order)."""
        sums = np.concatenate([[0], np.cumsum(self.first_counts[k])])
        heads = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        i = 0
        while i < len(heads) - 1:
            j = max(i + 1, int(np.searchsorted(sums[heads], sums[heads[i]] + EXPANDED, "right")) - 1)
            s = slice(heads[i], heads[j])
            i = j
            reps = self.first_counts[k[s]]
            at = np.repeat(self.first_heads[k[s]] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            both = np.repeat(near[s], reps) & self.first_near[at]
            codes, weight = _weighed((np.repeat(doc[s], reps) * len(self.words) + self.first_places[at]) * 2 + both)
            if not len(codes):
                continue
            pair = codes // len(self.words) * len(self.ids) + self.item[codes % len(self.words)]
            head = np.flatnonzero(np.diff(pair, prepend=-1))
            total = np.add.reduceat(weight, head)
            d, item = pair[head] // len(self.ids), pair[head] % len(self.ids)
            enough = total >= self.first_need[item]
            yield from zip(d[enough].tolist(), item[enough].tolist(), strict=True)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word sequences and its range in ``b``; linear gaps, one pass over ``a``."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        h, ramp, top, at = np.zeros(len(b) + 1, np.int64), GAP * np.arange(len(b)), 0, (0, 0)
        for i, w in enumerate(a):
            t = np.maximum(np.maximum(h[:-1] + np.where(b == w, MATCH, MISMATCH), h[1:] - GAP), 0)
            h[1:] = np.maximum.accumulate(t + ramp) - ramp
            j = int(h[1:].argmax())
            if h[j + 1] > top:
                top, at = int(h[j + 1]), (i + 1, j + 1)
        return top, *at

    top, i, j = best(a, b)
    if not top:
        return 0, 0, 0
    _, _, back = best(a[:i][::-1], b[:j][::-1])
    return top, j - back, j


def _match(index: Index, item: int, h: np.ndarray, p: np.ndarray, k: np.ndarray, near: np.ndarray) -> tuple[float, int, int]:
    """Score, first word and number of words of an item's best passage in one document's words ``h``, in which the pairs ``k`` begin at ``p``."""
    a = index.words[index.starts[item] : index.starts[item + 1]]
    own = slice(index.own[item], index.own[item + 1])
    lo = np.searchsorted(index.own_keys[own], k)
    reps = np.searchsorted(index.own_keys[own], k, "right") - lo
    at = index.own_at[own][np.repeat(lo - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())]
    p, both = np.repeat(p, reps), np.repeat(near, reps) & index.near[at]
    place, weight = _weighed(p * 2 + both)
    reach, sums = int(index.reach[item]), np.concatenate([[0], np.cumsum(weight)])
    upto = np.searchsorted(place, place + reach)
    full = np.flatnonzero(sums[upto] - sums[:-1] >= index.need[item])
    best = (0.0, 0, 0)
    if not len(full):
        return best
    lines, n = np.unique(p[both] - index.places[at[both]] + index.starts[item], return_counts=True)
    for d in lines[(n >= len(a) - 1) & (lines >= 0)]:
        if np.array_equal(h[d : d + len(a)], a):
            return 1.0, int(d), len(a)
    lo, hi = np.maximum(place[full] - reach, 0), np.minimum(place[upto[full] - 1] + reach, len(h))
    cut = np.flatnonzero(np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1]))
    for i, j in zip(lo[cut], np.maximum.reduceat(hi, cut), strict=True):
        top, begin, end = smith_waterman(a, h[i:j])
        best = max(best, (top / (MATCH * len(a)), int(i) + begin, end - begin))
    return best


def _each(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and their rows for each block of texts of a batch."""
    data, offsets = W.strings(batch.column(column))
    for i, j in W.blocks(offsets):
        h, row = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, h, row


def _frequency(shared):
    """Arrow function: in how many of its documents each pair of the index stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        df = np.zeros(len(index.grams), np.int64)
        for batch in batches:
            for _, h, row in _each(batch, 0):
                grams, first, _ = _pairs(h, row)
                at, k = index.find(grams)
                if len(at):
                    pairs = np.unique(row[first[at]] * len(index.grams) + k)
                    df += np.bincount(pairs % len(index.grams), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["gram", "df"])

    return run


def _found(index: Index, batch: pa.RecordBatch, column: int, least: float) -> Iterator[tuple[int, tuple[int, float, int, int]]]:
    for i, h, row in _each(batch, column):
        for r, match in index.whole(h, row):
            yield i + r, match
        grams, first, near = _pairs(h, row)
        at, k = index.find(grams)
        order = np.argsort(first[at], kind="stable")
        place, k, near = first[at][order], k[order], near[at][order]
        doc = row[place]
        for d, item in index.likely(doc, k, near):
            begin, end = np.searchsorted(row, [d, d + 1])
            s = slice(*np.searchsorted(doc, [d, d + 1]))
            best = _match(index, item, h[begin:end], place[s] - begin, k[s], near[s])
            if best[0] >= least:
                yield i + d, (item, *best)


def _align(shared, least: float, item_type: pa.DataType):
    """Arrow function: (id, text) to the items that stand in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = list(_found(index, batch, 1, least))
            if found:
                rows = pa.array([r for r, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), pa.array([index.ids[m[0]] for _, m in found], item_type), pa.array([m[1] for _, m in found]), pa.array([m[2] for _, m in found], pa.int64()), pa.array([m[3] for _, m in found], pa.int64())],
                    names=["id", "item", "score", "first_word", "n_words"],
                )

    return run


def _clean(shared, least: float, column: int):
    """Arrow function: the rows, all columns as they are, in whose text no item stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _ in _found(shared.value, batch, column, least)]] = False
            yield batch.drop_columns(["\x01lower"]).filter(pa.array(keep))

    return run


def _lower(docs: DataFrame, text_col: str):
    return F.lower(docs[text_col].cast("string"))


def _indexes(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, least: float) -> Iterator:
    """The benchmark in broadcast blocks, each with its rare places by frequency over all documents."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item"), F.lower(F.col(item_text).cast("string")).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // BLOCK_CHARS) or 1
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        index = Index([r[0] for r in rows], [r[1] for r in rows], least)
        if not len(index.grams) and not index.short:
            continue
        shared = spark.sparkContext.broadcast(index)
        counts = docs.select(_lower(docs, text_col)).mapInArrow(_frequency(shared), "gram long, df long").groupBy("gram").agg(F.sum("df")).collect()
        df = np.zeros(len(index.grams), np.int64)
        for gram, n in counts:
            df[gram] = n
        yield spark.sparkContext.broadcast(index.rare(df))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.5) -> DataFrame:
    """Which documents hold which benchmark items, as exact, edited or partly copied passages.

    Words are runs of ASCII letters, digits and characters beyond ASCII of the
    lower-cased text. An alignment of ``least`` needs a number of the item's pairs
    of near words (:class:`Index`); where a document holds that many close enough
    together, the passage is aligned with the item by Smith-Waterman (match 2,
    other word -1, gap -1). Frequencies only decide which pairs are counted first,
    so no alignment of ``least`` is passed over; the score is the best
    alignment's over that of a perfect copy. Rows with at least ``least`` return:
    ``(id, item_id, score, first_word, n_words)``, the best passage of each
    document and item. At 0.5, an item may have a third of its words replaced
    at even distances, or half of it be missing. What a single word would reach
    (``least`` times the item's words is 1 or less) is not looked for.

    The benchmark is broadcast in blocks of at most about ``BLOCK_CHARS``
    characters; a larger one costs more passes over the documents. Documents are
    never shuffled. Null and empty texts and items match nothing; an item of fewer
    than ``SEED`` words must stand in a text whole, its words one after another, and
    scores 1; a null item id is carried like any other. Rows that
    repeat give repeated results, items that repeat are each reported. An empty
    table on either side gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = items.schema[item_id].dataType
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, item {item_type.simpleString()}, score double, first_word long, n_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _indexes(docs, items, text_col, item_id, item_text, least):
        found = docs.select(F.col(id_col).alias("id"), _lower(docs, text_col)).mapInArrow(_align(shared, least, to_arrow_type(item_type)), schema)
        out = out.unionByName(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "score", "first_word", "n_words")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, that hold no benchmark item by the rule of :func:`contaminated`."""
    schema = docs.schema
    for shared in _indexes(docs, items, text_col, item_id, item_text, least):
        docs = docs.withColumn("\x01lower", _lower(docs, text_col)).mapInArrow(_clean(shared, least, len(schema)), schema)
    return docs
