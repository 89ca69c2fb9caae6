"""Terms and weights of whole documents, a block of documents at a time in NumPy.

What :func:`topics.tfidf` and :func:`topics.keyword_overlap` make as rows, for
tables that have a document's paragraphs in one row: terms are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of the documents that are weighed together (memory only); one document is never parted.
WORDS = 1 << 16


def blocks(batch: pa.RecordBatch, ids: str, paras: str) -> Iterator[tuple[int, Block]]:
    """The documents of a batch in blocks, each with the place of its first one. ``paras``: array of struct(para, words) in order."""
    column = batch.column(paras)
    words = pc.struct_field(column.flatten(), "words")
    size = np.add.reduceat(np.append(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), 0), np.append(0, np.cumsum(column.value_lengths()))[:-1]) if len(column) else []
    begin = total = 0
    for k, n in enumerate(size):
        if total + n > WORDS and k > begin:
            yield begin, Block(batch.column(ids).slice(begin, k - begin), column.slice(begin, k - begin))
            begin, total = k, 0
        total += n
    if begin < len(column):
        yield begin, Block(batch.column(ids).slice(begin), column.slice(begin))


class Block:
    """Terms of some documents. A paragraph that comes in several rows has the terms of all of them; a document without an id has none."""

    def __init__(self, ids: pa.Array, paras: pa.ListArray):
        self.n = paras.value_lengths().to_numpy(zero_copy_only=False).astype(int)  # rows of each document
        flat = paras.flatten()
        self.paras, lists = pc.struct_field(flat, "para"), pc.struct_field(flat, "words")
        self.first = np.append(0, np.cumsum(self.n))
        doc_of_row = np.repeat(np.arange(len(self.n)), self.n)
        null = self.paras.is_null().to_numpy(zero_copy_only=False)
        other = pc.fill_null(pc.not_equal(self.paras[1:], self.paras[:-1]), False).to_numpy(zero_copy_only=False)
        self.para_of_row = np.cumsum(np.append(False, other | (null[1:] != null[:-1]) | (doc_of_row[1:] != doc_of_row[:-1]))) if len(flat) else np.zeros(0, int)
        self.n_paras = int(self.para_of_row[-1]) + 1 if len(flat) else 0
        self.doc_of_para, self.unnamed = np.zeros(self.n_paras, int), np.zeros(self.n_paras, bool)
        self.doc_of_para[self.para_of_row], self.unnamed[self.para_of_row] = doc_of_row, null
        row = np.repeat(np.arange(len(flat)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        self.names = coded.dictionary.take(pa.array(order)).to_pylist()  # by name, so codes and the pairs of codes are in the order of terms
        code = place[coded.indices.to_numpy()]
        named = ids.is_valid().to_numpy(zero_copy_only=False)[doc_of_row[row]]
        self.row, self.code = row[named], code[named]

    def counts(self, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms (document and key, in order), and the cells (term, paragraph, occurrences), by term."""
        base = len(self.names) + 1
        key, row = self.code * base, self.row
        if pairs:
            near = np.flatnonzero(row[1:] == row[:-1])
            key, row = np.append(key, key[near] + self.code[near + 1] + 1), np.append(row, row[near])
        keys, at = np.unique(key, return_inverse=True)
        para = self.para_of_row[row]
        ours, at = np.unique(self.doc_of_para[para] * max(len(keys), 1) + at, return_inverse=True)
        cells, tf = np.unique(at * max(self.n_paras, 1) + para, return_counts=True)
        return ours // max(len(keys), 1), keys[ours % max(len(keys), 1)], cells // max(self.n_paras, 1), cells % max(self.n_paras, 1), tf

    def weigh(self, most: float = 0.9, features: int = 1000) -> None:
        """Makes ``keys`` (each document's terms by name, from ``first_term``) and the weights (para, term, weight), by paragraph and term."""
        doc, keys, term, para, tf = self.counts(True)
        df, total, n = np.bincount(term, minlength=len(keys)), np.bincount(term, tf, len(keys)), self.n[doc]
        fit = np.flatnonzero(df <= most * n)
        fit = fit[np.lexsort((fit, -total[fit], doc[fit]))]
        each = np.bincount(doc[fit], minlength=len(self.n))
        kept = np.zeros(len(keys), bool)
        kept[fit[np.arange(len(fit)) - np.repeat(np.cumsum(each) - each, each) < features]] = True
        self.first_term = np.append(0, np.cumsum(np.bincount(doc[kept], minlength=len(self.n))))
        self.keys, number, cell = keys[kept], np.cumsum(kept) - 1, kept[term]
        term, para, tf = term[cell], para[cell], tf[cell]
        raw = tf * (np.log((1 + n[term]) / (1 + df[term])) + 1)
        weight = np.round(raw / np.sqrt(np.bincount(para, raw * raw, self.n_paras))[para], 9)
        order = np.lexsort((term, para))
        order = order[~self.unnamed[para[order]]]
        self.para, self.term, self.weight = para[order], number[term[order]], weight[order]

    def similarity(self) -> np.ndarray:
        """Of each document the sum of the products of weights over all pairs of paragraphs, from sums by term: linear in the weights."""
        total, own = np.bincount(self.term, self.weight, len(self.keys)), np.bincount(self.term, self.weight**2, len(self.keys))
        shared = np.where(np.bincount(self.term, minlength=len(self.keys)) > 1, (total * total - own) / 2, 0.0)
        return np.bincount(np.repeat(np.arange(len(self.n)), np.diff(self.first_term)), shared, len(self.n))

    def overlap(self, k: int = 5) -> np.ndarray:
        """Of each document the mean Jaccard of neighbouring rows' ``k`` most frequent words, ties by name; 0 for one row."""
        _, keys, term, para, tf = self.counts(False)
        order = np.lexsort((term, -tf, para))
        order = order[~self.unnamed[para[order]]]
        each = np.bincount(para[order], minlength=self.n_paras)
        place = np.arange(len(order)) - np.repeat(np.cumsum(each) - each, each)
        top = np.full((self.n_paras, k), -1)
        top[para[order[place < k]], place[place < k]] = keys[term[order[place < k]]]
        a = np.delete(np.arange(len(self.para_of_row)), self.first[:-1])  # rows after another of their document
        before, after = top[self.para_of_row[a - 1]], top[self.para_of_row[a]]
        both = ((before[:, :, None] == after[:, None, :]) & (before >= 0)[:, :, None]).sum((1, 2))
        union = (before >= 0).sum(1) + (after >= 0).sum(1) - both
        share = np.round(both / np.maximum(union, 1), 9)
        return np.bincount(self.doc_of_para[self.para_of_row[a]], share, len(self.n)) / np.maximum(self.n - 1, 1)

    def documents(self) -> Iterator[tuple[pa.Array, list[int], tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
        """Of each document its paragraphs, the keys of its terms and what :func:`topics.fit_many` takes: a row for each row of a paragraph."""
        begin = np.searchsorted(self.para, np.arange(self.n_paras + 1))
        size = np.diff(begin)[self.para_of_row]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[:-1][self.para_of_row], size)
        row, term, weight = np.repeat(np.arange(len(size)), size), self.term[at], self.weight[at]
        ends = np.append(0, np.cumsum(size))[self.first]
        for d, n in enumerate(self.n.tolist()):
            cells, terms = slice(ends[d], ends[d + 1]), slice(self.first_term[d], self.first_term[d + 1])
            yield self.paras.slice(self.first[d], n), self.keys[terms].copy(), (n, max(terms.stop - terms.start, 1), row[cells] - self.first[d], term[cells] - terms.start, weight[cells].copy())


def term_name(words: list[str], key: int) -> str:
    """The term of a key, from its block's words."""
    first, second = divmod(int(key), len(words) + 1)
    return f"{words[first]} {words[second - 1]}" if second else words[first]
