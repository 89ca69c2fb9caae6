"""Exact top-k inner products by a three-phase uniform threshold over lists of partial scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paraweft.scratch import Scratch

#: Blocks of dimensions, each the home of one list of partial scores.
LISTS = 4
#: Bytes of queries in a broadcast block; more queries cost more passes over the vectors.
BLOCK_BYTES = 64 << 20
#: Queries and vectors scored at a time.
QUERIES, CHUNK = 512, 2048
_EXACT = 2.0**53
_LEAST, _MOST, _WITHIN = -(1 << 63), (1 << 63) - 1, b"\x01"
LISTED = "query_id long, vec_id long, score long, beyond binary, resolved long"
NAMES = ["query_id", "vec_id", "score", "beyond", "resolved"]


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)``: vectors as floor(256 x) in doubles, without vectors that are null, empty or hold a null or non-finite component."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))

    def whole(x):
        y = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(y) >= _EXACT, y).otherwise(F.floor(y).cast("double"))  # a double this large has no fraction

    rows = df.where(v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("v"))
    return rows.where(~F.exists("v", lambda x: F.abs(x) == F.lit(float("inf"))))


class Block:
    """A block of queries of one length: ids, vectors, and per query the cutoff once phase 1 has set it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.parts = [p for p in np.array_split(np.arange(vectors.shape[1]), LISTS) if len(p)]
        self.cutoff = np.full(len(ids), -np.inf)

    def exact(self, vectors: np.ndarray) -> bool:
        """Whether no score with these vectors, nor a multiple by the number of lists, can pass 2**53."""
        top = np.abs(self.vectors).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1]
        return top * len(self.parts) < _EXACT

    def lists(self, part: slice, ids: np.ndarray, vectors: np.ndarray) -> list[np.ndarray]:
        """Partial scores of some queries with some vectors in each list; a query's own rows are out of every list."""
        out = [self.vectors[part][:, p] @ vectors[:, p].T for p in self.parts]
        mine = self.ids[part]
        order = np.argsort(mine)
        at = np.searchsorted(mine[order], ids)
        own = np.flatnonzero(mine[order][np.minimum(at, len(mine) - 1)] == ids)
        for x in out:
            x[order[at[own]], own] = -np.inf
        return out

    def gather(self, part: slice, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Phase 1: the whole scores of the rows that lead some list, once each, best first; -inf where there are none."""
        lists = self.lists(part, ids, vectors)
        take = min(self.k, len(ids))
        lead = np.concatenate([np.argpartition(x, -take, axis=1)[:, -take:] for x in lists], axis=1)
        lead.sort(axis=1)
        scores = sum(np.take_along_axis(x, lead, 1) for x in lists)
        scores[:, 1:][lead[:, 1:] == lead[:, :-1]] = -np.inf
        return -np.sort(-scores, axis=1)[:, : self.k]

    def collect(self, part: slice, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phases 2 and 3: (query, row, score) of the rows that some list holds from its share of the cutoff on and whose score reaches it."""
        lists = self.lists(part, ids, vectors)
        cutoff = self.cutoff[part][:, None]
        found = np.zeros(lists[0].shape, bool)
        for x in lists:
            found |= x * len(lists) >= cutoff
        q, row = np.nonzero(found)
        score = sum(x[q, row] for x in lists)
        enough = (score >= cutoff[q, 0]) & (score > -np.inf)
        return q[enough], row[enough], score[enough]


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, CHUNK):
            part = batch.slice(i, CHUNK)
            lists = part.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            fit = np.flatnonzero(sizes == width)
            if len(fit):
                lists = lists.take(pa.array(fit)) if len(fit) < len(sizes) else lists
                yield part.column(0).to_numpy()[fit], lists.flatten().to_numpy().reshape(-1, width)


def _parts(n: int) -> Iterator[slice]:
    for i in range(0, n, QUERIES):
        yield slice(i, min(i + QUERIES, n))


def _large(block: Block, ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Scores that doubles can't hold: the k best (score, id) of each query in Python's integers."""
    rows = [[int(x) for x in v] for v in vectors]
    for q, (own, v) in enumerate(zip(block.ids.tolist(), block.vectors, strict=True)):
        a = [int(x) for x in v]
        scored = ((sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in zip(ids.tolist(), rows, strict=True) if i != own)
        yield q, sorted(scored, key=lambda r: (-r[0], r[1]))[: block.k]


def _beyond(score: int) -> bytes:
    """A key that orders scores that are the same once clipped to 64 bits."""
    if _LEAST <= score <= _MOST:
        return _WITHIN
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + key if score > 0 else b"\x00" + bytes(255 - x for x in key)


def _phase_1(shared):
    """Arrow function: for each query the best whole scores among the rows that lead a list here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = np.full((len(block.ids), block.k), -np.inf)
        for ids, vectors in _chunks(batches, block.vectors.shape[1]):
            if not block.exact(vectors):
                continue  # these rows are all resolved in phase 3
            for part in _parts(len(block.ids)):
                both = np.concatenate([best[part], block.gather(part, ids, vectors)], axis=1)
                best[part] = -np.sort(-both, axis=1)[:, : block.k]
        q, _ = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(best[best > -np.inf])], names=["query_id", "score"])

    return run


def _phases_2_and_3(shared):
    """Arrow function: each query's k best rows here, among those that reach its cutoff, and how many were resolved for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        n, k = len(block.ids), block.k
        # the k best so far, then those just found; scores beyond doubles are kept apart
        scores, names = np.zeros(0), np.zeros(0, np.int64)
        of, resolved = np.zeros(0, np.int64), np.zeros(n, np.int64)
        large: dict[int, list[tuple[int, int]]] = {}

        def cut() -> None:
            nonlocal of, scores, names
            order = np.lexsort((names, -scores, of))
            of, scores, names = of[order], scores[order], names[order]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
            nth = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
            of, scores, names = of[nth < k], scores[nth < k], names[nth < k]

        for ids, vectors in _chunks(batches, block.vectors.shape[1]):
            if not block.exact(vectors):
                for q, found in _large(block, ids, vectors):
                    resolved[q] += len(ids)
                    large[q] = sorted(large.get(q, []) + found, key=lambda r: (-r[0], r[1]))[:k]
                continue
            for part in _parts(n):
                q, row, score = block.collect(part, ids, vectors)
                resolved += np.bincount(q + part.start, minlength=n)
                of, scores, names = np.concatenate([of, q + part.start]), np.concatenate([scores, score]), np.concatenate([names, ids[row]])
                if len(of) > 4 * k * n + CHUNK * QUERIES:
                    cut()
        cut()
        for q, found in large.items():
            mine = np.flatnonzero(of == q)
            found = sorted(found + [(int(s), int(i)) for s, i in zip(scores[mine], names[mine], strict=True)], key=lambda r: (-r[0], r[1]))[:k]
            of, scores, names = np.delete(of, mine), np.delete(scores, mine), np.delete(names, mine)
            clipped = [min(max(s, _LEAST), _MOST) for s, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([int(block.ids[q])] * len(found), pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array(clipped, pa.int64()), pa.array([_beyond(s) for s, _ in found], pa.binary()), pa.array([resolved[q]] * len(found), pa.int64())], names=NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[of]), pa.array(names), pa.array(scores.astype(np.int64)), pa.array([_WITHIN] * len(of), pa.binary()), pa.array(resolved[of])], names=NAMES)

    return run


def _blocks(queries: DataFrame, k: int) -> Iterator[Block]:
    """The queries in blocks of one length and at most ``BLOCK_BYTES``."""
    for width, count in sorted((r[0], r[1]) for r in queries.groupBy(F.size("v").alias("w")).count().collect()):
        parts = -(-count * width * 8 // BLOCK_BYTES)
        for part in range(parts):
            got = queries.where((F.size("v") == width) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).toArrow()
            if got.num_rows:
                ids = got.column("id").to_numpy()
                vectors = got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
                order = np.argsort(ids)
                yield Block(ids[order], np.ascontiguousarray(vectors[order]), k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the k largest integer inner products with other rows.

    Components become floor(256 x). The dimensions are dealt to ``LISTS`` blocks,
    each of which is a list of partial scores of every query; a score is the sum
    over the lists.

    1. Each task gathers, for each query, the k rows that lead each of its lists,
       and resolves only those. The k-th best of all that are gathered is a safe
       cutoff t: k rows reach it.
    2. The cutoffs are broadcast. A score of at least t has a partial score of at
       least t / LISTS in some list, so each task collects the entries of its lists
       from there on; no other row can be among the k best.
    3. The missing partial scores of what was collected, and of nothing else, are
       added. Rows below t go; a task hands on at most k rows for each query.

    A query that gathers fewer than k rows has no cutoff and has all rows
    resolved, as have vectors so large that doubles can't hold their scores. Every
    result is exact; a score beyond 64 bits is ranked as it is and returned as the
    nearest 64-bit integer. Rows are never paired in a table.

    Queries are taken in broadcast blocks of at most ``BLOCK_BYTES``. Vectors that
    are null, empty or hold a component that is null or not finite (once multiplied
    by 256), and null ids, take no part. Vectors are compared with queries of their
    own length only. Rows that repeat an id are rows of their own: each may be
    among the results, but for a query's own id; a query id that repeats is asked
    once, by its first vector in sorted order. All results are returned if there
    are fewer than k; an empty table gives none. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    rows = scratch.write(quantised(vectors, id_col, vector_col), "whole")
    queries = scratch.write(rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    lists = spark.createDataFrame([], LISTED)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    for block in _blocks(queries, k):
        found = rows.mapInArrow(_phase_1(spark.sparkContext.broadcast(block)), "query_id long, score double")
        kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", "score").toArrow()
        block.cutoff[np.searchsorted(block.ids, kth.column("query_id").to_numpy())] = kth.column("score").to_numpy()
        lists = lists.unionByName(rows.mapInArrow(_phases_2_and_3(spark.sparkContext.broadcast(block)), LISTED))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
