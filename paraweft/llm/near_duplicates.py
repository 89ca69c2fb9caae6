"""MinHash near-duplicates by an LSH forest, confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paraweft.llm import words as W
from paraweft.llm.components import components
from paraweft.llm.spread import spread_join
from paraweft.scratch import Scratch

#: Orders of the forest, MinHash values that open a region, and those by which its members are sorted.
TREES, DEPTH, REST = 32, 4, 3
#: Members of a region that are all compared; a region with more is crowded.
SMALL = 8
#: Places ahead in a crowded region's order in which neighbours of the same whole path are taken.
AHEAD = 2
#: Rows of one region that a task holds together (memory only).
HELD = 4096
#: Signatures that a task doesn't repeat for copies (memory only).
REMEMBER = 200_000


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def signatures(sets: np.ndarray, starts: np.ndarray, k: int = TREES * DEPTH) -> np.ndarray:
    """MinHash values of each non-empty set, one row of ``k`` big-endian numbers a set."""
    mul, add = _permutations(k)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts) - 1, k), ">u4")
    if len(out):
        for i in range(k):
            out[:, i] = np.minimum.reduceat(x * mul[i] + add[i], starts[:-1])
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow array."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    column = column.cast(pa.binary(width))
    flat = np.frombuffer(column.buffers()[1], np.uint8) if len(column) else np.zeros(0, np.uint8)
    return flat[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def _sets(batch: pa.RecordBatch, n: int):
    """First row, sets, where each begins, and their identities, for each block of texts."""
    data, offsets = W.strings(batch.column(1))
    for i, j in W.blocks(offsets):
        sets, starts = W.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
        yield i, sets, starts, [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def _profiles(n: int):
    """Arrow function: (id, text) to the size, identity and, the first time in a task, signature of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for i, sets, starts, ids in _sets(batch, n):
                new = []
                for r, c in enumerate(ids):
                    if c is not None and c not in seen:
                        seen.add(c)
                        new.append(r)
                if len(seen) > REMEMBER:
                    seen.clear()
                sig = [None] * len(ids)
                if new:
                    sizes = np.diff(starts)[new]
                    at = np.concatenate([[0], np.cumsum(sizes)])
                    own = sets[np.repeat(starts[:-1][new] - at[:-1], sizes) + np.arange(at[-1])]
                    for r, s in zip(new, signatures(own, at), strict=True):
                        sig[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(ids)), pa.array(np.diff(starts), pa.int64()), pa.array(ids, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n_shingles", "cls", "sig"])

    return run


def _members(n: int):
    """Arrow function: (id, text) to the identity and members of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets, starts, ids in _sets(batch, n):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["cls", "members"])

    return run


def forest(classes: DataFrame) -> DataFrame:
    """The classes in each of the sorted orders: ``(path, cls, n_shingles)``, sorted over all partitions.

    Tree t reads the signature from value t * DEPTH on and around the end. Its
    number and DEPTH values name a region, the next REST values order its members.
    """
    turned = F.concat("sig", F.substring("sig", 1, 4 * REST))
    paths = [F.concat(F.lit(bytearray([t])), F.substring(turned, 4 * DEPTH * t + 1, 4 * (DEPTH + REST))) for t in range(TREES)]
    rows = classes.select(F.explode(F.array(*paths)).alias("path"), "cls", F.col("n_shingles").cast("int").alias("n_shingles"))
    return rows.repartitionByRange("path", "cls").sortWithinPartitions("path", "cls")


def _neighbours(percent: int):
    """Arrow function over a partition of :func:`forest`: candidate pairs ``(a, b)``, and ``(a, null)`` for members of crowded regions.

    In a region of up to ``SMALL`` members, all are paired. In a crowded one, those
    that share the whole path are: each with the next two and with the one of the
    least identity, which is the same in most trees. The others are left to
    :func:`rare_pairs`, which meets all members of crowded regions: most of them
    aren't linked, and confirming each would cost a join of its full set.
    A region at the end of a partition may go on in the next one and counts as crowded.
    """
    head = 1 + 4 * DEPTH

    def pieces(path: np.ndarray, cls: np.ndarray, n: np.ndarray, crowd: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs and flags among whole regions (or pieces of one); ``crowd`` marks rows of regions known to be crowded."""
        new = np.append(True, (path[1:, :head] != path[:-1, :head]).any(1))
        region = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))[region]
        crowded = (size > SMALL) | np.logical_or.reduceat(crowd, first)[region]
        turn = np.append(True, (path[1:] != path[:-1]).any(1))
        same = np.cumsum(turn) - 1
        alike = np.diff(np.append(np.flatnonzero(turn), len(turn)))[same]
        key = cls.view(">u8").astype(np.uint64).reshape(-1, 2)
        left, right = [], []
        for k in range(1, SMALL):
            i = np.flatnonzero((region[:-k] == region[k:]) & (~crowded[:-k] | ((k <= AHEAD) & (same[:-k] == same[k:]))))
            left.append(i)
            right.append(i + k)
        some = np.flatnonzero(crowded & (alike > AHEAD + 1))
        if len(some):
            lowest = np.lexsort((key[some, 1], key[some, 0], same[some]))
            lead = np.flatnonzero(np.append(True, np.diff(same[some][lowest]) != 0))
            pivot = np.repeat(some[lowest[lead]], np.diff(np.append(lead, len(some))))
            left.append(some)
            right.append(pivot)
        x, y = np.concatenate(left), np.concatenate(right)
        fit = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (x != y)
        x, y = x[fit], y[fit]
        swap = (key[x, 0] > key[y, 0]) | ((key[x, 0] == key[y, 0]) & (key[x, 1] > key[y, 1]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        other = (key[x] != key[y]).any(1)
        x, y = x[other], y[other]
        if len(x):
            yield pa.RecordBatch.from_arrays([_binary(cls[x]), _binary(cls[y])], names=["a", "b"])
        flagged = np.flatnonzero(crowded)
        if len(flagged):
            yield pa.RecordBatch.from_arrays([_binary(cls[flagged]), pa.nulls(len(flagged), pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (_fixed(batch.column(0), head + 4 * REST), _fixed(batch.column(1), 16), batch.column(2).to_numpy().astype(np.int64), np.zeros(batch.num_rows, bool))
            if held is not None:
                rows = tuple(np.concatenate([a, b]) for a, b in zip(held, rows, strict=True))
            path, cls, n, crowd = rows
            if start:
                crowd |= (path[:, :head] == path[0, :head]).all(1)
                start = False
            last = int((path[:, :head] != path[-1, :head]).any(1).sum())  # rows are sorted: all before the last region
            if len(path) - last > HELD:  # a crowded region is taken in pieces that share a few rows
                crowd[last:] = True
                yield from pieces(path, cls, n, crowd)
                last = len(path) - AHEAD
            elif last:
                yield from pieces(path[:last], cls[:last], n[:last], crowd[:last])
            held = tuple(a[last:].copy() for a in (path, cls, n, crowd))
        if held is not None and len(held[0]):
            held[3][:] = True
            yield from pieces(*held)

    return run


def rare_pairs(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """All pairs ``(a, b)`` of classes of different ``root`` that can reach ``percent``, from the rarest shingles of ``(cls, members, root)``.

    With shingles ordered by their frequency among these classes, two sets of m
    and n members that reach the limit have o >= percent (m + n) / (100 + percent)
    in common, so after the first shingle they share, this one counted, either has
    o members or more. Only the shingles of a set within that bound are compared,
    which are its rarest: a text's own, seldom those of the template it is made from.
    Members of one component aren't paired, and those of the largest component
    that holds a shingle are only met by others, so a group of any size that is
    one component costs nothing here. Rows of frequent shingles are dealt to several tasks.
    """
    sets = sets.withColumn("n", F.size("members"))
    rows = scratch.write(sets.select("cls", "n", F.explode("members").alias("g")), "rare-rows")
    df = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = spread_join(rows, df, ["g"], scratch, "rare-df")
    # shingles of one class only come first in the order and meet nothing
    own = F.col("n") - F.size("gs")
    reach = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    of_class = met.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    of_class = of_class.where(reach > own).select("cls", "n", own.alias("own"), F.slice("gs", F.lit(1), (reach - own).cast("int")).alias("gs"))
    prefix = of_class.join(sets.select("cls", "root"), "cls").select("cls", "n", "root", F.col("own"), F.posexplode("gs").alias("i", "s")).select(F.col("s.g").alias("g"), "cls", "root", "n", (F.col("n") - F.col("own") - F.col("i")).alias("left"))
    prefix = scratch.write(prefix, "rare-prefix")
    scratch.drop("rare-rows")
    shares = prefix.groupBy("g", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
    several = scratch.write(shares.where("roots > 1").select("g", F.col("top.root").alias("major")), "rare-several")
    prefix = scratch.write(spread_join(prefix, several, ["g"], scratch, "rare-major"), "rare-met")
    x = prefix.where("root <> major").select("g", F.col("cls").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("x_n"), F.col("left").alias("x_left"))
    y = prefix.select("g", F.col("cls").alias("y"), F.col("root").alias("y_root"), F.col("n").alias("y_n"), F.col("left").alias("y_left"))
    both = spread_join(y, x, ["g"], scratch, "rare-pairs").where("x_root <> y_root")
    both = both.where(F.lit(100 + percent) * F.least("x_left", "y_left") >= percent * (F.col("x_n") + F.col("y_n")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Connected groups of documents whose sets of n-word shingles overlap by ``percent`` of their union or more.

    Words are maximal runs outside the space and U+0009..U+000D with A-Z made
    small; a text with fewer than n words has its whole sequence as one shingle.
    Texts with equal sets form a class and are linked by that alone; the forest
    works on one signature a class, so any number of copies costs one class.

    1. The forest sorts the classes in ``TREES`` orders; those that share the first
       ``DEPTH`` values of an order stand in one region of it. All members of
       a small region are candidates; in a crowded one, neighbours that share the
       whole path and their common pivot are (:func:`_neighbours`).
    2. Candidates are confirmed on the full sets (64-bit shingle hashes): first
       each class's most frequent one, then those whose ends aren't yet connected.
    3. Classes that stand in a crowded region meet each other by their rarest
       shingles (:func:`rare_pairs`), which passes over no pair; those of different
       components are confirmed as well.

    So a link is missed only if its ends share no region at all, about once in
    2 * 10^7 pairs at 80 percent and less above, or by a collision of 64-bit hashes.

    Returns a row for each input row: the id, ``cls`` (identity of the set, null
    if empty), ``n_shingles``, ``component_id`` (smallest id reachable) and
    ``kept`` (id = component_id). Null, empty and blank texts have 0 shingles and
    are linked with nothing: their component is their own id. Rows that repeat an
    id and text all get the same result. A null id never becomes a component's
    id unless all ids of the component are null. Other columns are not read, so
    their names don't matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    id_type = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = scratch.write(named.mapInArrow(_profiles(n), f"id {id_type}, n_shingles long, cls binary, sig binary"), "base")
    classes = base.where("sig is not null").groupBy("cls").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    found = scratch.write(forest(classes).mapInArrow(_neighbours(percent), "a binary, b binary"), "found")
    pairs = scratch.write(found.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")), "pairs")
    crowded = scratch.write(found.where("b is null").select(F.col("a").alias("cls")).distinct(), "crowded")
    scratch.drop("found")

    nodes = base.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"))
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(crowded).distinct()
    wanted = scratch.write(nodes.join(ends, "cls"), "wanted")
    texts = named.join(wanted.select(F.col("rep").alias("r")), F.col("id").eqNullSafe(F.col("r")), "left_semi")
    sets = texts.mapInArrow(_members(n), "cls binary, members array<bigint>").join(wanted.select("cls"), "cls", "left_semi")
    sets = scratch.write(sets.groupBy("cls").agg(F.first("members").alias("members")), "sets")

    def confirmed(edges: DataFrame, name: str) -> DataFrame:
        edges = scratch.write(edges, f"{name}-edges")
        left, right = sets.select(F.col("cls").alias("a"), F.col("members").alias("ma")), sets.select(F.col("cls").alias("b"), F.col("members").alias("mb"))
        both = spread_join(spread_join(edges, left, ["a"], scratch, f"{name}-a"), right, ["b"], scratch, f"{name}-b").withColumn("inter", F.size(F.array_intersect("ma", "mb")))
        return scratch.write(both.where(100 * F.col("inter") >= percent * (F.size("ma") + F.size("mb") - F.col("inter"))).select("a", "b"), f"{name}-links")

    def parted(edges: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends aren't in one component."""
        left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        return edges.join(left, "a", "left").join(right, "b", "left").where("not coalesce(ra = rb, false)").select("a", "b")

    def joined(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Components of the stars found so far and more links."""
        if links.isEmpty():
            return roots
        return scratch.write(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links), scratch, f"{name}-cc"), f"{name}-roots")

    seen = pairs.select(F.col("a").alias("x"), "a", "b", "hits").unionByName(pairs.select(F.col("b").alias("x"), "a", "b", "hits"))
    best = scratch.write(seen.groupBy("x").agg(F.max(F.struct("hits", "a", "b")).alias("e")).select("e.a", "e.b").distinct(), "best")
    roots = scratch.write(components(confirmed(best, "best"), scratch, "cc"), "roots")
    roots = joined(roots, confirmed(parted(pairs.join(best, ["a", "b"], "left_anti"), roots), "open"), "open")
    rest = sets.join(crowded, "cls").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "members", F.coalesce("root", "cls").alias("root"))
    if not crowded.isEmpty():
        roots = joined(roots, confirmed(rare_pairs(rest, scratch, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "rare"), "rare")
    scratch.drop("sets", "pairs")

    reps = nodes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = scratch.write(reps.join(least, "root").select("cls", "component_id"), "of-class")
    out = spread_join(base.select("id", "n_shingles", "cls"), of_class, ["cls"], scratch, "out", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "cls", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
