"""A content-addressed store of token ids.

A store is a folder of Parquet files:

``content/kind=chunk``    digest (blake2b, 16 bytes), data: ids as little-endian uint16, or uint32 where one is
                          65536 or more, after a byte that says which (2 or 4). Each digest once.
``recipes``               part, pos, id, local_start, n_tokens, digests, sizes, root: in ascending order of id within and
                          across parts; a document's ids are its chunks' one after another. A last row with kind ``part``
                          closes each part: its documents, ids and Merkle root.
``manifest``              part, start (ids of all parts before it), n_docs, n_tokens, root (Merkle root of its documents'
                          roots), store_root (Merkle root of all parts' roots).

Roots depend on the documents of a part and their order alone, not on batches or on how files are split for reading.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paraweft.llm.spread import spread_join
from paraweft.llm.tokens import Proof, encoder
from paraweft.scratch import Scratch

#: Ids that decide on a cut; a cut falls after one in 2**CUT_BITS places on average, between LEAST and MOST ids from the last.
WINDOW, CUT_BITS, LEAST, MOST = 8, 9, 64, 4096
_B = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def rolling(ids: np.ndarray) -> np.ndarray:
    """A hash of each ``WINDOW`` ids that end at a place; shorter at the beginning."""
    if not len(ids):
        return np.zeros(0, np.uint64)
    up, down = np.full(len(ids), _B, np.uint64), np.full(len(ids), _B_INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    total = np.cumsum(g * up, dtype=np.uint64)
    total[WINDOW:] -= total[:-WINDOW].copy()
    return total * down * np.uint64(0xBF58476D1CE4E5B9)


def cut(ids: np.ndarray, hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    places = np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, last, k = [], 0, 0
    while len(ids) - last > LEAST:
        k += int(np.searchsorted(places[k:], last + LEAST))
        at = min(int(places[k]) if k < len(places) else len(ids), last + MOST, len(ids))
        out.append(at)
        last = at
    if last < len(ids):
        out.append(len(ids))
    return out


def pack(ids: np.ndarray) -> bytes:
    small = not len(ids) or int(ids.max()) < 65536
    return (b"\x02" + ids.astype("<u2").tobytes()) if small else (b"\x04" + ids.astype("<u4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _leaf(x: bytes) -> bytes:
    return hashlib.blake2b(b"\x00" + x, digest_size=16).digest()


def _node(a: bytes, b: bytes) -> bytes:
    return hashlib.blake2b(b"\x01" + a + b, digest_size=16).digest()


class Merkle:
    """A binary hash tree grown leaf by leaf; holds one root for each power of two, whatever the number of leaves.

    An odd node goes up as it is; leaves and nodes are hashed apart.
    """

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, node: bytes, size: int = 1) -> None:
        """Append a perfect subtree of ``size`` leaves, not larger than the last one."""
        while self.peaks and self.peaks[-1][0] == size:
            node, size = _node(self.peaks.pop()[1], node), 2 * size
        self.peaks.append((size, node))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.blake2b(b"", digest_size=16).digest()
        out = self.peaks[-1][1]
        for _, peak in self.peaks[-2::-1]:
            out = _node(peak, out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the tree over ``leaves``."""
    tree = Merkle()
    for x in leaves:
        tree.add(_leaf(x))
    return tree.root()


#: Documents of a part whose subtree is checked together, a power of two.
SUBTREE = 4096

CONTENT = "kind string, key binary, id {0}, n_tokens long, digests array<binary>, sizes array<long>, root binary, data binary"


def _encode(path: str, end: int, proof, id_type: pa.DataType):
    """Arrow function: (id, text) to a recipe row for each document and a row for each chunk that is new to this task."""
    schema = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("id", id_type), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("root", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, row, task = encoder(path, proof), set(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, j, ids, heads in enc.encode(batch.column(1)):
                n = np.diff(heads)
                places = np.arange(len(ids)) + np.repeat(np.arange(j - i), n)
                full = np.full(len(ids) + j - i, end, np.uint32)
                full[places] = ids
                starts = heads + np.arange(j - i + 1)
                hashes = rolling(full)
                packed_small = full.astype("<u2").tobytes() if full.max() < 65536 else None
                recipes, chunks = [], []
                for r in range(j - i):
                    lo, hi = int(starts[r]), int(starts[r + 1])
                    digests, sizes, last = [], [], 0
                    for at in cut(full[lo:hi], hashes[lo:hi]):
                        data = b"\x02" + packed_small[2 * (lo + last) : 2 * (lo + at)] if packed_small else pack(full[lo + last : lo + at])
                        d = digest(data)
                        digests.append(d)
                        sizes.append(at - last)
                        last = at
                        if d not in seen:
                            seen.add(d)
                            chunks.append((d, data))
                    if len(seen) > 500_000:
                        seen.clear()
                    recipes.append((task.to_bytes(8, "big") + row.to_bytes(8, "big"), hi - lo, digests, sizes, merkle(digests)))
                    row += 1
                k, m = len(recipes), len(chunks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["recipe"] * k + ["chunk"] * m),
                        pa.array([x[0] for x in recipes] + [x[0] for x in chunks], pa.binary()),
                        pa.concat_arrays([batch.column(0).slice(i, k), pa.nulls(m, id_type)]),
                        pa.array([x[1] for x in recipes] + [None] * m, pa.int64()),
                        pa.array([x[2] for x in recipes] + [None] * m, pa.list_(pa.binary())),
                        pa.array([x[3] for x in recipes] + [None] * m, pa.list_(pa.int64())),
                        pa.array([x[4] for x in recipes] + [None] * m, pa.binary()),
                        pa.array([None] * k + [x[1] for x in chunks], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _running(id_type: pa.DataType):
    """Arrow function over one part in order: adds the part, the place in it and the ids before, and closes it with a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, pos, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        for batch in batches:
            m, n = batch.num_rows, batch.column("n_tokens").to_numpy()
            starts = total + np.cumsum(n) - n
            for root in batch.column("root").to_pylist():
                tree.add(_leaf(root))
            batch = batch.append_column("local_start", pa.array(starts, pa.int64())).append_column("part", pa.array(np.full(m, part), pa.int64()))
            yield batch.append_column("pos", pa.array(np.arange(pos, pos + m), pa.int64())).append_column("kind", pa.array(["document"] * m, pa.string()))
            total, pos = total + int(n.sum()), pos + m
        if pos:
            last = [pa.nulls(1, id_type), pa.array([total], pa.int64()), pa.nulls(1, pa.list_(pa.binary())), pa.nulls(1, pa.list_(pa.int64())), pa.array([tree.root()], pa.binary()), pa.array([total], pa.int64()), pa.array([part], pa.int64()), pa.array([pos], pa.int64()), pa.array(["part"])]
            yield pa.RecordBatch.from_arrays(last, names=["id", "n_tokens", "digests", "sizes", "root", "local_start", "part", "pos", "kind"])

    return run


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Root of each group of up to ``SUBTREE`` documents, given with their places."""
    for batch in batches:
        roots = [merkle([x["root"] for x in sorted(docs, key=lambda x: x["pos"])]) for docs in batch.column("docs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("nth"), batch.column("n"), pa.array(roots, pa.binary())], names=["part", "nth", "n", "root"])


def _same_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the subtrees of each part give the root that the manifest names for it."""
    for batch in batches:
        same = []
        for subtrees, docs, root in zip(batch.column("subtrees").to_pylist(), batch.column("n_docs").to_pylist(), batch.column("root").to_pylist(), strict=True):
            tree = Merkle()
            subtrees = sorted(subtrees, key=lambda x: x["nth"])
            for x in subtrees[:-1]:
                tree.add(x["root"], SUBTREE)
            # what stands in the last, smaller group comes after all whole ones
            tree.peaks.append((0, subtrees[-1]["root"])) if subtrees[-1]["n"] < SUBTREE else tree.add(subtrees[-1]["root"], SUBTREE)
            same.append(tree.root() == root and sum(x["n"] for x in subtrees) == docs)
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(same, pa.bool_())], names=["part", "part_sound"])


class TokenStore:
    """A store at ``path``, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> TokenStore:
        """Encode all texts, id ``end`` after each, and store them.

        Chunks are cut by content: equal passages of ids give equal chunks
        wherever they stand, and a chunk is stored once. Chunk rows and recipe
        rows go through one shuffle by digest, in which repeats fall away, and
        are written side by side; recipes, which hold no ids, are then put in
        ascending order of id (nulls first). Nothing is kept outside the store.
        A null text is empty and has only the end id; rows that repeat are
        documents of their own with the same chunks; other columns aren't read.
        """
        from pyspark.sql.pandas.types import to_arrow_type

        id_field = docs.schema[id_col].dataType
        proof = self.spark.sparkContext.broadcast(Proof(tokenizer))
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        schema = CONTENT.format(id_field.simpleString())
        content = rows.mapInArrow(_encode(tokenizer, end, proof, to_arrow_type(id_field)), schema)
        content = content.dropDuplicates(["kind", "key"])
        content.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{self.path}/content")
        recipes = self._content(schema).where("kind = 'recipe'").select("id", "key", "n_tokens", "digests", "sizes", "root")
        ordered = recipes.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "root", "key").drop("key")
        schema = f"id {id_field.simpleString()}, n_tokens long, digests array<binary>, sizes array<long>, root binary, local_start long, part long, pos long, kind string"
        ordered.mapInArrow(_running(to_arrow_type(id_field)), schema).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/recipes")
        parts = self._recipes().where("kind = 'part'").select("part", F.col("pos").alias("n_docs"), "n_tokens", "root")
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        got = [bytes(r.root) for r in parts.select("root", "part").orderBy("part").collect()]  # one row a file
        parts.withColumns({"start": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "store_root": F.lit(merkle(got))}).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")
        return self

    def _content(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/content")

    def chunks(self) -> DataFrame:
        return self.spark.read.schema("digest binary, key binary, data binary, kind string").parquet(f"{self.path}/content").where("kind = 'chunk'").select(F.col("key").alias("digest"), "data")

    def _recipes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/recipes")

    def recipes(self) -> DataFrame:
        return self._recipes().where("kind = 'document'").drop("kind")

    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def _placed(self) -> DataFrame:
        """Recipes with the ids before each document; the manifest has one row a file and is broadcast."""
        return self.recipes().join(F.broadcast(self.manifest().select("part", F.col("start").alias("part_start"))), "part", "left").withColumn("start", F.col("part_start") + F.col("local_start"))

    def sound_parts(self) -> DataFrame:
        """``(part, part_sound)``: whether the roots of each part's documents give its root in the manifest, and those of all parts the store's."""
        manifest = self.manifest()
        rows = manifest.select("part", "root", "store_root").orderBy("part").collect()  # one row a file
        whole = all(bytes(r.store_root) == merkle([bytes(x.root) for x in rows]) for r in rows)
        groups = self.recipes().groupBy("part", F.floor(F.col("pos") / SUBTREE).alias("nth")).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("pos", "root")).alias("docs"))
        subtrees = groups.mapInArrow(_subtrees, "part long, nth long, n long, root binary").groupBy("part").agg(F.collect_list(F.struct("nth", "n", "root")).alias("subtrees"))
        out = subtrees.join(F.broadcast(manifest.select("part", "n_docs", "root")), "part").mapInArrow(_same_root, "part long, part_sound boolean")
        return out.withColumn("part_sound", F.col("part_sound") & F.lit(whole))

    def verified(self) -> DataFrame:
        """``(id, start, n_tokens, ids_crc32, verified)`` of every document, from the files alone.

        Each chunk is read once: its digest is computed anew and the checksum of
        its ids taken. Checksums of a document's chunks are combined into that of
        all its ids; no ids are shuffled, and a chunk that many documents hold is
        copied to several tasks. ``verified``: all chunks are there with the content
        their digests name, lengths agree, the recipe's digests give its Merkle root,
        and the manifest's roots are those of its documents (:meth:`sound_parts`).
        """
        scratch = Scratch(self.spark, "verify")
        placed = self._placed()
        facts = self.chunks().mapInArrow(_facts, "digest binary, n long, crc long, sound boolean")
        steps = placed.select("part", "pos", "digests", "sizes").mapInArrow(_steps, "part long, pos long, digest binary, size long, after long")
        named = self.recipes().select(F.explode("digests").alias("digest"))
        joined = spread_join(steps, facts, ["digest"], scratch, "chunks", "left", named).select("part", "pos", "size", "after", "n", "crc", "sound")
        shifted = joined.mapInArrow(_shift, "part long, pos long, size long, crc long, sound boolean")
        sums = shifted.groupBy("part", "pos").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("read"), F.min("sound").alias("sound"))
        roots = placed.select("part", "pos", "id", "start", "n_tokens", "digests", "root").mapInArrow(_rooted, f"part long, pos long, id {placed.schema['id'].dataType.simpleString()}, start long, n_tokens long, rooted boolean")
        out = roots.join(sums, ["part", "pos"], "left").join(F.broadcast(self.sound_parts()), "part", "left")
        good = F.coalesce(F.col("sound") & F.col("rooted") & F.col("part_sound") & (F.col("read") == F.col("n_tokens")), F.lit(False))
        return out.select("id", "start", "n_tokens", "ids_crc32", good.alias("verified"))

    def documents(self) -> DataFrame:
        """``(id, start, ids)``: every document put together again from its chunks."""
        steps = self._placed().select("part", "pos", "id", "start", F.posexplode("digests").alias("nth", "digest"))
        joined = steps.join(self.chunks(), "digest", "left").groupBy("part", "pos", "id", "start").agg(F.array_sort(F.collect_list(F.struct("nth", "data"))).alias("chunks"))
        id_type = joined.schema["id"].dataType.simpleString()
        return joined.select("id", "start", F.transform("chunks", lambda c: c["data"]).alias("chunks")).mapInArrow(_joined, f"id {id_type}, start long, ids array<long>")


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, data = batch.column("digest").to_pylist(), batch.column("data").to_pylist()
        ids = [unpack(d) for d in data]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(list(map(len, ids)), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([digest(d) == n for d, n in zip(data, names, strict=True)], pa.bool_())], names=["digest", "n", "crc", "sound"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each document, with the ids after it in the document."""
    for batch in batches:
        lists = batch.column("digests")
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        sizes = batch.column("sizes").flatten().to_numpy()
        row = np.repeat(np.arange(len(counts)), counts)
        upto = np.cumsum(sizes)
        last = np.cumsum(counts) - 1
        after = upto[last][row] - upto if len(row) else upto
        yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(row)), batch.column("pos").take(pa.array(row)), flat, pa.array(sizes, pa.int64()), pa.array(after, pa.int64())], names=["part", "pos", "digest", "size", "after"])


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the one of crc32, bits reflected."""
    a, b, out = a.astype(np.uint32), b.astype(np.uint32), np.zeros(len(a), np.uint32)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What a checksum adds to that of a longer text in which so many bytes follow."""
    out, n = crc.astype(np.uint32), zeros.astype(np.uint64).copy()
    power = np.array([1 << 30], np.uint32)
    for _ in range(3):
        power = _times(power, power)
    while n.any():
        odd = (n & np.uint64(1)).astype(bool)
        out[odd] = _times(out[odd], np.repeat(power, int(odd.sum())))
        power, n = _times(power, power), n >> np.uint64(1)
    return out


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, n = batch.column("size").to_numpy(), batch.column("n").fill_null(-1).to_numpy()
        sound = batch.column("sound").fill_null(False).to_numpy(zero_copy_only=False) & (size == n)
        crc = shift_crc(batch.column("crc").fill_null(0).to_numpy(), 4 * batch.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("pos"), batch.column("size"), pa.array(crc.astype(np.int64)), pa.array(sound)], names=["part", "pos", "size", "crc", "sound"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [merkle(d) == r for d, r in zip(batch.column("digests").to_pylist(), batch.column("root").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(same, pa.bool_())], names=[*batch.schema.names[:5], "rooted"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.concatenate([unpack(c) for c in chunks]).tolist() for chunks in batch.column("chunks").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["id", "start", "ids"])
