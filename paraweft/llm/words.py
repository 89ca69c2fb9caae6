"""Words and their 64-bit hashes straight from Arrow string buffers, with NumPy.

A word is a maximal run of bytes outside the space and U+0009..U+000D. Texts are
UTF-8, in which those bytes never occur inside another character, so the cut is
the same as on code points. No Python string is made for a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian load of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a run that are hashed in NumPy; a longer one by the library's digest.
_STRIDED = 256

#: 1 for bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII capitals to small letters, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in a row, and where each begins and the last ends; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes, at least one row each; rows are never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each maximal run of bytes for which ``stop`` is false."""
    inside = ~stop[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    cuts = offsets[1:-1]
    cuts = distinct(cuts[(cuts > 0) & (cuts < len(data))])
    joined = cuts[inside[cuts] & inside[cuts - 1]]  # runs that only the end of a row parts
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    begin, end = at[0::2], at[1::2]
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end are zeros."""
    held = np.zeros(len(data) + 24, np.uint8)
    held[: len(data)] = data
    return np.ndarray((len(data) + 16,), "<u8", held, strides=(1,))


def identity(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each run of bytes: the bytes themselves and their number up to 15, beyond that a 120-bit digest."""
    size, at = end - begin, _loads(data)
    low = at[begin] & _FIRST[np.minimum(size, 8)]
    high = (at[begin + 8] & _FIRST[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
    for i in np.flatnonzero(size > 15):
        d = hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=15).digest()
        low[i], high[i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | (255 << 56)
    return low, high


def folded(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of identities."""
    return mix(low * _ODD ^ mix(high + _ODD))


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, equal for equal runs.

    Eight bytes after eight are mixed in, each step over the runs that are still
    longer; runs of more than ``_STRIDED`` bytes are digested.
    """
    size, at = end - begin, _loads(data)
    h = folded(at[begin] & _FIRST[np.minimum(size, 8)], size.astype(np.uint64))
    rest = np.flatnonzero((size > 8) & (size <= _STRIDED))
    done = 8
    while len(rest):
        h[rest] = mix(h[rest] * _ODD + mix(at[begin[rest] + done] & _FIRST[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > _STRIDED):
        h[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (capitals A-Z made small), row, begin and end of each word."""
    data = LOWER[data]
    begin, end, row = spans(data, offsets)
    return hashes(data, begin, end), row, begin, end


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words of one row, and the index of its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    return sequence([h[first + k] for k in range(n)]), first


def sequence(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of words, given as one array for each place in it."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of n-word shingle hashes of all rows in one array, and where each row's set begins.

    A row with fewer than n words has the whole sequence as its one shingle; a row without words has none.
    """
    h, row, _, _ = words(data, offsets)
    rows = len(offsets) - 1
    counts = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    grams, first = ngrams(h, row, n)
    of = row[first] if len(first) else np.zeros(0, np.int64)
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        if len(short):
            grams = np.concatenate([grams, sequence([h[starts[short] + k] for k in range(size)])])
            of = np.concatenate([of, short])
    order = np.argsort(of, kind="stable")
    grams, of = grams[order], of[order]
    cut = np.searchsorted(of, np.arange(rows + 1))
    parts = [distinct(grams[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else grams), np.concatenate([[0], np.cumsum(sizes)])
