"""Byte-level BPE ids of many texts: pre-tokens are cut in NumPy, whole tokens are looked up and only the rest is merged.

The library named by the tokenizer file makes every id. What is saved is repeated
work: a pre-token (the pieces that byte-level BPE never merges across) always
encodes alike, so its ids are remembered. Pre-tokens are told apart by their bytes
(:func:`paraweft.llm.words.identity`); a hash only says where to look. Only texts
with a character beyond the three planes whose classes are proven, or with an
added token's string, go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paraweft.llm import words as W

_LETTER, _DIGIT, _OTHER, _SPACE = 0, 1, 2, 3
#: Code points whose classes are proven: the three planes that hold nearly all assigned characters.
PROVEN = 0x30000
#: Bits of the number of slots for whole tokens and for learned pieces, and ids that a learned piece may have to be held.
SLOTS, LEARNED, HELD = 18, 20, 6


def classes(library) -> np.ndarray:
    """The class of each proven code point, found by having the library cut it after a letter and after a digit.

    ``a`` and the character are one piece if it is a letter; the character and ``!``
    are one if it is neither letter, digit nor white space; of the others, those
    that stay with a digit before them are digits.
    """
    cut = library.pre_tokenizer.pre_tokenize_str
    out = np.full(PROVEN, _SPACE, np.uint8)
    step = 0x4000
    for base in range(0, PROVEN, step):
        points = np.array([c for c in range(base, base + step) if not 0xD800 <= c < 0xE000])
        ends = np.zeros(4 * len(points) + 1, np.int64)
        for _, (a, b) in cut("".join(f"a{chr(c)}!\n" for c in points.tolist())):
            ends[a] = b
        place = 4 * np.arange(len(points))
        letter, other = ends[place] == place + 2, ends[place + 1] == place + 3
        out[points[letter]], out[points[other & ~letter]] = _LETTER, _OTHER
        rest = points[~letter & ~other]
        ends = np.zeros(3 * len(rest) + 1, np.int64)
        for _, (a, b) in cut("".join(f"1{chr(c)}\n" for c in rest.tolist())) if len(rest) else []:
            ends[a] = b
        place = 3 * np.arange(len(rest))
        out[rest[ends[place] == place + 2]] = _DIGIT
    out[0x20] = _SPACE  # the one character that goes with the ``!`` after it without being of its kind
    return out


def kinds(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to; 255 beyond the proven ones."""
    out = table[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        last = len(data) - 1
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | (data[np.minimum(lead[more] + k, last)] & 0x3F)
        kind = np.where(point < PROVEN, table[np.minimum(point, PROVEN - 1)], 255).astype(np.uint8)
        out[lead] = kind
        for k in (1, 2, 3):
            more = (size > k) & (lead + k <= last)
            out[lead[more] + k] = kind[more]
    return out


def cut(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, by the rule of byte-level BPE, from the class of each byte's character.

    A run of letters, of digits or of other signs is a piece, with one space
    before it if there is one. Of white space, the last character is parted from
    the rest, unless it ends the text. An apostrophe that begins a piece of its
    own takes s, t, m, d, re, ve or ll after it. Pieces tile the text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    rows = offsets[:-1][offsets[:-1] < n]
    first = np.zeros(n + 1, bool)
    first[rows] = True
    first[n] = True
    edge |= first[:n]
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    k = kind[start]
    ends_row = first[end]
    space = k == _SPACE
    opens = space & ~ends_row  # white space before a piece of the same text
    attached = np.zeros(len(start), bool)
    attached[1:] = opens[:-1] & (data[end[:-1] - 1] == 0x20)
    mark = np.zeros(n + 1, bool)
    mark[start[~attached]] = True
    final = end[opens] - 1
    for _ in range(3):  # the first byte of the last white character
        final = final - ((data[final] & 0xC0) == 0x80)
    mark[final] = True
    lone = np.flatnonzero((k == _OTHER) & ~attached & (end - start == 1) & (data[start] == 0x27) & ~ends_row)
    lone = lone[k[np.minimum(lone + 1, len(k) - 1)] == _LETTER]
    if len(lone):
        at, stop = start[lone + 1], end[lone + 1]
        one, two = data[at], data[np.minimum(at + 1, n - 1)]
        two = np.where(stop - at > 1, two, 0)
        took = np.where(np.isin(one, list(b"stmd")), 1, np.where(((two == 0x65) & np.isin(one, list(b"rv"))) | ((one == 0x6C) & (two == 0x6C)), 2, 0))
        hit = took > 0
        mark[at[hit]] = False
        rest = hit & (at + took < stop)
        mark[(at + took)[rest]] = True
    return np.flatnonzero(mark[:n])


class Table:
    """Pieces by some bits of a hash of their identity; each slot holds one piece and its ids."""

    def __init__(self, bits: int, held: int, kind: type, shift: int):
        self.shift, self.mask = np.uint64(shift), np.uint64((1 << bits) - 1)
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.n = np.zeros(1 << bits, np.uint8)
        self.ids = np.zeros((1 << bits, held), kind)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift & self.mask).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each piece, and whether it holds the piece."""
        at = self._slot(h)
        return at, (self.low[at] == low) & (self.high[at] == high) & (self.n[at] > 0)

    def put(self, low: np.ndarray, high: np.ndarray, h: np.ndarray, n: np.ndarray, ids: np.ndarray, replace: bool) -> np.ndarray:
        """Hold pieces, in place of what their slots held if ``replace``; returns those that found no slot."""
        at = self._slot(h)
        free = np.arange(len(at)) if replace else np.flatnonzero(self.n[at] == 0)
        _, one = np.unique(at[free], return_index=True)
        taken = free[one]
        self.low[at[taken]], self.high[at[taken]], self.n[at[taken]], self.ids[at[taken]] = low[taken], high[taken], n[taken], ids[taken]
        return np.setdiff1d(np.arange(len(at)), taken)


class Proof:
    """What is proven of a tokenizer file once, and broadcast: classes of characters, and whole tokens by identity."""

    def __init__(self, path: str):
        enc = Encoder(path)
        self.plain = enc.plain
        none = np.zeros(0, np.uint64)
        self.table, self.low, self.high, self.ids = np.zeros(0, np.uint8), none, none, np.zeros(0, np.uint32)
        if self.plain:
            self.table = classes(enc.library)
            self.low, self.high, self.ids = enc.whole_tokens()


class Encoder:
    """Ids of texts by a tokenizer file; a worker keeps tables of a fixed size (some 45 MB) for its life."""

    def __init__(self, path: str, proof: Proof | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and pre.get("add_prefix_space") is False and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
        self._bytes = None
        self.whole: list[Table] = []
        if proof is None or not self.plain:
            return
        self.table = proof.table
        low, high, ids = proof.low, proof.high, proof.ids
        for shift in (64 - SLOTS, 64 - 2 * SLOTS, 64 - 3 * SLOTS):  # a token whose slot is taken goes to the next table
            t = Table(SLOTS, 1, np.uint32, shift)
            left = t.put(low, high, W.folded(low, high), np.ones(len(ids), np.uint8), ids[:, None], False)
            low, high, ids = low[left], high[left], ids[left]
            self.whole.append(t)
        small = self.library.get_vocab_size() <= 1 << 16
        self.learned = Table(LEARNED, HELD, np.uint16 if small else np.uint32, 64 - LEARNED)

    def whole_tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Identity and id of the vocabulary strings that the library encodes alone as one token."""
        size = self.library.get_vocab_size(with_added_tokens=False)
        texts = self.library.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
        texts = [t for t in texts if t and "�" not in t and t not in self.added]
        single = [(t, e.ids[0]) for t, e in zip(texts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]
        data, offsets = W.strings(pa.array([t for t, _ in single], pa.string()))
        low, high = W.identity(data, offsets[:-1], offsets[1:])
        return low, high, np.array([i for _, i in single], np.uint32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in one array and the number of each piece's.

        Pieces with a space in front are encoded in one text: the cut parts it
        again where they were joined, and as tokens tile the bytes, their lengths
        tell whose they are. If a piece's end isn't a token's end, each goes alone.
        """
        spaced = [len(t) > 1 and t[0] == " " and t[1] != " " and not t.isspace() for t in texts]
        joined = [t for t, s in zip(texts, spaced, strict=True) if s]
        alone = [e.ids for e in self.library.encode_batch_fast([t for t, s in zip(texts, spaced, strict=True) if not s], add_special_tokens=False)]
        lens = np.zeros(len(texts), np.int32)
        is_spaced = np.array(spaced, bool)
        lens[~is_spaced] = list(map(len, alone))
        one = np.array(self.library.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, np.uint32)
        done = np.cumsum(self._widths()[one])
        ends = np.cumsum([len(t.encode()) for t in joined])
        at = np.searchsorted(done, ends)
        if len(joined) and not (len(done) and done[-1] == ends[-1] and np.array_equal(done[at], ends)):
            got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], np.uint32), np.array(list(map(len, got)), np.int32)
        lens[is_spaced] = np.diff(at + 1, prepend=0)
        flat = np.empty(int(lens.sum()), np.uint32)
        of_spaced = np.repeat(is_spaced, lens)
        flat[of_spaced] = one
        flat[~of_spaced] = [i for ids in alone for i in ids]
        return flat, lens

    def _widths(self) -> np.ndarray:
        """Bytes of each token of the vocabulary: byte-level BPE writes each byte as one character."""
        if self._bytes is None:
            self._bytes = np.zeros(self.library.get_vocab_size(), np.int64)
            for token, i in self.library.get_vocab().items():
                self._bytes[i] = len(token)
        return self._bytes

    def _pieces(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece and, if wanted, all their ids in order.

        Whole tokens count one by the proven tables; others come from what was
        learned; each distinct one of the rest is merged by the library, once.
        """
        low, high = W.identity(data, begin, end)
        h = W.folded(low, high)
        n, rest = np.ones(len(low), np.int64), np.arange(len(low))
        first = np.zeros(len(low), np.uint32)
        for t in self.whole:
            at, hit = t.find(low[rest], high[rest], h[rest])
            first[rest[hit]] = t.ids[at[hit], 0]
            rest = rest[~hit]
        many = []  # pieces, their lengths and all their ids
        at, hit = self.learned.find(low[rest], high[rest], h[rest])
        lens = self.learned.n[at[hit]].astype(np.int64)
        n[rest[hit]] = lens
        if want:
            many.append((rest[hit], lens, self.learned.ids[at[hit]][np.arange(HELD) < lens[:, None]]))
        rest = rest[~hit]
        if len(rest):
            order = rest[np.lexsort((low[rest], high[rest]))]
            new = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
            one, back = order[new], np.cumsum(new) - 1
            raw = data.tobytes()
            flat, lens = self._ids([raw[b:e].decode() for b, e in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
            lens = lens.astype(np.int64)
            heads, of = np.cumsum(lens) - lens, lens[back]
            n[order] = of
            if want:
                starts = np.cumsum(of) - of
                many.append((order, of, flat[np.repeat(heads[back] - starts, of) + np.arange(of.sum())]))
            fit = np.flatnonzero(lens <= HELD)
            padded = np.zeros((len(fit), HELD), np.uint32)
            padded[np.arange(HELD) < lens[fit, None]] = flat[np.repeat(lens <= HELD, lens)]
            self.learned.put(low[one[fit]], high[one[fit]], h[one[fit]], lens[fit], padded, True)
        if not want:
            return n, first[:0]
        starts = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), np.uint32)
        single = np.ones(len(n), bool)
        for pieces, lens, flat in many:
            single[pieces] = False
            ids[np.repeat(starts[pieces] - np.cumsum(lens) + lens, lens) + np.arange(len(flat))] = flat
        ids[starts[single]] = first[single]
        return n, ids

    def _blocks(self, column: pa.Array, want: bool):
        """For each block of rows: its range, the row, number and all ids of its pieces, and the rows that go to the library whole."""
        data, offsets = W.strings(column)
        special = np.zeros(len(column), bool)
        for token in self.added:
            special |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        for i, j in W.blocks(offsets):
            d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            whole = special[i:j].copy() if self.plain else np.ones(j - i, bool)
            row, n, ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
            if self.plain:
                kind = kinds(d, self.table)
                whole[np.searchsorted(o, np.flatnonzero(kind == 255), "right") - 1] = True
                begin = cut(d, o, kind)
                row = np.searchsorted(o, begin, "right") - 1
                use = ~whole[row]
                end = np.append(begin[1:], len(d))[use] if len(begin) else begin
                row = row[use]
                if len(row):
                    n, ids = self._pieces(d, begin[use], end, want)
            yield i, j, row, n, ids, np.flatnonzero(whole)

    def _library(self, column: pa.Array, r: int) -> np.ndarray:
        return np.array(self.library.encode(column[r].as_py() or "", add_special_tokens=False).ids, np.uint32)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(column), np.int64)
        for i, j, row, n, _, whole in self._blocks(column, False):
            out[i:j] = np.bincount(row, n, minlength=j - i)
            for r in whole.tolist():
                out[i + r] = len(self._library(column, i + r))
        return out

    def encode(self, column: pa.Array):
        """Ids of consecutive texts: all ids of some rows in one array and where each row's begin and the last's end."""
        for i, j, row, n, ids, whole in self._blocks(column, True):
            sizes = np.bincount(row, n, minlength=j - i).astype(np.int64)
            heads = np.concatenate([[0], np.cumsum(sizes)])
            if len(whole):
                parts = [ids[heads[r] : heads[r + 1]] for r in range(j - i)]
                for r in whole.tolist():
                    parts[r] = self._library(column, i + r)
                ids = np.concatenate(parts)
                heads = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            yield i, j, ids, heads


_encoders: dict[str, Encoder] = {}


def encoder(path: str, proof) -> Encoder:
    """The worker's encoder of a file; ``proof`` is a broadcast :class:`Proof`. Its tables have a fixed size."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path, proof.value)
    return _encoders[path]
