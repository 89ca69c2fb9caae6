import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paraweft.llm import token_store as S
from paraweft.llm.token_counts import token_counts
from paraweft.llm.token_store import TokenStore
from paraweft.llm.tokens import Encoder, Proof
from paraweft.scratch import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["<|endoftext|>", " ", "  ", "\n", " \n", "'s", "'re", "'LL", "it's", "'t", "'ve", "12", "é", "!?", "a", "B", "x'", "''s", " '", "\t", "\r\n", "中", "×", "’", "'d", "ll", "'sa", "\x0b", " ", "the", " word", " Straße", "Ω", "🙂", "“", "”", "—", "…", "Жук", " Жу", "文字", "　", "\u2028", "\x85", "\x1f", "١٢", "²", "½", "ª", "\u0301", "👍🏽", "𝒳", "\u200b", "\ufeff", "\U0003abcd"]


def woven(k):
    """Thue-Morse strings of 2**k letters and their mirror, which sums of powers modulo a power of two can't tell apart."""
    s = "a"
    for _ in range(k):
        s += s.translate(str.maketrans("ab", "ba"))
    return [s, s.translate(str.maketrans("ab", "ba"))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    plain = [p for p in PIECES if p.isascii() and p not in ("<|endoftext|>", "\x0b")] + ["é"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for pool in (PIECES, plain) for _ in range(1500)] + [None, "", " ", "\n\n"] + [t.translate(str.maketrans("ab", cs)) for k in (4, 10, 11, 12) for t in woven(k) for cs in ("ab", "01")]


@pytest.fixture(scope="module")
def expected(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_equals_the_library(texts, expected):
    enc = Encoder(PATH, Proof(PATH))
    for _ in range(2):  # the second time all is remembered
        assert enc.counts(pa.array(texts, pa.string())).tolist() == [len(e) for e in expected]
        got = [ids[heads[r] : heads[r + 1]].tolist() for i, j, ids, heads in enc.encode(pa.array(texts, pa.string())) for r in range(j - i)]
        assert got == expected


def test_counts(docs_of, texts, expected):
    rows = {r.doc_id: r for r in token_counts(docs_of(texts), PATH, limit=20).collect()}
    for k, (t, e) in enumerate(zip(texts, expected, strict=True)):
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((t or "").encode()), len(e), len(e) > 20)
    assert token_counts(docs_of([]), PATH).count() == 0


def test_counts_of_sentencepiece_models(docs_of):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r.n_tokens for r in token_counts(docs_of(["Hello world", None, "", "été 中"]), path).collect()}
    assert rows == {k: len(model.encode(t)) for k, t in enumerate(["Hello world", "", "", "été 中"])}


def test_store_round_trip(spark, docs_of, texts, expected):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 999)) for _ in range(6000))
    rows = [(3 * k - 5, t, "en", "s") for k, t in enumerate([*texts[:200], None, long, long, "intro " + long])] + [(None, "no id", "en", "s"), (7, "twice", "en", "s")]
    store = TokenStore(spark, Scratch(spark, "store-test").root).write(docs_of(rows), PATH)
    lib = Tokenizer.from_file(PATH)
    want = sorted(((i, lib.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(store.documents().collect(), key=lambda r: r.start)
    assert [(r.id, r.ids) for r in got if r.id != 7] == [w for w in want if w[0] != 7]
    out = sorted(store.verified().collect(), key=lambda r: r.start)
    assert all(r.verified for r in out)
    at = 0
    for r, g in zip(out, got, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(g.ids), zlib.crc32(np.array(g.ids, "<u4").tobytes()))
        at += r.n_tokens
    digests = [bytes(r.digest) for r in store.chunks().collect()]
    named = {bytes(d) for r in store.recipes().collect() for d in r.digests}
    assert len(digests) == len(set(digests)) and set(digests) == named
    # the copies of the long text cost its chunks once, and the one with other words before it only some more
    chunks = {r.id: [bytes(d) for d in r.digests] for r in store.recipes().collect() if r.n_tokens > 5000}
    first, second, third = chunks.values()
    assert first == second and len(set(third) - set(first)) < len(first) / 2


def test_damage_is_noticed(spark, docs_of, tmp_path):
    made = Scratch(spark, "store-test").root
    store = TokenStore(spark, made).write(docs_of(["some words here", "other words there", "third one"]), PATH)
    assert all(r.verified for r in store.verified().collect())
    chunks, recipes, manifest = store.chunks(), store.recipes(), store.manifest()
    store.chunks = lambda: chunks.where("false").unionByName(chunks.limit(1))
    assert sorted(r.verified for r in store.verified().collect()) == [False, False, True]
    store.chunks = lambda: chunks
    one = recipes.orderBy("part", "pos").first()
    mine = f"part = {one.part} and pos = {one.pos}"
    other = recipes.where(f"not ({mine})").select("digests", "sizes", "n_tokens", "root").limit(1)
    # a recipe that names other chunks, and one that is another document's altogether: only the manifest can tell
    swapped = recipes.where(mine).drop("digests").crossJoin(other.select("digests"))
    store.recipes = lambda: recipes.where(f"not ({mine})").unionByName(swapped)
    assert not any(r.verified for r in store.verified().collect() if r.id == one.id)
    taken = recipes.where(mine).drop("digests", "sizes", "n_tokens", "root").crossJoin(other)
    store.recipes = lambda: recipes.where(f"not ({mine})").unionByName(taken)
    assert not any(r.verified for r in store.verified().collect() if r.id == one.id)
    store.recipes = lambda: recipes.where(f"not ({mine})")
    assert all(not r.verified for r in store.verified().collect() if store.recipes().where(f"part = {one.part}").count())
    store.recipes = lambda: recipes
    for column in ("root", "store_root"):
        store.manifest = lambda: manifest.withColumn(column, F.unhex(F.md5(column)))
        assert not any(r.verified for r in store.verified().collect())


def test_roots_do_not_depend_on_batches():
    rng = random.Random(8)
    for n in (1, 2, 3, 7, 8, 9, 31):
        leaves = [rng.randbytes(16) for _ in range(n)]
        level = [S._leaf(x) for x in leaves]
        while len(level) > 1:
            level = [S._node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert S.merkle(leaves) == level[0]
        tree = S.Merkle()
        for i in range(0, n - n % 4, 4):
            tree.add(S.merkle(leaves[i : i + 4]), 4)
        if n % 4:
            tree.peaks.append((0, S.merkle(leaves[n - n % 4 :])))
        assert tree.root() == level[0]


def test_empty_store(spark, docs_of):
    store = TokenStore(spark, Scratch(spark, "store-test").root).write(docs_of([]), PATH)
    assert store.verified().collect() == [] and store.documents().collect() == []


def test_checksums_combine():
    a, b = np.arange(50, dtype="<u4").tobytes(), np.arange(7, 900, dtype="<u4").tobytes()
    both = S.shift_crc(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
    assert int(both[0] ^ both[1]) == zlib.crc32(a + b)
