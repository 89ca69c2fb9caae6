import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
from test_decontamination import plain
from test_near_duplicates import sets_of
from tokenizers import Tokenizer

import corpus_pipeline
from paraweft.llm import queries


def test_every_stage_acts_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, sizes = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(after.count())
        if k < 3:  # filters keep rows as they are
            assert after.columns == docs.columns and after.exceptAll(before).count() == 0
        elif k == 3:
            assert after.columns == docs.columns and after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        else:
            assert after.where("verified").count() == before.count()
        before = after
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    # judged on labels, quality drops bad documents and next to no good ones
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = spark.read.parquet(str(tmp_path / "0")).select("doc_id")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    assert good.join(kept, "doc_id").count() >= 0.97 * good.count() and bad.join(kept, "doc_id").count() <= 0.1 * bad.count()


def test_near_dedup_decides_by_row(spark, docs_of):
    x, y, z, w, v = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyzwv")
    near = y.replace("y39", "other")
    rows = [(5, x, "en", "s"), (None, x, "en", "s"), (None, z, "en", "s"), (None, w, "en", "s"), (None, w + " end", "en", "s"), (None, None, "en", "s")]
    rows += [(0, v, "en", "s"), (1, y, "en", "s"), (1, v, "en", "s"), (2, y, "en", "s"), (2, near, "en", "s"), (2, y, "en", "t")]
    rows += [(3, "short text of five words", "en", "s"), (3, "short text of five words", "en", "s")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs_of(rows), "").collect()]
    ends = [t for i, t in got if i is None and t and t.startswith("w0")]
    assert len(ends) == 1
    assert sorted(((i, t) for i, t in got if t not in ends), key=str) == sorted([(5, x), (None, z), (None, None), (0, v), (1, y), (3, "short text of five words")], key=str)


def plain_dedup(rows):
    """Rows kept of (id, text): the least of each group of near-copies, by plain comparison of all."""
    keyed = sorted({(i is None, i if i is not None else 0, hashlib.sha256(t.encode()).digest() if t is not None else b"", t) for i, t in rows}, key=lambda k: k[:3])
    sets = [sets_of(k[3], 5) for k in keyed]
    root = list(range(len(keyed)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keyed)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((None if k[0] else k[1]), k[3]) for n, k in enumerate(keyed) if find(n) == n)


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_stages_equal_plain_versions(spark, docs_of, tmp_path):
    """Near-dedup, decontamination, mixing and token ids on a small table, each against a plain version on its own input."""
    rng = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("ra", "to", "mi", "ke", "su", "lo") for b in ("ven", "dor", "pal", "nix", "gar")]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 20))) for _ in range(6)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = []
    for k in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        if k % 5 == 0:
            item = items[k % 6].split()
            for _ in range(rng.randint(0, len(item) // 2)):
                item[rng.randrange(len(item))] = rng.choice(vocabulary)
            w[5:5] = item
        if k % 3 == 0 and texts:
            w = rng.choice(texts).split()
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(k, t, "en", f"src{k % 3}") for k, t in enumerate(texts)]
    sf_dir = str(tmp_path)

    kept = corpus_pipeline.near_dedup(spark, docs_of(rows), sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == plain_dedup([(i, t) for i, t, _, _ in rows])

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept]
    clean = corpus_pipeline.decontamination(spark, docs_of(rows), sf_dir).collect()
    held = {i for i, t, _, _ in rows if any(plain(words_of(item), words_of(t)) >= len(words_of(item)) for item in items)}
    assert held and sorted(r.doc_id for r in clean) == sorted(i for i, *_ in rows if i not in held)

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in clean]
    mix = corpus_pipeline.mixing(spark, docs_of(rows), sf_dir).collect()
    sizes = {i: len(t.split()) for i, t, _, _ in rows}
    total = {s: sum(sizes[i] for i, _, _, x in rows if x == s) for s in sorted({s for *_, s in rows})}
    weight, target, left = dict(zip(total, (3, 1, 2))), {}, 1.5 * sum(total.values())
    while True:  # reshare what is above twice a source's size
        level = left / sum(weight[s] for s in total if s not in target)
        full = [s for s in total if s not in target and weight[s] * level > 2 * total[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
    target |= {s: weight[s] * level for s in total if s not in target}
    taken = {}
    for s in total:
        words, order = int(target[s]), sorted((i for i, _, _, x in rows if x == s), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
        whole, rest = divmod(words, total[s])
        for i in order:
            taken[i] = whole * sizes[i] + min(rest, sizes[i])
            rest -= min(rest, sizes[i])
    got = {}
    for r in mix:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and next(t for i, t, _, _ in rows if i == r.doc_id).startswith(r.text)
    assert got == {i: n for i, n in taken.items() if n}

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in mix]
    out = sorted(corpus_pipeline.token_ids(spark, docs_of(rows), sf_dir).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    ids = {}
    for i, t, _, _ in rows:
        e = library.encode(t, add_special_tokens=False).ids + [0]
        ids.setdefault(i, []).append((len(e), zlib.crc32(np.array(e, "<u4").tobytes())))
    assert [r.doc_id for r in out] == sorted(i for i, *_ in rows)
    for r in out:
        assert r.start == at and r.verified and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        at += r.n_tokens


def test_stages_take_odd_rows(spark, docs_of, sf):
    """Nulls, blanks, repeats, a very long text, columns with clashing names, and an empty table."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    odd = [(None, None, None, None), (1, "", None, "s"), (2, " \n ", "en", None), (3, long, "en", "s"), (3, long, "en", "s"), (None, "a null id with words of its own", "en", "s"), (4, "short", None, None), (4, "another text of the same id", "de", "t")]
    left = {"quality classifier": None, "MinHash near-dedup": 7, "benchmark decontamination": 8, "mixing sources to target weights": None, "token-ID output": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_of(odd), sf)
        rows = out.collect()
        assert left[name] is None or len(rows) == left[name], name
        assert stage(spark, docs_of([]), sf).collect() == [], name
        if name != "token-ID output":
            assert out.columns == corpus_pipeline.COLUMNS
        else:
            assert all(r.verified for r in rows)


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
