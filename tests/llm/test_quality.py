import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraweft.llm.quality import FEATURES, STRONGEST, WEAKEST, classify, features, fit, train, url_levels
from paraweft.llm.words import strings, words

import pyarrow as pa


def texts(n=200):
    rng = random.Random(3)
    pool = ["river", "stone", "about", "never", "small", "green", "house", "walked", "because", "with"]
    out = []
    for k in range(n):
        w = [rng.choice(pool) for _ in range(rng.randint(15, 60))]
        if k % 4 == 0:
            w = [x.upper() + "!!" for x in w] if k % 8 else ["buy%%%"] * len(w)
        out.append((k, " ".join(w), "en", f"host{k % 3}"))
    return out


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_bad_texts_go_and_good_ones_stay(spark, docs_of):
    rows = texts()
    labels = labels_of(spark, [(i, int(i % 4 != 0), 0) for i, *_ in rows if i % 2 == 0 or i % 3 == 0] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)])
    out = classify(docs_of(rows), labels, sites=[F.col("source"), F.col("lang")])
    assert out.columns[: len(docs_of([]).columns)] == docs_of([]).columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(got[i].kept == (i % 4 != 0) for i, *_ in rows)
    assert all(0 <= r.score <= 1 and 0 < r.site_prior < 1 for r in got.values())


def test_sparse_sites_lean_on_their_parents(spark, docs_of):
    rows = [(i, t, "en", "bad" if i % 4 == 0 else "good") for i, t, *_ in texts()] + [(1000, "river stone about never small green house walked because with", "en", "new")]
    labels = labels_of(spark, [(i, int(i % 4 != 0), 0) for i, *_ in rows[:-1]])
    got = {r.doc_id: r for r in classify(docs_of(rows), labels, sites=[F.col("source")]).collect()}
    assert got[0].site_prior < 0.4 < got[1000].site_prior < got[1].site_prior


def plain(rows, odds):
    """Posterior site priors and scores of (id, (site of each level), odds) in plain Python."""
    p = [1 / (1 + math.exp(-o)) for o in odds]
    mean = sum(p) / len(p)
    depth = len(rows[0])
    above, strength, groups = {(): mean}, [], []
    for k in range(depth):
        sums = {}
        for site, x in zip(rows, p, strict=True):
            sums.setdefault(site[: k + 1], []).append(x)
        many = {s: v for s, v in sums.items() if len(v) > 1}
        total = sum(map(len, many.values()))
        between = sum(len(v) * (sum(v) / len(v) - above[s[:-1]]) ** 2 for s, v in many.items())
        chance = sum((sum(x * x for x in v) - sum(v) ** 2 / len(v)) / (len(v) - 1) for v in many.values())
        spread = sum(len(v) * above[s[:-1]] * (1 - above[s[:-1]]) for s, v in many.items())
        beyond = (between - chance) / total if total else 0
        strength.append(STRONGEST if beyond <= 0 else min(max(spread / total / beyond - 1, WEAKEST), STRONGEST))
        above = {s: (sum(v) + strength[k] * above[s[:-1]]) / (len(v) + strength[k]) for s, v in sums.items()}
        groups.append(sums)
    out = []
    for site, x, o in zip(rows, p, odds, strict=True):
        prior = mean
        for k in range(depth):
            v = groups[k][site[: k + 1]]
            prior = (sum(v) - x + strength[k] * prior) / (len(v) - 1 + strength[k])
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        out.append((prior, 1 / (1 + math.exp(-(o + math.log(prior / (1 - prior)) - math.log(mean / (1 - mean)))))))
    return out


def test_posteriors_equal_plain_ones(spark, docs_of):
    rng = random.Random(6)
    urls = [f"https://www.Host{rng.randrange(4) ** 2}.org:80/a{rng.randrange(3)}/b{rng.randrange(3)}/page{k}?q=/x/" for k in range(200)]
    rows = [(i, t, "en", u) for (i, t, _, _), u in zip(texts(), urls, strict=True)]
    labels = labels_of(spark, [(i, int(i % 4 != 0), 0) for i, *_ in rows if i % 3 == 0])
    docs = docs_of(rows)
    out = {r.doc_id: r for r in classify(docs, labels, sites=url_levels(F.col("source"))).collect()}
    sites = [tuple(re.match(r"https://www\.(\w+)\.org:80/(\w+)/(\w+)/", u.lower()).groups()) for u in urls]
    data, offsets = strings(pa.array([t for _, t, _, _ in rows]))
    odds = train(docs, labels, "doc_id", "text", "quality").odds(data, offsets)
    for (i, *_), o, (prior, score) in zip(rows, odds, plain(sites, odds.tolist()), strict=True):
        assert out[i].evidence == pytest.approx(1 / (1 + math.exp(-o))) and out[i].site_prior == pytest.approx(prior) and out[i].score == pytest.approx(score)


def test_levels_of_urls(spark):
    df = spark.createDataFrame([("https://me@WWW.a.org:8/x/y/z.html?u=/v/w/",), ("b.org/x",), ("http://c.org",), (None,)], "u string")
    assert [tuple(r) for r in df.select(*url_levels(F.col("u"))).collect()] == [("a.org", "/x", "/x/y"), ("b.org", "", ""), ("c.org", "", ""), (None, None, None)]


def test_words_tell_what_shape_does_not(spark, docs_of):
    rng = random.Random(12)
    pool = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in "nrst"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(40)) + (" viral" if k % 3 == 0 else " sound") + " clip", "en", "s") for k in range(300)]
    labels = labels_of(spark, [(i, int(i % 3 != 0), 0) for i, *_ in rows if i < 200])
    got = {r.doc_id: r.evidence for r in classify(docs_of(rows), labels).collect()}
    assert max(got[i] for i in range(200, 300) if i % 3 == 0) < min(got[i] for i in range(200, 300) if i % 3)


def test_edges(spark, docs_of):
    docs = docs_of([(1, None, None, None), (1, "", "en", None), (None, "plain words", None, "s"), (None, "plain words", None, "s")])
    nothing = labels_of(spark, [])
    out = classify(docs, nothing, sites=[F.col("source"), F.col("lang")]).collect()
    assert len(out) == 4 and all(r.evidence == pytest.approx(0.5) and r.kept for r in out)
    assert classify(docs_of([]), nothing).count() == 0
    one_kind = classify(docs, labels_of(spark, [(1, 1, 0)]), columns=["doc_id"])
    assert one_kind.columns == ["doc_id", "evidence", "site_prior", "score", "kept"] and one_kind.count() == 4


def test_features_of_known_texts():
    data, offsets = strings(pa.array(["aa aa bb", "", None, "AB!!\nAB!!"]))
    x = dict(zip(FEATURES, features(data, offsets, words(data, offsets)).T, strict=True))
    assert np.allclose(x["distinct_words"], [2 / 3, 1, 1, 0.5]) and np.allclose(x["repeated_word"], [0.5, 0, 0, 1])
    assert np.allclose(x["capitals"], [0, 0, 0, 1]) and np.allclose(x["symbol_tails"], [0, 0, 0, 1]) and np.allclose(x["distinct_lines"], [1, 1, 1, 0.5])


def test_fit_is_a_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.random((80, len(FEATURES) + 1)), rng.integers(0, 2, 80).astype(float)
    w = fit(x, y)
    from paraweft.llm.quality import expand

    z, ridge = expand(x), np.full(len(w), 1e-2)
    ridge[-1] = 1e-6
    p = 1 / (1 + np.exp(-z @ w))
    assert np.abs(z.T @ (p - y) + ridge * w).max() < 1e-6
