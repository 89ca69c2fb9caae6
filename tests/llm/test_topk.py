import math
import random

import numpy as np

from paraweft.llm import topk
from paraweft.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, label int, id string"


def plain(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        a = min(v for i, v in ok if i == q)
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(b) == len(a))
        out += [(q, n + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(best[:k])]
    return out


def got(spark, rows, every=5, k=3):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in top_k(df.repartition(3), every, k).select("query_id", "rank", "vec_id", "score").collect())


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(10)]) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(20)]  # ties
    assert got(spark, rows) == plain(rows, 5, 3)


def test_edges(spark):
    rows = [(0, [1.0, -0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.3, 0.3]), (5, [0.3, 0.3]), (6, [1.0]), (None, [1.0, 1.0]), (-10, [0.0, 0.0]), (10, [1.0]), (7, [])]
    assert got(spark, rows) == plain(rows, 5, 3)
    assert got(spark, []) == [] and got(spark, [(0, [1.0, 2.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(k, [2.0**22 + k, -3.0]) for k in range(12)]
    assert got(spark, rows) == plain(rows, 5, 3)


def test_components_of_any_size(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([-1, 1]) * 10.0 ** rng.choice([0, 3, 8, 12, 17, 100, 305]) for _ in range(3)]) for k in range(40)] + [(50, [1e307, 0.0, 0.0])]
    assert got(spark, rows) == plain(rows, 5, 3)


def test_rows_that_repeat_are_rows_of_their_own(spark):
    rows = [(k, [float(k), 1.0]) for k in range(6)] + [(3, [3.0, 1.0])] * 2 + [(0, [0.5, 1.0])] * 2 + [(5, [-1.0, 9.0])]
    assert got(spark, rows, k=5) == plain(rows, 5, 5)


def test_queries_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "BLOCK_BYTES", 6 * 8 * 4)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(60)]
    assert got(spark, rows) == plain(rows, 5, 3)


def test_few_scores_are_resolved():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    vectors = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 32))))
    block = topk.Block(np.arange(0, 4000, 50), vectors[::50], 5)
    ids, everything = np.arange(4000), slice(0, 80)
    block.cutoff[:] = block.gather(everything, ids, vectors)[:, 4]
    whole = block.vectors @ vectors.T
    whole[np.arange(80), np.arange(0, 4000, 50)] = -np.inf
    kth = -np.sort(-whole, axis=1)[:, 4]
    assert (block.cutoff <= kth).all()
    found = np.logical_or.reduce([x * topk.LISTS >= block.cutoff[:, None] for x in block.lists(everything, ids, vectors)])
    assert found.sum() < 0.25 * whole.size  # resolved in phase 3
    q, row, score = block.collect(everything, ids, vectors)
    assert set(zip(q.tolist(), row.tolist())) == set(zip(*np.nonzero(whole >= block.cutoff[:, None]))) and (score == whole[q, row]).all()
