import random
import re

import pyarrow as pa

from paraweft.llm.components import components
from paraweft.llm.near_duplicates import DEPTH, REST, _neighbours, near_duplicates
from paraweft.scratch import Scratch


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent=80):
    sets = {i: sets_of(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_groups_equal_brute_force(docs_of):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 20, 60, 150]))] for _ in range(40)]
    rows = []
    for k in range(400):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, rng.choice([" ", "  ", "\n"]).join(w)))
    out = got(near_duplicates(docs_of([(i, t, None, None) for i, t in rows]), n=4))
    assert out == brute(rows, 4)


def test_hot_group_of_edited_copies(docs_of):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    out = got(near_duplicates(docs_of([(i, t, None, "hot") for i, t in rows]), n=4))
    assert out == brute(rows, 4)


def test_pairs_among_texts_of_one_template(docs_of):
    """Texts that share a template just under the limit, of which some two share more: all links, none to the rest."""
    rng = random.Random(3)
    template = [f"t{k}" for k in range(150)]
    rows = []
    for pair in range(200):
        shared = [f"s{pair}x{k}" for k in range(4)]
        for side in range(2):
            own = [f"o{pair}y{side}z{k}" for k in range(16)]
            rows.append((2 * pair + side, " ".join(template + shared + own)))
    rng.shuffle(rows)
    out = got(near_duplicates(docs_of([(i, t, None, "hot") for i, t in rows]), n=4))
    assert out == brute(rows, 4) and len({c for _, c, _ in out.values()}) == 200


def test_two_crowds_near_each_other(docs_of):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(240):
        w = list(base)
        if k % 2:
            w[40:46] = [f"other{j}" for j in range(6)]
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    assert got(near_duplicates(docs_of([(i, t, None, "hot") for i, t in rows]), n=4)) == brute(rows, 4)


def test_texts_that_a_weak_hash_takes_for_each_other_stay_apart(docs_of):
    def woven(k):
        s = "a"
        for _ in range(k):
            s += s.translate(str.maketrans("ab", "ba"))
        return [s, s.translate(str.maketrans("ab", "ba"))]

    rows = list(enumerate(t for k in (10, 11, 12) for t in woven(k)))
    assert got(near_duplicates(docs_of([(i, t, "en", "s") for i, t in rows]), n=4)) == {i: (1, i, True) for i, _ in rows}


def test_a_crowded_region_pairs_only_those_of_one_whole_path():
    """27 members of one region, three of them of each path: 3 x 3 pairs at most of a path, none across, and all are flagged."""
    head, rest = b"\0" * (1 + 4 * DEPTH), 4 * REST
    path = [head + bytes([k // 3]) * rest for k in range(27)]
    cls = [bytes([k]) * 16 for k in range(27)]
    first = (bytes(len(head) + rest), bytes([99]) * 16)  # a partition's first region counts as crowded, so another stands before it
    rows = [first, *[(b"\1" + p[1:], c) for p, c in zip(path, cls, strict=True)]]
    batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary()), pa.array([50] * 28, pa.int32())], names=["path", "cls", "n_shingles"])
    out = [r for b in _neighbours(80)(iter([batch])) for r in b.to_pylist()]
    pairs = {(r["a"][0], r["b"][0]) for r in out if r["b"] is not None}
    assert pairs == {(k + i, k + j) for k in range(0, 27, 3) for i in range(3) for j in range(i + 1, 3)}
    assert {r["a"][0] for r in out if r["b"] is None} == {*range(27), 99}


def test_edges(docs_of):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n ", "en", "s"), (4, "One two", "en", "s"), (5, "one TWO", None, None), (5, "one TWO", None, None), (None, "one two", "en", "s"), (7, "É é", "en", "s")]
    out = near_duplicates(docs_of(rows), n=4).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] * 2 and by[None] == [(1, 4, False)] and by[7] == [(1, 7, True)]


def test_empty_table(docs_of):
    assert near_duplicates(docs_of([]), n=5).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (None, 3), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(links, Scratch(spark, "test")).collect()}
    assert roots == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
