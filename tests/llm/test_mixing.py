from paraweft.llm.mixing import mix, mixed


def taken(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.source, []).append(r)
    return out


def test_targets_are_met_exactly(docs_of):
    rows = [(k, " ".join(["w"] * (k % 9)), "en", "abc"[0 if k % 3 else 1 + k % 2]) for k in range(300)] + [(1000 + k, "a b c", "en", None) for k in range(5)]
    got = taken(mix(docs_of(rows)))
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert abs(sum(r[0].target for r in got.values()) - 1.5 * total) < 1e-6
    for source, docs in got.items():
        assert sum(r.taken for r in docs) == int(docs[0].target)
        assert docs[0].source_size == sum(r["size"] for r in docs)
        assert docs[0].target <= 2 * docs[0].source_size + 1e-9
        assert all(0 <= r.taken <= 2 * r["size"] for r in docs), source


def test_edges(docs_of):
    rows = [(1, None, "en", None), (1, "a b c d", "en", "x"), (1, "a b c d", "en", "x"), (None, "q", None, "x"), (2, "", "en", "empty")]
    out = mix(docs_of(rows)).collect()
    assert len(out) == 5
    by = {(r.doc_id, r.text, r.source): r for r in out}
    assert by[(1, None, None)].taken == 0 and by[(1, None, None)]["size"] == 0 and by[(2, "", "empty")].target == 0
    assert mix(docs_of([])).count() == 0


def test_the_mix_has_the_words_it_takes(docs_of):
    docs = docs_of([(k, f"a{k} b\tc{k}\nd e", "en", "xy"[k % 2]) for k in range(40)])
    words = sum(r.taken for r in mix(docs).collect())
    out = mixed(docs, chars_col="n_chars")
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == words and all(r.n_chars == len(r.text) for r in rows)


def test_reruns_agree(docs_of):
    docs = docs_of([(k, "w " * (k % 5), "en", "xyz"[k % 3]) for k in range(50)])
    pick = lambda: sorted((r.doc_id, r.taken) for r in mix(docs.repartition(7)).collect())
    assert pick() == pick()
