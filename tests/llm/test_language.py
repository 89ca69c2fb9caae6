import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paraweft.llm import language
from paraweft.llm.language import CHAIN, Model, identify, label_words, train, word_features
from paraweft.llm.words import hashes, strings

SYLLABLES = {"aa": ["ta", "ko", "mi", "ra", "su"], "bb": ["eau", "elle", "ou", "ent", "que"], "cc": ["sch", "ung", "keit", "ein", "über"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(k, text(lang, rng.randint(3, 60), rng), lang, "s") for k in range(240) for lang in [rng.choice(list(SYLLABLES))]]


@pytest.fixture(scope="module")
def model(docs_of, rows):
    return train(docs_of(rows), F.col("doc_id") % 3 != 1)


def test_marginals_equal_enumeration():
    m = Model(["x", "y"])
    rng = np.random.default_rng(1)
    m.moves, m.first = rng.normal(size=(2, 2)), rng.normal(size=2)
    e = rng.normal(size=(4, 2)).astype(np.float32)
    at = np.full((1, CHAIN), -1)
    at[0, :4] = range(4)
    want = np.zeros((4, 2))
    for code in range(16):
        y = [(code >> k) & 1 for k in range(4)]
        p = np.exp(m.first[y[0]] + sum(e[t, y[t]] for t in range(4)) + sum(m.moves[y[t], y[t + 1]] for t in range(3)))
        for t in range(4):
            want[t, y[t]] += p
    assert np.allclose(m.marginals(e, at)[0, :4], want / want.sum(1, keepdims=True))


def test_a_text_is_one_chain_however_long():
    rng = np.random.default_rng(5)
    m = Model(["x", "y", "z"])
    m.moves, m.first = 3 * np.eye(3) + rng.normal(size=(3, 3)), rng.normal(size=3)
    m.weights = rng.normal(0, 0.3, m.weights.shape).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcdeéж文"), rng.integers(1, 5))) for _ in range(n)) for n in (1, 31, 32, 33, 64, 65, 200, 500)]
    data, offsets = strings(pa.array(texts))
    begin, end, row, gamma = m.words(data, offsets)
    for r in range(len(texts)):
        mine = np.flatnonzero(row == r)
        e = m.emissions(*word_features(data, begin[mine], end[mine], hashes(data, begin[mine], end[mine]), m.lexicon, m.mask)).astype(float)
        a, b = [np.exp(m.first + e[0])], [np.ones(3)]
        for t in range(1, len(mine)):
            a.append((a[-1] / a[-1].sum() @ np.exp(m.moves)) * np.exp(e[t]))
            back = np.exp(m.moves) @ (np.exp(e[-t]) * b[-1])
            b.append(back / back.sum())
        want = np.array(a) * np.array(b[::-1])
        assert np.allclose(gamma[mine], want / want.sum(1, keepdims=True), atol=1e-5)


def test_affixes_are_characters():
    m = Model(["x", "y"])

    def of(word):
        data, offsets = strings(pa.array([word]))
        return word_features(data, offsets[:-1], offsets[1:], hashes(data, offsets[:-1], offsets[1:]), m.lexicon, m.mask)[0]

    one, two = of("жaé"), of("зaé")
    assert len(one) == 8 + 4 + 3 and sum(one != two) == 1 + 3 + 1 + 4  # the word, 3 beginnings, the last three, and the pairs and triples with its first


def test_the_lexicon_holds_words_of_one_language(docs_of, model):
    assert len(model.lexicon[0]) > 20 and set(model.lexicon[1].tolist()) == {0, 1, 2} and (np.diff(model.lexicon[0].astype(float)) > 0).all()


def test_rows_that_repeat_and_bounds_of_the_sample(docs_of, rows, monkeypatch):
    twice = docs_of(rows[:40] + rows[:40])
    model = train(twice, F.lit(True))
    got = {}
    for r in identify(twice, model).collect():
        got.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert len(got) == 40 and all(len(x) == 1 for x in got.values())
    monkeypatch.setattr(language, "CHARACTERS", 1)
    assert len(train(docs_of(rows), F.lit(True)).languages) == 3  # one whole text a language


def test_held_out_accuracy_and_scores(docs_of, rows, model):
    got = {r.doc_id: r for r in identify(docs_of(rows), model).collect()}
    held = [(i, lang) for i, _, lang, _ in rows if i % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_code_switched_words_are_labelled(docs_of, model):
    rng = random.Random(3)
    mixed = text("aa", 12, rng) + ", " + text("bb", 15, rng)
    runs = sorted(label_words(docs_of([mixed]), model).collect(), key=lambda r: r.run)
    by = {lang: sum(r.n_words for r in runs if r.lang == lang) for lang in SYLLABLES}
    assert sum(by.values()) == 27 and by["aa"] >= 10 and by["bb"] >= 12 and model.moves.trace() > model.moves.sum() - model.moves.trace()


def test_edges(docs_of, model):
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs_of([None, "", "123 !?", "«»", "ta ko mi " * 3000]), model).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "aa"
    assert identify(docs_of([]), model).collect() == []
    nothing = train(docs_of([(1, "a b", None, None)]), F.lit(True))
    assert [r.lang_pred for r in identify(docs_of(["words"]), nothing).collect()] == ["und"]
