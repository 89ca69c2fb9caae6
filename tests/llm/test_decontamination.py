import numpy as np

from paraweft.llm.decontamination import contaminated, decontaminate, smith_waterman

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew potions near an old stone bridge at dawn"
OTHER = "completely different words about rivers and mountains that nobody has written in this particular order before now"


def plain(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_equals_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 15))
        score, lo, hi = smith_waterman(a, b)
        assert score == plain(a.tolist(), b.tolist())
        assert score == 0 or plain(a.tolist(), b[lo:hi].tolist()) == score


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_copies_are_found_and_clean_texts_are_not(spark, docs_of):
    edited = ITEM.replace("quick", "swift").replace("wizards", "sorcerers").replace("old ", "")
    rows = [(1, f"Before. {ITEM.upper()}! After.", "en", "s"), (2, f"x y z {edited} p q", "en", "s"), (3, OTHER, "en", "s"), (4, "the quick brown fox jumps away from here", "en", "s"), (5, None, None, None), (6, "", "en", "s"), (None, ITEM, "en", "s"), (1, f"Before. {ITEM.upper()}! After.", "en", "s")]
    docs, items = docs_of(rows), items_of(spark, [(10, ITEM), (11, "too short"), (12, None), (None, "")])
    found = sorted(((r.doc_id, r.item_id, round(r.score, 2)) for r in contaminated(docs, items).collect()), key=str)
    assert [f[:2] for f in found] == [(1, 10), (1, 10), (2, 10), (None, 10)]
    assert found[0][2] == 1.0 and 0.7 < found[2][2] < 1.0
    rest = decontaminate(docs, items)
    assert rest.columns == docs.columns and sorted(str(r.doc_id) for r in rest.collect()) == ["3", "4", "5", "6"]


def test_frequent_items_keep_their_seeds(spark, docs_of):
    docs = docs_of([f"{k} {ITEM} {k}" for k in range(200)] + [OTHER])
    assert contaminated(docs, items_of(spark, [(1, ITEM), (2, ITEM)])).count() == 400


def test_empty_tables(spark, docs_of):
    assert contaminated(docs_of([]), items_of(spark, [(1, ITEM)])).count() == 0
    assert contaminated(docs_of([ITEM]), items_of(spark, [])).count() == 0
    assert decontaminate(docs_of([ITEM]), items_of(spark, [])).count() == 1


def test_large_benchmarks_come_in_blocks(spark, docs_of, monkeypatch):
    from paraweft.llm import decontamination

    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 60)
    docs, items = docs_of([ITEM, OTHER, "nothing of that kind here at all today"]), items_of(spark, [(1, ITEM), (2, OTHER)])
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs, items).collect()) == [(0, 1), (1, 2)]


def test_edited_copies_are_found_however_often_they_stand(spark, docs_of):
    words = [f"w{k}" for k in range(30)]
    edited = " ".join("new" if k in (4, 14, 24) else w for k, w in enumerate(words))
    items = items_of(spark, [(1, " ".join(words))])
    for copies in (9, 100, 1000):
        for verbatim in (0, 1):
            docs = docs_of([f"{k} {edited} {k}" for k in range(copies)] + [" ".join(words)] * verbatim + [OTHER])
            assert contaminated(docs, items).count() == copies + verbatim
            assert decontaminate(docs, items).count() == 1


def test_all_alignments_of_the_limit_are_found(spark, docs_of):
    rng = np.random.default_rng(8)
    base = [[f"{'abcdef'[i]}{k}" for k in range(n)] for i, n in enumerate((4, 7, 12, 30, 31, 40))]
    base.append("of the cat of the dog of the cow of the hen of the pig of the fox".split())
    texts = []
    for w in base:
        for step in (2, 3, 4, 5):  # words replaced, put in and left out at even distances
            texts.append([x if k % step else "new" for k, x in enumerate(w)])
            texts.append([y for k, x in enumerate(w) for y in ([x, "put"] if k % step == 0 else [x])])
            texts.append([x for k, x in enumerate(w) if k % step])
        texts.append([y for x in w for y in (x, "put")])
        texts.append(w[: len(w) // 2])
        for _ in range(15):
            t = []
            for x in w:
                t += [[x], [x], [x], ["new"], [], [x, "put"], [x, "in", "put"]][rng.integers(7)]
            texts.append(["noise"] * rng.integers(3) + t + [str(rng.choice(base[rng.integers(7)])) for _ in range(rng.integers(60))])
    wanted = {}
    for d, t in enumerate(texts):
        for i, w in enumerate(base):
            score = plain(w, t) / (2 * len(w))
            if score >= 0.5:
                wanted[d, i] = score
    found = contaminated(docs_of([" ".join(t) for t in texts]), items_of(spark, [(i, " ".join(w)) for i, w in enumerate(base)])).collect()
    assert {(r.doc_id, r.item_id): r.score for r in found} == wanted and len(found) == len(wanted)


def test_a_quarter_of_the_words_may_be_replaced(spark, docs_of):
    words = [f"w{k}" for k in range(30)]
    docs = docs_of([" ".join("new" if k % 4 == at else w for k, w in enumerate(words)) for at in range(4)] + [OTHER])
    items = items_of(spark, [(1, " ".join(words))])
    assert sorted(r.doc_id for r in contaminated(docs, items).collect()) == [0, 1, 2, 3]
    assert [r.text for r in decontaminate(docs, items).collect()] == [OTHER]


def test_short_items_must_stand_whole(spark, docs_of):
    items = items_of(spark, [(1, "Forty-two"), (2, "blue"), (3, "to be. Or"), (4, "blue"), (5, "..."), (6, "forty three")])
    texts = ["the answer is forty  two, forty two", "blue, blue", "to be or not", "forty and two", "to be", None, ""]
    out = {(r.doc_id, r.item_id): (r.score, r.first_word, r.n_words) for r in contaminated(docs_of(texts), items).collect()}
    assert out == {(0, 1): (1.0, 3, 2), (1, 2): (1.0, 0, 1), (1, 4): (1.0, 0, 1), (2, 3): (1.0, 0, 3)}
    assert sorted(r.doc_id for r in decontaminate(docs_of(texts), items).collect()) == [3, 4, 5, 6]
