"""The choice among methods, whole Markdown documents, tasks that report, and topic models, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paraweft.config import EngineConfig
from paraweft.operators import chinese, jobs, markdown, multitask, selection, topics
from paraweft.operators.segment import hashed_encoder, segment_enhanced

CONFIG = EngineConfig(endings="western", max_length=1_000_000)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30").select("doc_id", "text").cache()


def test_dispatcher_runs_the_method_it_names(spark, docs):
    wanted = F.when(F.col("doc_id") % 4 == 0, "transformer").when(F.col("doc_id") % 4 == 1, "hybrid").when(F.col("doc_id") % 4 == 2, "multi_task").otherwise("enhanced")
    rows = selection.segment_by_method(docs, CONFIG, wanted.alias("wanted")).collect()
    each = {m: {r.doc_id: r for r in selection.by_method(docs, m, CONFIG).collect()} for m in ("enhanced", "transformer", "multi_task")}
    assert len(rows) == 30
    for r in rows:
        if r.method == "hybrid":
            e, t = (each[m][r.doc_id].quality_score or 0.0 for m in ("enhanced", "transformer"))
            assert r.selected_method == ("enhanced" if e >= t else "transformer") and r.improvement == pytest.approx(abs(e - t))
        else:
            assert r.selected_method == r.method == ["transformer", "hybrid", "multi_task", "enhanced"][r.doc_id % 4]
        assert r.paragraphs == each[r.selected_method][r.doc_id].paragraphs


def test_comparison(spark, docs):
    rows = selection.compare_methods(docs, CONFIG).collect()
    assert len(rows) == 60
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.method] = r
    for both in by.values():
        top = max(r.score for r in both.values())
        for r in both.values():
            assert r.best_method == min(m for m, x in both.items() if x.score == top) and r.behind_best == pytest.approx(top - r.score)
            assert r.quality_difference == pytest.approx(top - min(x.score for x in both.values()))
    assert set(selection.speeds(docs.limit(3), CONFIG)) == {"enhanced", "transformer"}


def test_whole_markdown_documents(spark, docs, tmp_path):
    long = docs.where("length(text) > 400").first().text.replace("\n", " ")
    rows = spark.createDataFrame([(1, f"# Title\n\n{long}\n\n- one\n- two\n\n```py\ncode\n```"), (2, ""), (3, None), (4, "short words")], "doc_id long, markdown string")
    out = {r.doc_id: r for r in markdown.process(rows, CONFIG).collect()}
    expected = [p.text for p in segment_enhanced(spark.createDataFrame([(1, long)], "doc_id long, content string"), CONFIG, text_col="content").first().paragraphs]
    assert out[1].blocks_original == 4 and out[1].blocks_processed == 3 + len(expected)
    assert out[1].segmentation_applied == (len(expected) > 1)
    assert out[1].processed_markdown == "\n\n".join(["# Title", *expected, "- one\n- two", "```py\ncode\n```"])
    assert out[1].original.n_paragraph == 1 and out[1].processed.n_paragraph == len(expected)
    assert out[4].processed_markdown == "short words" and out[4].file_size == 11 and out[3].processed_markdown is None and out[2].blocks_original == 0
    tasks = jobs.Tasks(spark)
    name = jobs.markdown_job(tasks, rows, CONFIG, str(tmp_path / "job"))
    assert {r.doc_id: r for r in tasks.result(name, 300).collect()} == out
    assert tasks.status(name)["progress"] == 100 and tasks.estimates().first().message == "completed"
    report = jobs.health(spark, tasks)
    assert report["status"] == "healthy" and report["tasks"]["completed"] == 1


def test_markdown_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, "# A\n\nb")], "doc_id long, markdown string")
    plan = markdown.process(rows, CONFIG)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_progress_goes_in_steps_of_five(spark):
    import threading

    tasks, seen, go = jobs.Tasks(spark), [], threading.Event()

    def work(report):
        go.wait(10)
        for p in (11, 14, 16, 21, 23.5, 140):
            report(p)
            seen.append(tasks.rows[name]["progress"])

    name = tasks.submit(work)
    go.set()
    tasks.result(name, 60)
    assert seen == [10, 10, 16, 21, 21, 100]


def test_chunks_start_where_one_is_not_empty(spark):
    blocks = spark.createDataFrame([(1, 0, ""), (1, 1, "x" * 2000), (1, 2, "y")], "doc_id long, block int, content string")
    assert sorted((r.chunk, r.first_block, r.n_blocks, r["size"]) for r in markdown.pack(blocks, 1000).collect()) == [(0, 0, 1, 0), (1, 1, 1, 2000), (2, 2, 1, 1)]


def test_topics_part_what_differs(spark):
    import math

    gamma = 0.5772156649015329
    half = -gamma - 2 * math.log(2)
    assert topics.digamma(np.array([0.5, 1.0, 7.5])) == pytest.approx([half, -gamma, half + sum(1 / (k + 0.5) for k in range(7))], abs=1e-9)
    weights = np.kron(np.eye(2), np.ones((4, 6)))
    shares, words = topics.fit_topics(weights, 2)
    assert shares.sum(1) == pytest.approx(np.ones(8)) and words.sum(1) == pytest.approx(np.ones(2))
    assert set(shares[:4].argmax(1)) != set(shares[4:].argmax(1)) and len(set(shares[:4].argmax(1))) == 1
    rows = [(1, p, "river castle stone knight river" if p < 3 else "market bank price trade market") for p in range(6)] + [(2, 0, "the a"), (2, 1, "")]
    paragraphs = spark.createDataFrame(rows, "doc_id long, para long, text string")
    out = {(r.doc_id, r.para): r for r in topics.topic_model(paragraphs).collect()}
    assert len(out) == 8 and len(out[1, 0].topics) == 3 and math.isclose(sum(out[1, 0].topics), 1)
    assert out[1, 0].main_topic == out[1, 1].main_topic != out[1, 4].main_topic and "river" in out[1, 0].words
    scored = topics.consistency(paragraphs.withColumn("sentences", F.array("text")), topics=topics.topic_model(paragraphs)).collect()
    assert {r.doc_id for r in scored} == {1, 2} and all(0 <= r.score <= 1 for r in scored)


def test_topics_of_many_documents_are_those_of_each_alone():
    rng = np.random.default_rng(7)
    docs, plain = [], []
    for n, m in ((2, 9), (5, 40), (3, 1), (4, 30), (5, 40)):
        x = (rng.random((n, m)) < 0.4) * rng.random((n, m))
        x[0] = 0  # a paragraph without a term
        docs.append((n, m, *np.nonzero(x), x[np.nonzero(x)]))
        plain.append(topics.fit_topics(x, 2, 20))
    for (shares, words), (a, b) in zip(topics.fit_many(docs, 2, 20), plain, strict=True):
        assert shares == pytest.approx(a, abs=1e-9) and words == pytest.approx(b, abs=1e-9)


def odd_paragraphs(spark):
    """Ids and places null or repeated, texts null, empty, Chinese, of stop words, and one document of more terms than are kept."""
    rows = [(1, p, t) for p, t in enumerate(["river castle stone knight river", "river Stone market", "market bank price trade market 42 x", None, "the a of", "市场 价格 上涨 İstanbul ǅ"])]
    rows += [(2, 0, "one two three"), (2, 1, "two two"), (2, 1, "two four five"), (2, None, "four one one"), (None, 0, "one two"), (None, 1, "two three"), (3, 0, ""), (3, 1, None), (4, 0, "alone here"), (6, 7, "same same words"), (6, 9, "same same words")]
    rows += [(5, p, " ".join(f"w{(p * 37 + i * i) % 700}" for i in range(400))) for p in range(4)]
    return spark.createDataFrame(rows, "doc_id long, para long, text string")


def test_weights_of_blocks_are_those_of_tfidf(spark, monkeypatch):
    """terms are weighed where the document is, in blocks of bounded size, instead of by shuffles and dicts."""
    from pyspark.sql import functions as F

    from paraweft.operators import terms

    paragraphs = odd_paragraphs(spark)
    plain = {(r.doc_id, r.para, r.term): r.weight for r in topics.tfidf(paragraphs).collect() if r.para is not None}
    docs = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", "text"))).alias("paras"))
    batch = docs.select("doc_id", topics.paragraph_words(F.col("paras")).alias("paras")).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    for most in (1, 20, 1 << 16):
        monkeypatch.setattr(terms, "WORDS", most)
        got, many = {}, 0
        for first, block in terms.blocks(batch, "doc_id", "paras"):
            many += 1
            assert len(block.n) == 1 or len(block.row) <= most
            block.weigh()
            for d, (paras, keys, (n, _, row, col, weight)) in enumerate(block.documents()):
                i = batch.column("doc_id")[first + d].as_py()
                assert n == len(paras) and [*keys] == sorted(keys)
                for r, c, w in zip(row, col, weight, strict=True):
                    got[i, paras[int(r)].as_py(), terms.term_name(block.names, keys[c])] = w
        assert got == pytest.approx(plain, abs=2e-9) and len({k[2] for k in got if k[0] == 5}) == 1000
        assert (many == 1) == (most == 1 << 16)


def test_settled_topic_models_are_done(monkeypatch):
    """a step that leaves the words as they are ends a document's fit; what it would come to after all steps is the same."""
    rng, steps, plain = np.random.default_rng(3), [], topics._shares
    monkeypatch.setattr(topics, "_shares", lambda ns, *a: (steps.append(len(ns)), plain(ns, *a))[1])
    docs = []
    for n, m in ((2, 30), (5, 120), (4, 60), (3, 1), (2, 1)):
        x = (rng.random((n, m)) < 0.3) * rng.random((n, m)) * (m > 1)
        docs.append((n, m, *np.nonzero(x), x[np.nonzero(x)]))
    got = topics.fit_many(docs, 2)
    assert len(steps) < 100 and steps[-1] < len(docs) == steps[0]
    for (n, m, r, c, w), (shares, words) in zip(docs, got, strict=True):
        x = np.zeros((n, m))
        x[r, c] = w
        a, b = topics.fit_topics(x, 2)
        assert shares == pytest.approx(a, abs=1e-9) and words == pytest.approx(b, abs=1e-9)


def test_consistency_shuffles_texts_not_terms(spark):
    """measures are made on the row of a document, and equal those from rows of terms."""
    from pyspark.sql import functions as F

    paragraphs = odd_paragraphs(spark).withColumn("sentences", F.array(F.coalesce("text", F.lit(""))))
    out = topics.consistency(paragraphs, topics=topics.topic_model(paragraphs))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Join ") == 1
    for got in (out, topics.consistency(paragraphs)):
        got = {r.doc_id: r for r in got.collect()}
        assert {i: r.n_paragraphs for i, r in got.items() if i} == {1: 6, 2: 4, 3: 2, 5: 4, 6: 2}
        sims, words = {}, {}
        for r in topics.lexical_similarity(topics.tfidf(paragraphs), digits=12).collect():
            sims[r.doc_id] = sims.get(r.doc_id, 0) + r.sim
        for r in topics.keyword_overlap(paragraphs).collect():
            words.setdefault(r.doc_id, []).append(r.overlap)
        for i, r in got.items():
            assert r.lexical == pytest.approx(sims.get(i, 0) / (r.n_paragraphs * (r.n_paragraphs - 1) / 2), abs=2e-6)
            assert i is None or r.keywords == pytest.approx(sum(words[i]) / len(words[i]), abs=2e-6)
            assert i is not None or r.keywords == 0


def test_paragraphs_are_tidied(spark):
    made = spark.createDataFrame([(["一 ，二 。三", " ", 'a " b'],)], "p array<string>").select(chinese.post_process(F.col("p")).alias("p")).first().p
    assert made == ["一，二。 三", 'a"b']


def test_comparison_equals_the_methods_run_one_by_one(spark, sf):
    """one pass over each document, many at a time; ids repeat and are null, texts are odd."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 12").select("doc_id", "text").collect()]
    odd = [None, " ", "ab.", "a.b.", "One sentence only.", "市场，价格 上涨。 好的！x is it ， or not？ Yes: no. Fine; well then!", "- one item here. * two items here. 1. point of it. # Title: x. " * 9, "Σ ΑΣ:ΒΣ. İ Ǆ 😀 words. " * 7]
    rows += [(None if k < 3 else 5, t) for k, t in enumerate(odd)] + [(5, "alpha beta. alpha gamma! delta; " * 150)]
    docs = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "row long, doc_id long, text string")
    model, methods = multitask.MultiTaskModel(64), ("enhanced", "transformer", "multi_task")
    each = {m: {r.row: r for r in selection.by_method(docs, m, CONFIG, model=model).select("row", "quality_score", F.coalesce(F.size("paragraphs"), F.lit(0)).alias("n")).collect()} for m in methods}
    got = selection.compare_methods(docs, CONFIG, methods, id_col="row", model=model).collect()
    assert len(got) == 3 * len(rows) == len({(r.row, r.method) for r in got})
    for r in got:
        scores = {m: each[m][r.row].quality_score or 0.0 for m in methods}
        assert (r.score, r.paragraph_count) == (scores[r.method], each[r.method][r.row].n), (r, rows[r.row])
        assert r.rank == 1 + sum(x > r.score for x in scores.values())
        assert r.best_method == min(m for m in methods if scores[m] == max(scores.values()))
        assert (r.behind_best, r.quality_difference) == (pytest.approx(max(scores.values()) - r.score), pytest.approx(max(scores.values()) - min(scores.values())))
    plain = selection.compare_methods(docs, CONFIG, methods, hashed_encoder(64), "row", model=model).collect()  # an encoder of one's own: method by method
    assert sorted(map(repr, plain)) == sorted(map(repr, got))
    assert selection.compare_methods(docs, CONFIG, methods, model=model).count() == 3 * len(rows)  # a row is compared with itself, whatever its id


def test_comparison_reads_each_document_once(spark, docs):
    plan = selection.compare_methods(docs, CONFIG, ("enhanced", "transformer", "multi_task"), model=multitask.MultiTaskModel(64))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Join" not in plan and "Window" not in plan
