"""Column functions against plain rules on small texts."""

import math

import pytest
from pyspark.sql import functions as F

from paraweft.config import EngineConfig
from paraweft.functions import text as T, vectors as V
from paraweft.operators import boundaries as B, chinese, segment, selection, topics


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


def test_sentences(spark):
    zh = "这是第一句话。这是第二句话！这是第三句话？"
    assert value(spark, zh, T.split_sentences(F.col("text"))) == ["这是第一句话。", "这是第二句话！", "这是第三句话？"]
    assert value(spark, "One two. No! And so on: end", T.split_sentences(F.col("text"), "western")) == ["One two.", "And so on:"]
    for blank in (None, "", "  \n"):
        assert value(spark, blank, T.split_sentences(F.col("text"))) == []
    assert len(value(spark, "English text. " * 3 + "中文句子在这里。", T.split_sentences(F.col("text")))) == 1


def test_chinese_sentences_join_short_ones(spark):
    assert value(spark, "这是一个足够长的句子吗？是。另一个足够长的句子在此。", T.split_chinese(F.col("text"))) == ["这是一个足够长的句子吗？是。", "另一个足够长的句子在此。"]
    assert value(spark, "", T.split_chinese(F.col("text"))) == []


def test_validation_and_output(spark):
    assert value(spark, "很长的文本" * 2000, T.is_valid(F.col("text"), 100)) is False
    assert value(spark, "很长的文本" * 2000, T.is_valid(F.col("text"), 20_000)) is True
    assert not any(value(spark, t, T.is_valid(F.col("text"))) for t in (None, "", " \t　"))
    rows = spark.createDataFrame([(["有内容", "", "  另一段 "],)], "p array<string>")
    assert rows.select(T.joined(F.col("p"))).first()[0] == "有内容\n\n另一段"
    assert rows.select(T.joined(F.col("p"), " | ")).first()[0] == "有内容 | 另一段"


def test_normalisation(spark):
    assert value(spark, " 你好 ， 世界 。再见 ", T.normalize(F.col("text"))) == "你好，世界。 再见"
    assert value(spark, "圆周率大约是 3.14, 对吗?", T.normalize_chinese(F.col("text"))) == "圆周率大约是 3。14， 对吗？"
    assert value(spark, "abc 中文", T.chinese_ratio(F.col("text"))) == pytest.approx(0.4)


def series(spark, values, column):
    return spark.createDataFrame([(values,)], "s array<double>").select(column.alias("v")).first().v


def test_candidates_and_smoothing(spark):
    s = [0.9, 0.5, 0.8, 0.8, 0.3]
    assert series(spark, s, B.candidates(F.col("s"), F.lit(0.0))) == [1, 4]
    assert series(spark, s, B.candidates(F.col("s"), F.lit(0.85))) == [1, 2, 3, 4]
    assert series(spark, s, B.candidates(F.col("s"), F.lit(0.85), 2)) == [1, 3]
    assert series(spark, [], B.candidates(F.col("s"), F.lit(0.5))) == []
    weights = V.gauss()

    def reflected(x, i):
        i %= 2 * len(x)
        return x[2 * len(x) - 1 - i if i >= len(x) else i]

    want = [round(sum(w * reflected(s, i + k) for k, w in zip(range(-4, 5), weights, strict=True)), 9) for i in range(5)]
    assert series(spark, s, V.smooth(F.col("s"))) == pytest.approx(want, abs=2e-9)
    assert series(spark, [0.1, 0.2], V.smooth(F.col("s"))) == [0.1, 0.2]


def repaired(sentences, cuts, shortest, longest):
    out, start = [], 0
    for b in cuts:
        n = len(" ".join(sentences[start:b]))
        if n < shortest and shortest > 50:
            continue
        if n > longest and b - start > 2:
            out.append(start + (b - start) // 2)
        out.append(b)
        start = b
    return out


def test_length_repair(spark):
    import random

    rng = random.Random(1)
    for _ in range(30):
        sentences = ["x" * rng.randint(1, 60) for _ in range(rng.randint(2, 15))]
        cuts = sorted(rng.sample(range(len(sentences)), rng.randint(0, len(sentences) - 1)))
        shortest, longest = rng.choice([(50, 300), (100, 200), (60, 90)])
        row = spark.createDataFrame([(sentences, cuts)], "s array<string>, b array<int>")
        assert row.select(B.repair(F.col("s"), F.col("b"), F.lit(shortest), F.lit(longest))).first()[0] == repaired(sentences, cuts, shortest, longest)


def test_vectors(spark):
    row = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [3.0, 4.0]],)], "v array<array<double>>")
    assert row.select(V.adjacent(F.col("v"))).first()[0] == [0.0, 0.0, 0.0]
    assert row.select(V.unit(F.get(F.col("v"), F.lit(3)))).first()[0] == pytest.approx([0.6, 0.8])
    got = row.select(V.at_scale(F.col("v"), 3)).first()[0]
    assert got[0] == pytest.approx(1 / math.sqrt(1 + 4), abs=1e-9) or len(got) == 3
    hashed = spark.range(1).select(V.hashed(F.lit("a b a"))).first()[0]
    assert sum(x * x for x in hashed) == pytest.approx(1) and len(hashed) == 64
    assert spark.range(1).select(V.hashed(F.lit(""))).first()[0] == [0.0] * 64


def test_segmentation_keeps_all_sentences(spark):
    text = "The engine reads text. It splits sentences at ends. " * 6 + "Rivers flow to the sea. Mountains stand still and wait. " * 6
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Short one only"), (4, "x " * 6000)], "doc_id long, text string")
    out = {r.doc_id: r for r in segment.segment_enhanced(docs, EngineConfig(endings="western")).collect()}
    r = out[1]
    assert r.error is None and sum(p.sentence_count for p in r.paragraphs) == r.sentence_count == 24
    assert [p.end_idx for p in r.paragraphs[:-1]] == [p.start_idx for p in r.paragraphs[1:]] and 0 <= r.quality.quality_score <= 1
    assert out[2].error.error_type == "validation" and out[2].paragraphs is None and out[4].error is not None
    assert len(out[3].paragraphs) == 1 and out[3].quality is None


def test_settings_are_checked():
    for bad in ({"threshold": 1.5}, {"endings": "x"}, {"force_type": "poem"}, {"chunk_size": 10}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert EngineConfig().replace(threshold=0.4).describe()["threshold"] == "0.4"


def test_methods(spark):
    rows = spark.createDataFrame([(100, "novel"), (1000, "novel"), (1000, "mixed"), (9000, "novel"), (1000, "news")], "n int, t string")
    assert [r[0] for r in rows.select(selection.select_method(F.col("n"), F.col("t"))).collect()] == ["enhanced", "transformer", "hybrid", "enhanced", "enhanced"]
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.9)], "doc_id long, method string, score double")
    got = {r.method: (r.rank, r.best_method, r.behind_best) for r in selection.rank_methods(scores).collect()}
    assert got == {"a": (3, "b", 0.4), "b": (1, "b", 0.0), "c": (1, "b", 0.0)}


def test_spoken_passages(spark):
    got = value(spark, '他说："你好"。「再见」', chinese.spoken(F.col("text")))
    assert (3, 7, "你好") in [tuple(s) for s in got] and (8, 12, "再见") in [tuple(s) for s in got]


def test_topics(spark):
    row = spark.createDataFrame([([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]],)], "t array<array<double>>")
    t = row.select(topics.topic_scores(F.col("t"))).first()[0]
    assert t.coherence == pytest.approx(0.5) and t.boundaries == [2] and 0.7 < t.smoothness < 0.8
    assert row.select(topics.internal_consistency(F.slice("t", 1, 1))).first()[0] == 1.0
