"""The Chinese toolkit: transitions, spoken passages, keywords, features and boundaries of narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paraweft.functions import lexicon as L, text as T

_TURN = "|".join([*L.TRANSITIONS, *L.MARKERS, *L.TIMES])


def is_transition(sentence: Column) -> Column:
    """Whether a sentence has a turn of narrative, a marker of discourse or an expression of time."""
    return sentence.rlike(_TURN)


def transitions(sentences: Column) -> Column:
    """Indexes of such sentences."""
    return F.filter(F.transform(sentences, lambda s, i: F.when(is_transition(s), i)), lambda i: i.isNotNull())


def _spans(text: Column, pattern: str) -> Column:
    """struct(start, end, content) of each match: gaps between matches tell where they stand."""
    got, inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.split(text, pattern)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(got)).alias("gap"), got.alias("got"), inner.alias("inner"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["got"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["inner"].alias("content")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,content:string>>").alias("out"))
    return F.aggregate(zipped, zero, step, lambda a: a["out"])


def spoken(text: Column) -> Column:
    """Spoken passages as array of (start, end, content), each once, by start."""
    found = [_spans(text, p) for p in L.SPOKEN]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def tokens(text: Column) -> Column:
    """Words for keywords without a dictionary: pairs of neighbouring Chinese characters, and words of other letters. A dictionary tokenizer can replace it."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\x{4E00}-\x{9FFF}]{2,}|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]{2,}"), F.lit(0))

    def pairs(r: Column) -> Column:
        chinese = r.rlike(r"^[\x{4E00}-\x{9FFF}]")
        return F.when(chinese, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))

    return F.flatten(F.transform(runs, pairs))


def keywords(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """``(id, rank, word, pos, score)``: the ``k`` most frequent words of each text, score frequency over all times the weight of the part of speech.

    ``tokens_col`` holds array<struct<word, pos>> from a tagger; by default words come from :func:`tokens` and weigh 1.
    """
    if tokens_col is None:
        rows = docs.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("at", "word")).withColumn("pos", F.lit("x"))
    else:
        rows = docs.select(id_col, F.posexplode(tokens_col).alias("at", "t")).select(id_col, "at", "t.word", "t.pos").where(F.length("word") > 1)
    counts = rows.groupBy(id_col, "word", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    by = Window.partitionBy(id_col)
    weights = F.create_map(*[F.lit(x) for pair in L.POS_WEIGHTS.items() for x in pair])
    counts = counts.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("n"), "first", "word")), "total": F.sum("n").over(by)})
    return counts.where(F.col("rank") <= k).select(id_col, "rank", "word", "pos", F.round(F.col("n") / F.col("total") * F.coalesce(weights[F.col("pos")], F.lit(1.0)), 9).alias("score"))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds seven numbers that describe a Chinese text."""
    t = F.col(text_col)
    sentences = T.split_chinese(t)
    n = F.length(t)
    rows = docs.withColumns({"f_s": sentences, "f_tokens": tokens(t), "f_spoken": spoken(t)})
    lengths = F.transform("f_s", lambda s: F.length(s).cast("double"))
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / F.size(lengths)
    spread = F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(lengths))
    some = F.size("f_s") > 0

    def share(x: Column, of: Column) -> Column:
        return F.round(F.when(of > 0, x / of).otherwise(F.lit(0.0)), 9)

    turns = F.size(F.filter(F.array(*map(F.lit, L.TRANSITIONS)), lambda w: F.contains(t, w)))
    spoken_chars = F.aggregate("f_spoken", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    rows = rows.withColumns(
        {
            "chinese_ratio": F.round(T.chinese_ratio(t), 9),
            "avg_sentence_length": F.round(F.when(some, mean).otherwise(F.lit(0.0)), 9),
            "sentence_length_std": F.round(F.when(some, spread).otherwise(F.lit(0.0)), 9),
            "punctuation_density": share(T.count(t, '[' + L.PUNCTUATION.replace("［", r"\［").replace("］", r"\］") + '"' + "]"), n),
            "dialogue_ratio": share(spoken_chars, n),
            "transition_density": share(turns, F.size("f_s")),
            "lexical_diversity": share(F.size(F.array_distinct("f_tokens")), F.size("f_tokens")),
        }
    )
    return rows.drop("f_s", "f_tokens", "f_spoken")


def narrative_boundaries(sentences: Column, similarities: Column) -> Column:
    """i + 1 for gaps below a threshold of 0.5 that turns, speech and a change of words lower."""

    def below(i: Column) -> Column:
        a, b = F.get(sentences, i), F.get(sentences, i + 1)
        wa, wb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
        union = F.size(F.array_union(wa, wb))
        overlap = F.when(union > 0, F.size(F.array_intersect(wa, wb)) / union).otherwise(F.lit(0.0))
        limit = F.lit(0.5) * F.when(is_transition(b), 0.7).otherwise(1.0) * F.when(F.size(spoken(F.concat(a, b))) > 0, 0.8).otherwise(1.0) * F.when(overlap < 0.2, 0.9).otherwise(1.0)
        return F.get(similarities, i) < limit

    n = F.size(similarities)
    hits = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), below)).otherwise(F.array().cast("array<int>"))
    return F.transform(hits, lambda i: i + 1)


def post_process(paragraphs: Column) -> Column:
    """Paragraphs with single spaces, none before punctuation and one after a sentence's end; empty ones fall away. (What was documented; the original raised.)"""

    def tidy(p: Column) -> Column:
        p = F.regexp_replace(T.clean(p), f"{T.WS}+([。！？；，、])", "$1")
        p = F.regexp_replace(p, f"([。！？；])([^\"'\\s])", "$1 $2")
        return F.regexp_replace(p, f'{T.WS}*"{T.WS}*', '"')

    return F.filter(F.transform(paragraphs, tidy), lambda p: p != "")
