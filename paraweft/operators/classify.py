"""Text types from keywords, patterns and sentence structure: one projection, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from paraweft.config import TYPE_SETTINGS
from paraweft.functions import lexicon as L, text as T, vectors as V

#: Unicode classes, as the patterns were written for.
_U = "(?U)"


def code_patterns(text: Column) -> Column:
    each = [F.when(~text.contains(need), F.lit(0)).otherwise(T.count(text, _U + p)) for p, need in zip(L.CODE, L.CODE_NEEDS, strict=True)]
    return sum(each[1:], each[0])


def quote_pairs(text: Column) -> Column:
    """Half of three times the double quotes: the count that the method takes."""
    return _holding(text, '"', F.floor(3 * T.count(text, '"') / 2).cast("int"))


def _holding(text: Column, needs: str, number: Column) -> Column:
    """A count that is 0 for every text without any of these characters, and is not made for those."""
    some = [text.contains(c) for c in needs]
    return F.when(~reduce(or_, some), F.lit(0)).otherwise(number)


def dialogue_patterns(text: Column) -> Column:
    return sum((_holding(text, need, T.count(text, p)) for p, need in zip(L.DIALOGUE, L.DIALOGUE_NEEDS, strict=True)), quote_pairs(text))


def narration_patterns(text: Column) -> Column:
    return T.where_chinese(text, sum((T.count(text, p) for p in L.NARRATION), F.floor(T.count(text, L.PRONOUN) / 10).cast("int")))


def sentence_structure(text: Column) -> Column:
    """struct of average sentence length, commas a sentence and questions a sentence; zeros without sentences."""
    strip = f"^{T.WS}+|{T.WS}+$"
    parts = F.filter(F.transform(F.split(text, "[。！？；]"), lambda s: F.regexp_replace(s, strip, "")), lambda s: s != "")

    def of(sums: Column) -> Column:
        n = sums["n"]

        def each(x: Column) -> Column:
            return F.when(n > 0, x / n).otherwise(F.lit(0.0))

        return F.struct(each(sums["length"]).alias("avg_length"), each(T.count(text, "[，,]")).alias("complexity"), each(T.count(text, "[？?]")).alias("question_ratio"))

    return V.let(V.let(parts, lambda p: F.struct(F.size(p).alias("n"), F.aggregate(p, F.lit(0), lambda a, s: a + F.length(s)).alias("length"))), of)


def evidence(docs: DataFrame, text_col: str = "text", novel_keywords: list[str] | None = None) -> DataFrame:
    """Adds the counts that the scores are made of."""
    t = F.col(text_col)
    return docs.withColumns(
        {
            "technical_keywords": T.keywords_present(t, L.TECHNICAL),
            "novel_keywords": T.keywords_present(t, L.NOVEL if novel_keywords is None else novel_keywords),
            "academic_keywords": T.keywords_present(t, L.ACADEMIC),
            "news_keywords": T.keywords_present(t, L.NEWS),
            "code_patterns": code_patterns(t),
            "dialogue_patterns": dialogue_patterns(t),
            "narration_patterns": narration_patterns(t),
            "structure": sentence_structure(t),
        }
    )


SCORED = ("technical", "novel", "academic", "news", "dialogue")


def detect_text_type(docs: DataFrame, text_col: str = "text", novel_keywords: list[str] | None = None) -> DataFrame:
    """Adds ``text_type``, ``confidence``, ``max_score``, ``is_mixed``, ``type_scores`` and ``structure``.

    Scores are weighted counts for each thousand characters of the raw text. The
    highest names the type, the first in the order of ``SCORED`` among equals; too
    low a score is unknown, scores too close together are mixed. Null and blank
    texts and those of fewer than 50 characters are unknown with confidence 0.
    """
    added = ["technical_keywords", "novel_keywords", "academic_keywords", "news_keywords", "code_patterns", "dialogue_patterns", "narration_patterns"]
    rows = evidence(docs, text_col, novel_keywords)
    length = F.length(text_col)

    def rate(x: Column) -> Column:
        return x / F.when(length > 0, length) * 1000

    c = F.col
    scores = {
        "technical": rate(c("technical_keywords") * 2 + c("code_patterns") * 3),
        "novel": rate(c("novel_keywords") * 1.5 + c("dialogue_patterns") * 1.5 + c("narration_patterns") * 2),
        "academic": rate(c("academic_keywords") * 2 + c("structure.complexity") * 5),
        "news": rate(c("news_keywords").cast("double")),
        "dialogue": rate(c("dialogue_patterns").cast("double")),
    }
    rows = rows.withColumns({f"score_{k}": v.cast("double") for k, v in scores.items()})
    each = [c(f"score_{k}") for k in SCORED]
    top = F.greatest(*each)
    total = each[0] + each[1] + each[2] + each[3] + each[4]
    rows = rows.withColumns({"max_score": top, "confidence": F.when(total > 0, top / total).otherwise(F.lit(0.0))})
    top = c("max_score")
    best = F.coalesce(*[F.when(c(f"score_{k}") == top, F.lit(k)) for k in SCORED])
    ranked = F.sort_array(F.array(*each), asc=False)
    many = sum((F.when(x > top * 0.4, 1).otherwise(0) for x in each[1:]), F.when(each[0] > top * 0.4, 1).otherwise(0)) >= 3
    by_structure = (best == "academic") & (top > 50) & (c("academic_keywords") <= 1) & ((c("novel_keywords") > 0) | (c("technical_keywords") > 0))
    mixed = ((top > 0) & (F.get(ranked, F.lit(1)) / F.when(top > 0, top) > 0.6)) | many | by_structure
    rows = rows.withColumn("is_mixed", F.coalesce(mixed, F.lit(False)))
    kind = F.when(top < 1.0, "unknown").when(c("is_mixed") | (c("confidence") < 0.25), "mixed").otherwise(best)
    strip = f"^{T.WS}+|{T.WS}+$"
    fit = F.coalesce(F.length(F.regexp_replace(text_col, strip, "")) >= 50, F.lit(False))
    pairs = [x for k in SCORED for x in (F.lit(k), c(f"score_{k}"))]
    rows = rows.withColumns(
        {
            "text_type": F.when(fit, kind).otherwise("unknown"),
            "confidence": F.when(fit, c("confidence")).otherwise(F.lit(0.0)),
            "max_score": F.when(fit, c("max_score")),
            "is_mixed": F.when(fit, c("is_mixed")),
            "type_scores": F.when(fit, F.create_map(*pairs)),
            "structure": F.when(fit, c("structure")),
        }
    )
    return rows.drop(*added, *[f"score_{k}" for k in SCORED])


def settings_table(spark) -> DataFrame:
    """The seven types' settings."""
    names = ("text_type", "threshold", "window_size", "min_paragraph_length", "max_paragraph_length", "use_structure_hints")
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(names, (k, *v), strict=True)]) for k, v in TYPE_SETTINGS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_settings(docs: DataFrame) -> DataFrame:
    """Adds each document's settings by its type: a lookup in a literal of seven entries, so there is nothing to join."""
    names = {"threshold": "double", "window_size": "int", "min_paragraph_length": "int", "max_paragraph_length": "int", "use_structure_hints": "boolean"}
    entries = [x for k, v in TYPE_SETTINGS.items() for x in (F.lit(k), F.struct(*[F.lit(y).cast(t).alias(n) for (n, t), y in zip(names.items(), v, strict=True)]))]
    return docs.withColumn("settings", F.create_map(*entries)[F.col("text_type")]).select("*", "settings.*").drop("settings")
