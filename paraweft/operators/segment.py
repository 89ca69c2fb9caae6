"""Documents to paragraphs: the whole method in one row a document, from projection to projection without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from paraweft.config import SCALES, TYPE_SETTINGS, EngineConfig
from paraweft.functions import text as T, vectors as V
from paraweft.operators import boundaries as B
from paraweft.operators.classify import detect_text_type

#: Encodes an array of texts as an array of vectors.
Encoder = Callable[[Column], Column]

PARAGRAPH = "struct<text:string,type:string,level:int,length:int,sentence_count:int,start_idx:int,end_idx:int,key_phrases:array<string>>"


def hashed_encoder(dimensions: int = 64) -> Encoder:
    return lambda texts: F.transform(texts, lambda s: V.hashed(s, dimensions))


def _settings(config: EngineConfig) -> dict[str, Column]:
    """Columns of the settings that hold for each document: its type's, then the overrides."""

    def by_type(k: int) -> Column:
        out = None
        for name, row in TYPE_SETTINGS.items():
            out = F.when(F.col("text_type") == name, F.lit(row[k])) if out is None else out.when(F.col("text_type") == name, F.lit(row[k]))
        return out

    names = {"min_paragraph_length": 2, "max_paragraph_length": 3, "use_structure_hints": 4}
    made = {name: F.lit(config.overrides[name]) if name in config.overrides else by_type(k) for name, k in names.items()}
    if config.enable_structure_hints is not None:
        made["use_structure_hints"] = F.lit(config.enable_structure_hints)
    return made


def prepared(docs: DataFrame, config: EngineConfig, text_col: str = "text") -> DataFrame:
    """Adds the type, its settings, the normalised text and its sentences; null for texts that aren't valid."""
    rows = detect_text_type(docs, text_col)
    valid = T.is_valid(F.col(text_col), config.max_length)
    if config.force_type:
        rows = rows.withColumns({"text_type": F.lit(config.force_type), "confidence": F.lit(1.0)})
    rows = rows.withColumns(_settings(config))
    normal = T.normalize_chinese(F.col(text_col)) if config.zh_optimize else T.normalize(F.col(text_col))
    rows = rows.withColumn("normalized", F.when(valid, normal))
    return rows.withColumn("sentences", F.when(valid, T.sentences(F.col("normalized"), config.endings, config.zh_optimize)))


def paragraphs(sentences: Column, cuts: Column, typed: bool = True) -> Column:
    """The paragraphs between the cuts, empty ranges left out."""
    points = F.array_sort(F.concat(F.array(F.lit(0)), cuts, F.array(F.size(sentences))))
    pairs = V.let(points, lambda ps: F.zip_with(F.slice(ps, F.lit(1), F.size(ps) - 1), F.slice(ps, F.lit(2), F.size(ps) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    ranges = F.filter(pairs, lambda r: r["a"] < r["b"])
    texts = F.transform(ranges, lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"), T.normalize(F.array_join(F.slice(sentences, r["a"] + 1, r["b"] - r["a"]), " ")).alias("t")))

    def made(p: Column) -> Column:
        n = F.length(p["t"])
        kind = F.when(n < 50, "title").when(p["t"].rlike(r"^(?:[•\-*]|1\.|2\.)"), "list_item").otherwise("content") if typed else F.lit("content")
        level = F.lit(1) if typed else F.lit(None).cast("int")
        phrases = T.key_phrases(p["t"]) if typed else F.lit(None).cast("array<string>")
        return F.struct(F.trim(p["t"]).alias("text"), kind.alias("type"), level.alias("level"), n.alias("length"), (p["b"] - p["a"]).alias("sentence_count"), p["a"].alias("start_idx"), p["b"].alias("end_idx"), phrases.alias("key_phrases"))

    return F.transform(F.filter(texts, lambda p: p["t"] != ""), made)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def average(values: Column) -> Column:
    return V.let(values, lambda v: F.when(F.size(v) > 0, _total(v) / F.size(v)).otherwise(F.lit(0.0)))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return V.let(values, lambda v: V.let(average(v), lambda m: F.sqrt(average(F.transform(v, lambda x: (x - m) * (x - m))))))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def quality(rows: DataFrame, encoder: Encoder) -> DataFrame:
    """Adds ``quality`` of ``paragraphs`` under each document's settings."""
    lengths = F.transform("paragraphs", lambda p: p["length"].cast("double"))
    counts = F.transform("paragraphs", lambda p: p["sentence_count"].cast("double"))
    rows = rows.withColumns(
        {
            "q_n": F.size("paragraphs"),
            "q_short": F.size(F.filter("paragraphs", lambda p: p["length"] < F.col("min_paragraph_length"))),
            "q_long": F.size(F.filter("paragraphs", lambda p: p["length"] > F.col("max_paragraph_length"))),
            "q_vectors": encoder(F.transform("paragraphs", lambda p: p["text"])),
            "q_lengths": lengths,
            "q_counts": counts,
            "q_types": F.transform("paragraphs", lambda p: p["type"]),
        }
    )
    n = F.when(F.col("q_n") > 0, F.col("q_n"))
    content = F.size(F.filter("q_types", lambda t: t == "content")) / n
    rows = rows.withColumns({"q_same": average(V.adjacent(F.col("q_vectors"))), "q_structure": 1 - F.abs(content - 0.8)})
    score = 1 - 0.1 * F.col("q_short") / n - 0.1 * F.col("q_long") / n
    score = score * (1 + F.col("q_same") * 0.2) * F.col("q_structure") * F.when(n < 2, 0.8).when(n > 20, 0.9).otherwise(1.0)
    names = F.array_distinct("q_types")
    distribution = F.map_from_arrays(names, F.transform(names, lambda t: F.size(F.filter("q_types", lambda x: x == t))))
    made = F.struct(
        n.alias("paragraph_count"),
        F.round(average(F.col("q_lengths")), 2).alias("avg_length"),
        F.round(deviation(F.col("q_lengths")), 2).alias("length_std"),
        F.round(average(F.col("q_counts")), 2).alias("avg_sentence_count"),
        F.col("q_short").alias("too_short_count"),
        F.col("q_long").alias("too_long_count"),
        F.round("q_same", 3).alias("semantic_consistency"),
        F.round("q_structure", 3).alias("structure_score"),
        distribution.alias("type_distribution"),
        F.round(clamp(score), 3).alias("quality_score"),
    )
    rows = rows.withColumn("quality", F.when(n > 0, made))
    return rows.drop(*[c for c in rows.columns if c.startswith("q_")])


def with_series(rows: DataFrame, encoder: Encoder, sigma: float = 1.0) -> DataFrame:
    """Adds ``series_1``, ``series_3`` and ``series_5``: smoothed similarities of the sentences at each scale."""
    rows = rows.withColumn("vectors", F.when(F.size("sentences") >= 2, encoder(F.col("sentences")))).withColumn("dots", V.bands(F.col("vectors")))
    for scale in SCALES:
        rows = rows.withColumn(f"raw_{scale}", V.from_bands(F.col("dots"), scale)).withColumn(f"series_{scale}", V.smooth(F.col(f"raw_{scale}"), sigma))
    return rows


def segment_enhanced(docs: DataFrame, config: EngineConfig | None = None, encoder: Encoder | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``text_type``, ``type_confidence``, ``sentence_count``, ``boundary_count``, ``multi_scale_info``, ``paragraphs``, ``quality``, ``config_used`` and ``error``.

    Null, blank and too long texts have an error and null results. Texts of one
    sentence or none have one paragraph and no quality. With ``compat`` "reference"
    the threshold setting moves nothing; otherwise thresholds move by what it
    differs from 0.5. Input columns with the names of results are replaced.
    """
    config = config or EngineConfig()
    encoder = encoder or hashed_encoder(config.dimensions)
    names = ["text_type", "type_confidence", "sentence_count", "boundary_count", "multi_scale_info", "paragraphs", "quality", "config_used", "error"]
    kept = [c for c in docs.columns if c not in names]
    rows = with_series(prepared(docs.select(*kept), config, text_col), encoder, config.smoothing_sigma)
    shift = 0.0 if config.compat == "reference" else config.threshold - 0.5
    found = B.vote({k: F.col(f"series_{k}") for k in SCALES}, F.col("text_type"), shift)
    rows = rows.withColumn("voted", found)
    hints = F.when(F.col("use_structure_hints"), B.structure(F.col("sentences"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("cuts", F.array_sort(F.array_union("voted", hints)))
    rows = rows.withColumn("repaired", B.repair(F.col("sentences"), F.col("cuts"), F.col("min_paragraph_length"), F.col("max_paragraph_length")))
    several = F.size("sentences") >= 2
    whole = F.struct(F.col("normalized").alias("text"), F.lit("content").alias("type"), F.lit(1).alias("level"), F.length("normalized").alias("length"), F.size("sentences").alias("sentence_count"), F.lit(0).alias("start_idx"), F.size("sentences").alias("end_idx"), T.key_phrases(F.col("normalized")).alias("key_phrases"))
    rows = rows.withColumn("paragraphs", F.when(several, paragraphs(F.col("sentences"), F.col("repaired"))).when(F.col("normalized") != "", F.array(whole)))
    rows = quality(rows.withColumn("is_several", several), encoder)
    ok = F.col("normalized").isNotNull()
    settings = [x for name in ("min_paragraph_length", "max_paragraph_length", "use_structure_hints") for x in (F.lit(name), F.col(name).cast("string"))]
    used = F.create_map(F.lit("threshold"), F.lit(str(config.threshold)), F.lit("endings"), F.lit(config.endings), *settings)
    info = F.create_map(*[x for k in SCALES for x in (F.lit(f"scale_{k}"), F.size(f"series_{k}"))])
    return rows.select(
        *kept,
        F.when(ok, F.col("text_type")).alias("text_type"),
        F.when(ok, F.col("confidence")).alias("type_confidence"),
        F.when(ok, F.size("sentences")).alias("sentence_count"),
        F.when(F.col("is_several"), F.size("repaired")).alias("boundary_count"),
        F.when(F.col("is_several"), info).alias("multi_scale_info"),
        "paragraphs",
        F.when(F.col("is_several"), F.col("quality")).alias("quality"),
        F.when(ok, used).alias("config_used"),
        F.when(~ok, F.struct(F.lit("text is missing, blank or too long").alias("error"), F.lit("validation").alias("error_type"))).alias("error"),
    )


def paragraph_rows(segmented: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each paragraph of :func:`segment_enhanced`'s result."""
    return V.rows_of(segmented.select(id_col, "text_type", "paragraphs"), "paragraphs", "p", "para").select(id_col, "text_type", "para", "p.*")


def format_output(segmented: DataFrame, separator: str = "\n\n") -> DataFrame:
    """Adds ``output``: the paragraphs' texts, joined."""
    return segmented.withColumn("output", T.joined(F.transform("paragraphs", lambda p: p["text"]), separator))
