"""The named queries over the test tables. Their SQL is in oracle.py, by the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paraweft.config import SCALES, EngineConfig
from paraweft.functions import text as T, vectors as V
from paraweft.operators import boundaries as B, chinese, classify, markdown, multitask, neural, segment, selection, topics
from paraweft.operators.jobs import with_estimates
from paraweft.plans.oracle import ORACLE_SQL, ZH_TEXTS
from paraweft.sources.documents import checked_requests, validated
from paraweft.streaming.stream import sessions, windowed_counts

__all__ = ["ORACLE_SQL", "QUERIES"]

#: The test texts are Western, of any length; they get Western sentence ends and no limit that any of them passes.
CONFIG = EngineConfig(endings="western", max_length=1_000_000)
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Bytes of a table from which it is worth a shuffle to have all cores work on it.
WORTH = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that fewer tasks read than there are cores, dealt to all; larger tables are read by many tasks and stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size > WORTH and rows._jdf.rdd().getNumPartitions() < cores else rows


def documents(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents"))


def split(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.split_sentences(T.normalize(F.col("text")), "western").alias("sentences"))


@query
def validate_documents(spark, d):
    return validated(documents(spark, d), max_length=10_000).select("doc_id", "is_valid", "error")


@query
def request_validation(spark, d):
    rows = documents(spark, d).select("doc_id", "text", (F.col("doc_id") % 7 / 5).alias("threshold"), F.when(F.col("doc_id") % 3 == 0, "news").when(F.col("doc_id") % 3 == 1, "poem").alias("force_text_type"))
    return checked_requests(rows).select("doc_id", F.col("error.error").alias("error"))


@query
def clean_normalize(spark, d):
    t = F.col("text")
    return documents(spark, d).select("doc_id", T.clean(t).alias("cleaned"), T.normalize_chinese(t).alias("normalized"))


@query
def sentence_split(spark, d):
    return V.rows_of(split(documents(spark, d)).select("doc_id", F.col("sentences").alias("made")), "made", "sentence")


@query
def sentence_stats(spark, d):
    rows = split(documents(spark, d)).withColumn("n", F.transform("sentences", lambda s: F.length(s).cast("double")))
    return rows.select("doc_id", F.size("sentences").alias("n_sentences"), F.round(segment.average(F.col("n")), 6).alias("avg_length"), F.round(segment.deviation(F.col("n")), 6).alias("std_length"))


@query
def sentence_split_report(spark, d):
    rows = V.rows_of(split(documents(spark, d)).select("doc_id", F.col("sentences").alias("made")), "made", "s").drop("pos").join(documents(spark, d).select("doc_id", "lang", "source"), "doc_id")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.round(F.avg(F.length("s")), 6).alias("avg_length"), F.countDistinct("source").alias("n_sources"))


@query
def keyword_counts(spark, d):
    rows = classify.evidence(documents(spark, d))
    return rows.select("doc_id", "technical_keywords", "novel_keywords", "academic_keywords", "news_keywords")


@query
def code_patterns(spark, d):
    return documents(spark, d).select("doc_id", classify.code_patterns(F.col("text")).alias("n"))


@query
def dialogue_patterns(spark, d):
    return documents(spark, d).select("doc_id", classify.dialogue_patterns(F.col("text")).alias("n"), classify.narration_patterns(F.col("text")).alias("narration"))


@query
def sentence_structure(spark, d):
    rows = documents(spark, d).select("doc_id", classify.sentence_structure(F.col("text")).alias("s"))
    return rows.select("doc_id", *[F.round(f"s.{k}", 6).alias(k) for k in ("avg_length", "complexity", "question_ratio")])


def typed(spark, d):
    return classify.detect_text_type(documents(spark, d))


@query
def detect_text_type(spark, d):
    return typed(spark, d).select("doc_id", "text_type", F.round("confidence", 6).alias("confidence"), F.round("max_score", 6).alias("max_score"), "is_mixed")


@query
def type_distribution_by_lang(spark, d):
    return typed(spark, d).groupBy("lang", "text_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query
def segmentation_config_join(spark, d):
    return classify.with_settings(typed(spark, d)).select("doc_id", "text_type", "threshold", "window_size", "min_paragraph_length", "max_paragraph_length", "use_structure_hints")


@query
def key_phrases(spark, d):
    return documents(spark, d).select("doc_id", F.concat_ws("|", T.key_phrases(T.normalize(F.col("text")), 5)).alias("phrases"))


def labelled(spark, d) -> DataFrame:
    """The embeddings as ten documents: of each label, in the order of their ids."""
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")))).alias("rows"))
    return rows.select("label", F.transform("rows", lambda r: r["v"]).alias("vectors"))


@query
def adjacent_similarity_embeddings(spark, d):
    return V.rows_of(labelled(spark, d).select("label", V.adjacent(F.col("vectors")).alias("made")), "made", "sim").select("label", "pos", F.round("sim", 6).alias("sim"))


def scaled(spark, d) -> DataFrame:
    return labelled(spark, d).select("label", *[V.at_scale(F.col("vectors"), s).alias(f"raw_{s}") for s in SCALES])


@query
def multi_scale_similarity(spark, d):
    rows = V.rows_of(scaled(spark, d).select("label", F.arrays_zip("raw_1", "raw_3", "raw_5").alias("made")), "made", "s")
    return rows.select("label", "pos", *[F.round(f"s.raw_{s}", 6).alias(f"scale_{s}") for s in SCALES])


def smoothed(spark, d) -> DataFrame:
    return scaled(spark, d).select("label", *[V.smooth(F.col(f"raw_{s}")).alias(f"series_{s}") for s in SCALES])


@query
def smoothed_similarity(spark, d):
    rows = V.rows_of(smoothed(spark, d).select("label", F.col("series_1").alias("made")), "made", "sim")
    return rows.select("label", "pos", F.round("sim", 6).alias("sim"))


@query
def sliding_window_boundaries(spark, d):
    return V.rows_of(labelled(spark, d).select("label", V.windowed_boundaries(F.col("vectors"), 3, 0.3).alias("made")), "made", "boundary").drop("pos")


@query
def boundary_candidates(spark, d):
    return V.rows_of(smoothed(spark, d).select("label", B.candidates(F.col("series_1"), F.lit(0.05)).alias("made")), "made", "boundary").drop("pos")


@query
def boundary_min_distance(spark, d):
    return V.rows_of(smoothed(spark, d).select("label", B.candidates(F.col("series_1"), F.lit(0.05), 4).alias("made")), "made", "boundary").drop("pos")


@query
def boundary_vote(spark, d):
    series = {s: F.col(f"series_{s}") for s in SCALES}
    return V.rows_of(smoothed(spark, d).select("label", B.vote(series, F.lit("novel")).alias("made")), "made", "boundary").drop("pos")


@query
def structure_boundaries(spark, d):
    return V.rows_of(split(documents(spark, d)).select("doc_id", B.structure(F.col("sentences")).alias("made")), "made", "boundary").drop("pos")


@query
def length_repair(spark, d):
    return V.rows_of(split(documents(spark, d)).select("doc_id", B.repair(F.col("sentences"), every_second(), F.lit(100), F.lit(300)).alias("made")), "made", "boundary").drop("pos")


def every_second():
    """Every second sentence begins a paragraph."""
    n = F.size("sentences")
    return F.when(n > 2, F.sequence(F.lit(2), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))


@query
def transformer_length_repair(spark, d):
    return V.rows_of(split(documents(spark, d)).select("doc_id", B.repair_by_lag(F.col("sentences"), every_second(), F.lit(100), F.lit(300)).alias("made")), "made", "boundary").drop("pos")


def segmented(spark, d) -> DataFrame:
    return segment.segment_enhanced(documents(spark, d), CONFIG)


@query
def segment_enhanced(spark, d):
    rows = segment.paragraph_rows(segmented(spark, d))
    return rows.select("doc_id", "text_type", "para", "text", "type", "length", "sentence_count", "start_idx", "end_idx", F.concat_ws("|", "key_phrases").alias("key_phrases"))


@query
def segment_quality(spark, d):
    q = segmented(spark, d)
    return q.select("doc_id", "text_type", "sentence_count", "boundary_count", *[F.col(f"quality.{k}").alias(k) for k in ("paragraph_count", "avg_length", "length_std", "avg_sentence_count", "too_short_count", "too_long_count", "semantic_consistency", "structure_score", "quality_score")])


@query
def format_output(spark, d):
    return segment.format_output(segmented(spark, d)).select("doc_id", F.md5("output").alias("output_md5"), F.length("output").alias("n_chars"))


@query
def segment_forced_dialogue(spark, d):
    rows = segment.paragraph_rows(segment.segment_enhanced(documents(spark, d), CONFIG.replace(force_type="dialogue", enable_structure_hints=True)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"), F.sum("sentence_count").alias("sentences"))


@query
def segment_transformer(spark, d):
    rows = neural.segment_transformer(documents(spark, d), CONFIG)
    return rows.select("doc_id", "boundary_count", F.size("paragraphs").alias("n_paragraphs"), F.col("quality.quality_score").alias("quality_score"))


@query
def segment_multi_task(spark, d):
    rows = neural.segment_multi_task(documents(spark, d), None, CONFIG)
    return rows.select("doc_id", "text_type", F.size("paragraphs").alias("n_paragraphs"), F.col("quality.quality_score").alias("quality_score"))


@query
def model_boundary_scores(spark, d):
    rows = labelled(spark, d).select("label", neural.model_scores(F.col("vectors"), neural.AttentionScorer()).alias("m"), V.adjacent(F.col("vectors")).alias("sims"))
    return V.rows_of(rows.select("label", B.blended(F.col("m.boundary"), F.col("sims")).alias("made")), "made", "score")


def hybrid(spark, d) -> DataFrame:
    return selection.merge_hybrid(selection.by_method(documents(spark, d), "enhanced", CONFIG), selection.by_method(documents(spark, d), "transformer", CONFIG))


@query
def hybrid_merge(spark, d):
    return hybrid(spark, d).select("doc_id", "selected_method", "enhanced_score", "transformer_score", "selected_score", "improvement", F.size("paragraphs").alias("n_paragraphs"))


@query
def segment_by_method(spark, d):
    rows = selection.segment_by_method(documents(spark, d), CONFIG)
    return rows.select("doc_id", "text_type", "method", "selected_method", "quality_score", "improvement", F.size("paragraphs").alias("n_paragraphs"))


@query
def method_selection(spark, d):
    return typed(spark, d).select("doc_id", "text_type", selection.select_method(F.length("text"), F.col("text_type"), F.when(F.col("doc_id") % 10 == 0, "transformer").otherwise("auto")).alias("method"))


@query
def method_recommendation(spark, d):
    rows = selection.recommend(typed(spark, d))
    return rows.select("doc_id", "recommended_method", F.concat_ws("; ", "reasons").alias("reasons"), F.concat_ws(",", "alternative_methods").alias("alternatives"))


@query
def method_ranking(spark, d):
    rows = documents(spark, d).select("doc_id", F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in selection.METHODS]), F.array(*[F.round(F.pmod(F.col("n_chars") * k, F.lit(101)) / 100, 2) for k in (3, 7, 11, 13)]))).alias("method", "score"))
    return selection.rank_methods(rows)


@query
def method_comparison(spark, d):
    return selection.compare_methods(documents(spark, d), CONFIG, ("enhanced", "transformer", "multi_task"), model=multitask.MultiTaskModel(CONFIG.dimensions))


@query
def segment_joint(spark, d):
    """Types and boundaries by the model of three tasks, its weights from a seed."""
    rows = neural.segment_multi_task(documents(spark, d), multitask.MultiTaskModel(CONFIG.dimensions), CONFIG)
    return rows.select("doc_id", "text_type", "boundary_count", F.size("paragraphs").alias("n_paragraphs"), F.col("quality.quality_score").alias("quality_score"))


def noted(spark, d) -> DataFrame:
    """Documents as Markdown, with every kind of block."""
    c, t = F.col, F.lit
    end = F.when(c("doc_id") % 2 == 0, "end\n\n").otherwise("")
    md = F.concat(t("# "), "source", t("\n\n"), "text", t("\n\n- "), "lang", t("\n- n"), c("n_chars").cast("string"), t("\n\n"), end, t("```text\ndoc "), c("doc_id").cast("string"), t("\n```\n\n> quoted "), "lang", t("\n\n| id | lang |\n|----|------|\n| "), c("doc_id").cast("string"), t(" | "), "lang", t(" |\n\n---"))
    return documents(spark, d).select("doc_id", md.alias("markdown"))


@query
def markdown_parse(spark, d):
    return markdown.parse(noted(spark, d)).select("doc_id", "block", "type", "content", "level", "language", "line_start", "line_end")


@query
def markdown_parse_compat(spark, d):
    return markdown.parse(noted(spark, d), compat="reference").select("doc_id", "block", "type", "line_start", "line_end")


@query
def markdown_stats(spark, d):
    return markdown.statistics(markdown.parse(noted(spark, d)))


@query
def markdown_extract_text(spark, d):
    return markdown.extract_text(markdown.parse(noted(spark, d))).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query
def markdown_reconstruct(spark, d):
    return markdown.reconstruct(markdown.parse(noted(spark, d))).select("doc_id", F.md5("markdown").alias("markdown_md5"), F.length("markdown").alias("n_chars"))


@query
def markdown_chunks(spark, d):
    return markdown.pack(markdown.parse(noted(spark, d)), 1000)


@query
def markdown_segment(spark, d):
    return markdown.segment_blocks(markdown.parse(noted(spark, d)), lambda c: T.split_sentences(c, "western")).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query
def markdown_process(spark, d):
    """Whole Markdown documents: parsed, long paragraphs segmented, put together again."""
    rows = markdown.process(noted(spark, d), CONFIG)
    return rows.select("doc_id", "blocks_original", "blocks_processed", "segmentation_applied", "chunks_used", "file_size", F.md5("processed_markdown").alias("markdown_md5"), F.md5("text_content").alias("text_md5"))


def zh(spark, d) -> DataFrame:
    """A Chinese text for each document: one of the fixed ones, but for the blank ones with a sentence of the document's own."""
    base = F.element_at(F.array(*map(F.lit, ZH_TEXTS)), (F.pmod("doc_id", F.lit(len(ZH_TEXTS))) + 1).cast("int"))
    own = F.concat(F.lit("编号"), F.col("doc_id").cast("string"), F.lit("的文本来自"), "source", F.lit("，共"), F.col("n_chars").cast("string"), F.lit("字。"))
    return documents(spark, d).select("doc_id", F.when(F.trim(base) == "", base).otherwise(F.concat(base, own)).alias("text"))


@query
def zh_ratio(spark, d):
    return zh(spark, d).select("doc_id", F.round(T.chinese_ratio(F.col("text")), 9).alias("ratio"), T.normalize_chinese(F.col("text")).alias("normalized"))


@query
def zh_split(spark, d):
    return V.rows_of(zh(spark, d).select("doc_id", T.split_chinese(F.col("text")).alias("made")), "made", "sentence")


@query
def zh_transitions(spark, d):
    return V.rows_of(zh(spark, d).select("doc_id", chinese.transitions(T.split_sentences(F.col("text"), "zh")).alias("made")), "made", "at").select("doc_id", F.col("at").alias("pos"))


@query
def zh_dialogue(spark, d):
    return V.rows_of(zh(spark, d).select("doc_id", chinese.spoken(F.col("text")).alias("made")), "made", "s").drop("pos").select("doc_id", "s.start", "s.end", "s.content")


@query
def zh_features(spark, d):
    return chinese.features(zh(spark, d)).drop("text")


@query
def zh_keywords(spark, d):
    return chinese.keywords(zh(spark, d), 5)


@query
def zh_narrative_boundaries(spark, d):
    rows = zh(spark, d).withColumn("s", T.split_sentences(F.col("text"), "zh"))
    return V.rows_of(rows.select("doc_id", chinese.narrative_boundaries(F.col("s"), V.adjacent(F.transform("s", lambda x: V.hashed(x)))).alias("made")), "made", "boundary").drop("pos")


@query
def zh_segment(spark, d):
    return segment.paragraph_rows(segment.segment_enhanced(zh(spark, d), EngineConfig(zh_optimize=True))).drop("key_phrases")


def turns(spark, d) -> DataFrame:
    """Conversations as segmented texts: each turn a paragraph."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para"), "text").withColumn("sentences", T.split_sentences(F.col("text"), "western"))


@query
def similarity_matrix(spark, d):
    rows = turns(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", V.hashed(F.col("text")).alias("v")))).alias("r"))
    pairs = V.rows_of(rows.select("doc_id", topics.pair_similarities(F.transform("r", lambda x: x["v"])).alias("made")), "made", "p").drop("pos")
    return pairs.select("doc_id", "p.i", "p.j", F.round("p.sim", 6).alias("sim"))


@query
def lexical_tfidf(spark, d):
    return topics.tfidf(turns(spark, d)).select("doc_id", "para", "term", F.round("weight", 6).alias("weight"))


@query
def lexical_similarity(spark, d):
    return topics.lexical_similarity(topics.tfidf(turns(spark, d)))


@query
def keyword_overlap(spark, d):
    return topics.keyword_overlap(turns(spark, d))


@query
def internal_consistency(spark, d):
    rows = turns(spark, d)
    consistency = topics.internal_consistency(F.transform("sentences", lambda s: V.hashed(s)))
    return rows.select("doc_id", "para", (F.round(consistency, 6) + 0.0).alias("consistency"))  # no negative zero


@query
def consistency_score(spark, d):
    return topics.consistency(turns(spark, d))


@query
def topic_coherence(spark, d):
    rows = turns(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", F.transform(V.hashed(F.col("text")), lambda x: x * x).alias("v")))).alias("r"))
    rows = rows.select("doc_id", topics.topic_scores(F.transform("r", lambda x: x["v"])).alias("t"))
    return rows.select("doc_id", F.round("t.coherence", 6).alias("coherence"), F.round("t.smoothness", 6).alias("smoothness"), F.size("t.boundaries").alias("n_boundaries"))


@query
def topic_model(spark, d):
    rows = topics.topic_model(turns(spark, d))
    return rows.select("doc_id", "para", F.size("topics").alias("n_topics"), "main_topic", F.round("confidence", 4).alias("confidence"), F.concat_ws("|", "words").alias("words"))


@query
def consistency_by_topics(spark, d):
    rows = turns(spark, d)
    return topics.consistency(rows, topics=topics.topic_model(rows))


@query
def task_status_rollup(spark, d):
    e = table(spark, d, "events")
    tasks = e.select(F.col("event_id").alias("task_id"), F.when(F.col("event_id") % 4 == 0, "completed").when(F.col("event_id") % 4 == 1, "pending").otherwise("processing").alias("status"), (F.col("event_id") % 100).cast("int").alias("progress"), F.lit(0.0).alias("started"), F.when(F.col("event_id") % 4 == 0, F.lit(60.0)).alias("ended"))
    return with_estimates(tasks, F.lit(120.0)).groupBy("status", "message").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("remaining"), 3).alias("remaining"))


@query
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"))


@query
def event_sessions(spark, d):
    return sessions(table(spark, d, "events"))


@query
def deduplicated_sentences(spark, d):
    """What an embedding cache saves: each different sentence once, with how often it comes."""
    rows = V.rows_of(split(documents(spark, d)).select("doc_id", F.col("sentences").alias("made")), "made", "sentence").drop("pos")
    return rows.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query
def longest_sentences(spark, d):
    """A top-k report: the three longest sentences of each language."""
    rows = V.rows_of(split(documents(spark, d)).select("doc_id", F.col("sentences").alias("made")), "made", "s").join(documents(spark, d).select("doc_id", "lang"), "doc_id")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "doc_id", "pos")
    return rows.withColumn("n", F.length("s")).withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("lang", "rank", "doc_id", "pos", "n")
