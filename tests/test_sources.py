import time

from pyspark.sql import functions as F

from paraweft.config import EngineConfig
from paraweft.operators.jobs import Tasks, expired, with_estimates
from paraweft.operators.multitask import MultiTaskModel
from paraweft.operators.neural import AttentionScorer, segment_multi_task, segment_transformer, synthetic_examples
from paraweft.sources.documents import as_json, checked_requests, read_documents, read_markdown, read_requests, split_quarantine, write_results
from paraweft.streaming.stream import document_stream, segment_stream


def test_requests_are_checked(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"text": "  fine  "}\n{"text": " "}\n{"text": "x", "threshold": 1.5}\n{"text": "x", "force_text_type": "poem"}\n')
    rows = read_requests(spark, str(tmp_path / "r.json"))
    good, bad = split_quarantine(rows)
    assert [(r.text, r.threshold, r.separator) for r in good.collect()] == [("fine", 0.5, "\n\n")]
    assert bad.count() == 3 and checked_requests(spark.createDataFrame([("y" * 20_000,)], "text string")).first().error.error == "text is too long"


def test_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title")
    (tmp_path / "b.markdown").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_text("no")
    got = {r.path.rpartition("/")[2]: (r.markdown, r.error and r.error.error_type) for r in read_markdown(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("# Title", None), "b.markdown": (None, "encoding")}


def test_sinks_and_readers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    for kind in ("parquet", "json", "orc"):
        write_results(rows, str(tmp_path / kind), kind)
        assert read_documents(spark, str(tmp_path / kind), kind, "doc_id long, text string").count() == 2
    write_results(rows.withColumn("output", F.col("text")), str(tmp_path / "text"), "text")
    assert '"doc_id":1' in as_json(rows).first().value


def test_streamed_segments_equal_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    config = EngineConfig(endings="western", max_length=1_000_000)
    q = segment_stream(document_stream(spark, str(tmp_path / "in"), docs.schema), str(tmp_path / "out"), str(tmp_path / "cp"), config, once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("doc_id").distinct().count() == 20 and got.groupBy("doc_id", "para").count().where("count > 1").count() == 0


def test_tasks(spark):
    tasks = Tasks(spark)
    good, bad = tasks.submit(lambda: spark.range(10).count()), tasks.submit(lambda: 1 / 0)
    assert tasks.result(good, 60) == 10 and tasks.result(bad, 60) is None
    assert tasks.status(good)["status"] == "completed" and tasks.status(bad)["status"] == "failed" and tasks.status("none") is None
    assert not tasks.cancel(good) and tasks.cleanup() == 0
    rows = {r.task_id: r for r in with_estimates(tasks.table(), F.lit(time.time())).collect()}
    assert rows[good].message == "completed" and rows[good].remaining is None
    assert expired(tasks.table(), F.lit(time.time() + 1e6)).count() == 2


def test_models(spark):
    docs = synthetic_examples(spark, 60).limit(5).select(F.monotonically_increasing_id().alias("doc_id"), "text")
    config = EngineConfig(endings="western")
    trained = segment_multi_task(docs, MultiTaskModel(), config).collect()
    assert all(0 <= r.quality.quality_score <= 1 and r.paragraphs for r in trained)
    assert [r.paragraphs for r in segment_transformer(docs, config).collect()] == [r.paragraphs for r in segment_transformer(docs, config, scorer=AttentionScorer()).collect()]
