"""Corpus preparation in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paraweft.llm import queries
from paraweft.llm.decontamination import decontaminate
from paraweft.llm.mixing import mixed
from paraweft.llm.near_duplicates import near_duplicates
from paraweft.scratch import new_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return queries.judged(docs, sf_dir, COLUMNS).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-copies: that of the smallest id, null ids last; of equal ids, by the text's hash.

    A row is known by id and text, so what is a copy under an id that repeats, or
    under a null id, removes nothing else. Of rows that repeat both, the least
    stays. Only the keys of rows that go or repeat are joined with the texts, and
    repeats are merged by a minimum, so a row that repeats without end costs no task its memory.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.unhex(F.sha2("text", 256)).alias("text"))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    found = near_duplicates(keyed, id_col="key", n=5, percent=80)
    marks = found.groupBy("key").agg(F.bool_and("kept").alias("stays"), F.count(F.lit(1)).alias("times")).where("not stays or times > 1")
    marked = keyed.join(marks, "key", "left")
    once = marked.where("times is null").select(*COLUMNS)
    again = marked.where("stays").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark items."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken."""
    return mixed(docs.select(*COLUMNS), chars_col="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all documents in a token store; each document's place and checksum."""
    return queries.stored_ids(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_ids),
]

#: Alignment, MinHash and tokenization are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    root = new_root(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
