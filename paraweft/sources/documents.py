"""Where documents come from and where results go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paraweft.functions import text as T

REQUEST = "text string, threshold double, separator string, enable_auto_threshold boolean, enable_structure_hints boolean, enable_hierarchical_output boolean, force_text_type string"
TYPES = ("technical", "novel", "academic", "news", "dialogue", "mixed")


def read_documents(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None) -> DataFrame:
    """Documents from Parquet, JSON, CSV, ORC or text files (a file a document)."""
    reader = spark.read.schema(schema) if schema else spark.read
    if format == "text":
        return spark.read.option("wholetext", "true").text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    return reader.option("header", "true").format(format).load(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Segmentation requests, one JSON object a line, as :func:`checked_requests` has them."""
    return checked_requests(spark.read.schema(REQUEST).json(path))


def checked_requests(requests: DataFrame, max_length: int = 10_000) -> DataFrame:
    """Requests with stripped text, defaults for what is missing, and ``error`` for those that can't be run."""
    have = set(requests.columns)
    col = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    strip = f"^{T.WS}+|{T.WS}+$"
    rows = requests.withColumns(
        {
            "text": F.regexp_replace("text", strip, ""),
            "threshold": col("threshold", 0.5),
            "separator": col("separator", "\n\n"),
            "enable_auto_threshold": col("enable_auto_threshold", True),
            "enable_structure_hints": col("enable_structure_hints", True),
            "enable_hierarchical_output": col("enable_hierarchical_output", True),
            "force_text_type": F.col("force_text_type") if "force_text_type" in have else F.lit(None).cast("string"),
        }
    )
    return rows.withColumn("error", request_error(max_length))


def request_error(max_length: int) -> Column:
    kind = F.col("force_text_type")
    return (
        F.when(F.col("text").isNull() | (F.col("text") == ""), error("text is missing or blank", "validation"))
        .when(F.length("text") > max_length, error("text is too long", "validation"))
        .when(~F.col("threshold").between(0.0, 1.0), error("threshold is not within 0 and 1", "validation"))
        .when(kind.isNotNull() & ~kind.isin(*TYPES), error("unknown text type", "validation"))
    )


def error(message: str, kind: str, details: Column | None = None) -> Column:
    return F.struct(F.lit(message).alias("error"), F.lit(kind).alias("error_type"), (details if details is not None else F.lit(None).cast("string")).alias("details"))


def read_markdown(spark: SparkSession, path: str, max_megabytes: int = 50) -> DataFrame:
    """``(path, markdown, error)`` of .md and .markdown files; too large ones and those that aren't UTF-8 have an error and no text.

    Files that are too large are not loaded: the size is checked on the listing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{md,markdown}").option("recursiveFileLookup", "true").load(path)
    too_large = F.col("length") > max_megabytes << 20
    content = F.when(~too_large, F.col("content"))
    valid = F.is_valid_utf8(content.cast("string"))
    return files.select(
        "path",
        F.when(~too_large & valid, content.cast("string")).alias("markdown"),
        F.when(too_large, error("file is too large", "file_size", F.col("length").cast("string"))).when(~valid, error("file isn't UTF-8", "encoding")).alias("error"),
    )


def validated(docs: DataFrame, text_col: str = "text", max_length: int = 10_000) -> DataFrame:
    """Adds ``is_valid`` and, for the others, ``error``."""
    ok = T.is_valid(F.col(text_col), max_length)
    why = F.when(F.col(text_col).isNull() | ~F.col(text_col).rlike(T.NOT_WS), "blank").otherwise("too long")
    return docs.withColumns({"is_valid": ok, "error": F.when(~ok, why)})


def split_quarantine(rows: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one."""
    return rows.where(F.col(error_col).isNull()), rows.where(F.col(error_col).isNotNull())


def write_results(rows: DataFrame, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Results as Parquet, ORC or JSON; as text, the column ``output`` or one JSON object a line."""
    if format == "text":
        value = F.col("output") if "output" in rows.columns else F.to_json(F.struct("*"))
        rows.select(value.alias("value")).write.mode(mode).text(path)
    else:
        rows.write.mode(mode).format(format).save(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON response a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
