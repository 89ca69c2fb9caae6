"""Token counts with a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paraweft.llm.tokens import Proof, encoder


def _pieces(path: str):
    """Arrow function for sentencepiece models: every text through the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            counts = [len(model.encode(t.as_py() or "", num_threads=1)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    return run


def _byte_level(path: str, proof):
    """Arrow function: (text, rest) to (rest, number of tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, proof)
        for batch in batches:
            counts = enc.counts(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], names=[*batch.schema.names[1:], "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each text by the tokenizer file (``.json`` or ``.model``).

    For byte-level BPE, the driver proves once, by asking the library, which
    vocabulary strings encode alone as one token, and the class of every
    character of the first three planes; both tables (at most the vocabulary and
    196,608 bytes) are broadcast. On the executors texts are cut into pre-tokens;
    those that are whole tokens, byte for byte, count one each, and only the rest
    are merged, each distinct one once for as long as a worker's table holds it.
    Texts with a character beyond those planes or with the string of an added
    token go through the library whole, as all do for other tokenizers. No token is added and nothing is cut off; a special
    token's string inside a text is that one token, the library's default.

    A null text counts as empty: 0 bytes and tokens. Rows aren't shuffled and
    rows that repeat give repeated results; other columns aren't read. The file
    must be at the same path on every executor.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("text"), F.col(id_col).alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long"
    if tokenizer.endswith(".model"):
        out = rows.mapInArrow(_pieces(tokenizer), schema)
    else:
        proof = docs.sparkSession.sparkContext.broadcast(Proof(tokenizer))
        out = rows.mapInArrow(_byte_level(tokenizer, proof), schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
