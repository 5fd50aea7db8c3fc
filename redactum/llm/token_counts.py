"""Token counts by distinct pre-token: pieces are counted once, joined to per-document frequencies and summed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import common, tokens


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", kind: str = "word", limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Each batch of documents becomes a table of pre-token frequencies per document; pre-tokens not yet in the task's
    table are given to the library once each; frequencies are joined to the counts and summed per document. Special
    strings in a text count as one token each. No text is encoded whole, however long, and ids are not kept. A null
    text is empty (zero tokens); repeated rows and ties stay; null ids stay null; other columns are ignored, whatever
    their names; an empty table gives no rows. Frequencies never leave the task, so there is no shuffle, and a lost
    executor costs only its own tasks.
    """

    def run(batches):
        table = tokens.encoder(tokenizer, kind, counts_only=True)
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in tokens.slices(batch.column(1)):
                n = np.array(table.count(texts), np.int64)
                yield pa.RecordBatch.from_arrays([ids[a:b], batch.column(2)[a:b], pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents under word_bpe_49k; see count_tokens() for hostile rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    return count_tokens(docs, common.tokenizer_path("word_bpe_49k.json"))
