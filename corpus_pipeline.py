"""A training corpus from raw documents: language, near-duplicates, benchmarks, secrets, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents. Stages are written as Parquet and read again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from redactum.llm import common, decontaminate, language_id, packing, secrets, simhash

#: Languages of the corpus, and the mean probability that most of a text must reach.
LANGUAGES: list[str] | None = None
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES (None: any that the labels teach) with a score of LEAST_SCORE or more; texts of
    mixed or unclear language, null texts and texts without a letter go."""
    return language_id.keep_identified(docs, *language_id.train(docs), wanted=LANGUAGES, min_score=LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one of the smallest id."""
    return simhash.one_per_group(docs, words_per_shingle=3, distance=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window."""
    return decontaminate.keep_clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars adjusted."""
    return secrets.mask_documents(docs, common.tokenizer_path("byte_bpe_50k.tiktoken"), length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens.

    The executor's heap has grown in the stages before and stays so; beside it the workers encode in small parts."""
    return packing.pack(docs, common.tokenizer_path("byte_bpe_50k.json"), batch_rows=500, batch_bytes=2_000_000, held=50_000)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Hashing, networks and packing have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
