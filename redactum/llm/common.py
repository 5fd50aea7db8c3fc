"""Shared helpers of the training-data operators: shared storage, projection, hashing, tokenizer access."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the public vocabulary files; operators take full paths, this is only their default place.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file: the installed package's place, else TOKENIZER_DIR."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the session has no such setting (tests on one machine) a temporary folder is set as checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="redactum-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/redactum-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int | None):
    """While it lasts, what runs hands workers at most so many rows at once (None: as the session has it)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, before if rows is None else str(rows))
        yield
    finally:
        spark.conf.set(name, before)


class Rounds:
    """Tables written round by round; a round's table goes once two later ones stand, as no plan reads it any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.name, self.n = spark, shared_dir(spark), name, 0

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.name}-{self.n}"
        df.write.parquet(path)
        if self.n >= 2:
            delete(self.spark, f"{self.base}/{self.name}-{self.n - 2}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; every other column, whatever its name, is left behind."""
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in columns.items()])


def crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; the fold that holds a row out where it is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def crc_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same where all characters are ASCII, and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
