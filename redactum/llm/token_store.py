"""Token-id store: raw id shards with a minimal perfect hash index from document key to offset.

Files of a store, below one folder:
  <name>.ids  the ids of a shard's documents, little-endian unsigned integers, without any framing
  <name>.mph  index of the shard: header, level bitmaps, then per slot a fingerprint, first row and row count,
              then per row the offset and the number of ids
  manifest/   Parquet, a row per document: doc_id, shard name, n_tokens; written by Spark, so only the files of
              attempts that were committed are ever named by it

A key is looked up in constant time: hash once, probe the level bitmaps (expected fewer than two), rank, compare the
stored fingerprint. Keys that are absent are refused by the fingerprint but for a chance of 2^-32.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import common, tokens

MAGIC = b"RMPH0001"
GAMMA = 1.5
MAX_LEVELS = 40
#: Text of a shard: what one task encodes, and whose keys it holds.
SHARD_BYTES = 64 << 20


def key_hash(keys: list[int | None]) -> np.ndarray:
    """64-bit hash of each key's text; the null key has a text of its own."""
    return np.fromiter((xxhash.xxh3_64_intdigest(b"\0null" if k is None else str(k).encode()) for k in keys), np.uint64, len(keys))


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bitmaps: a key lives at the first level where its position is its own; its rank there is its slot."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray]) -> None:
        self.sizes, self.bits = sizes, bits
        self.ranks, base = [], 0
        for b in bits:
            counts = np.unpackbits(b, bitorder="little").reshape(-1, 64).sum(axis=1, dtype=np.int64)
            self.ranks.append(np.concatenate(([base], base + np.cumsum(counts)))[:-1])
            base += int(counts.sum())
        self.n = base

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """hashes: distinct. Expected linear time; ends as two distinct 64-bit values part at some level."""
        left, sizes, bits = hashes, [], []
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = _mix(left, level) % np.uint64(size)
            own = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(own, bitorder="little"))
            left = left[~own[at.astype(np.int64)]]
        if len(left):
            raise ValueError("the hashes are not distinct")
        return cls(sizes, bits)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1 where every level refuses it."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            at = (_mix(hashes[open_], level) % np.uint64(size)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            here, pos = open_[hit], at[hit]
            words = bits.view("<u8")[pos >> 6] & ((np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1))
            out[here] = ranks[pos >> 6] + np.bitwise_count(words).astype(np.int64)
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


class Index:
    """Index of one shard. Rows of a repeated key stand together; the slot names the first and their number."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, first: np.ndarray, rows: np.ndarray, offset: np.ndarray, count: np.ndarray, width: int) -> None:
        self.mph, self.prints, self.first, self.rows, self.offset, self.count, self.width = mph, prints, first, rows, offset, count, width

    @classmethod
    def build(cls, keys: list[int | None], counts: np.ndarray, width: int) -> Index:
        """keys: in the order of the rows, equal keys together."""
        first = np.array([i for i, k in enumerate(keys) if not i or k != keys[i - 1]], np.int64)
        rows = np.diff(np.append(first, len(keys)))
        h = key_hash([keys[i] for i in first])
        mph = PerfectHash.build(h)
        slot = mph.slots(h)
        prints, at, n = np.zeros(mph.n, "<u4"), np.zeros(mph.n, "<u4"), np.zeros(mph.n, "<u4")
        prints[slot], at[slot], n[slot] = (h >> np.uint64(32)).astype("<u4"), first, rows
        offset = np.concatenate(([0], np.cumsum(counts)))[:-1].astype("<u8")
        return cls(mph, prints, at, n, offset, counts.astype("<u4"), width)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        out.write(MAGIC + struct.pack("<IIQQ", self.width, len(self.mph.sizes), self.mph.n, len(self.offset)))
        out.write(np.array(self.mph.sizes, "<u8").tobytes())
        for part in (*self.mph.bits, self.prints, self.first, self.rows, self.offset, self.count):
            out.write(part.tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Index:
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        width, levels, n, n_rows = struct.unpack_from("<IIQQ", data, 8)
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(data, kind, count, at)
            at += part.nbytes
            return part

        sizes = take("<u8", levels).tolist()
        bits = [take("u1", s // 8) for s in sizes]
        return cls(PerfectHash(sizes, bits), take("<u4", n), take("<u4", n), take("<u4", n), take("<u8", n_rows), take("<u4", n_rows), width)

    def find(self, keys: list[int | None]) -> list[tuple[int, int]]:
        """(first row, rows) of each key; rows is 0 where the key is absent."""
        h = key_hash(keys)
        slot = self.mph.slots(h)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == (h[ok] >> np.uint64(32)).astype("<u4")
        return [(int(self.first[s]), int(self.rows[s])) if good else (0, 0) for s, good in zip(slot, ok, strict=True)]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows: local paths, file://, hdfs://, s3://."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_store(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, kind: str = "word", partitions: int | None = None) -> DataFrame:
    """Encode whole texts, write a store below `path`, return its manifest (doc_id, shard, row, n_tokens).

    Shards follow one another in ascending id order (null first; rows with equal ids in any order), so each holds a
    range of ids; their number grows with the text (SHARD_BYTES each) unless `partitions` names it. A null text is
    empty; a text of any length is encoded whole; a repeated id keeps all its rows, in several shards where they are
    many. Other columns are ignored, whatever their names. An empty table gives an empty manifest. Each task writes
    one shard under a name of its own attempt: a retry or a speculative copy leaves files that no manifest names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    n = partitions
    if n is None:
        size = docs.agg(F.sum(F.octet_length(text).cast("long") + 64)).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # the row's own number parts the rows of a hot id, equal ones too; a range of ids is still one run of shards
    rows = rows.withColumn("h", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def encode(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        e = tokens.encoder(tokenizer, kind)
        tail = b"" if end_id is None else int(end_id).to_bytes(e.dtype.itemsize, "little")
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, root = filesystem(path)
        keys, counts, out = [], [], None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in tokens.slices(batch.column(1), tokens.ENCODE_BATCH):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.ids")
                parts = [x + tail for x in e.encode(texts)]
                out.write(b"".join(parts))
                n_tokens = np.array([len(x) // e.dtype.itemsize for x in parts], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array([name] * (b - a)), pa.array(range(len(keys), len(keys) + b - a), pa.int64()), pa.array(n_tokens)], ["doc_id", "shard", "row", "n_tokens"])
                keys += ids[a:b]
                counts.append(n_tokens)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.mph") as f:
                f.write(Index.build(keys, np.concatenate(counts), e.dtype.itemsize).to_bytes())

    rows.mapInArrow(encode, "doc_id long, shard string, row long, n_tokens long").write.parquet(f"{path}/manifest")
    return spark.read.schema("doc_id long, shard string, row long, n_tokens long").parquet(f"{path}/manifest")


class Shard:
    """An open shard: its index in memory, its ids read by offset."""

    def __init__(self, path: str, name: str) -> None:
        store, root = filesystem(path)
        with store.open_input_stream(f"{root}/{name}.mph") as f:
            self.index = Index.from_bytes(f.read())
        self.ids = store.open_input_file(f"{root}/{name}.ids")
        self.dtype = np.dtype(f"<u{self.index.width}")

    def row(self, row: int) -> np.ndarray:
        w = self.index.width
        return np.frombuffer(self.ids.read_at(int(self.index.count[row]) * w, int(self.index.offset[row]) * w), self.dtype)

    def get(self, key: int | None) -> list[np.ndarray]:
        """ids of each of the key's rows in this shard; none where it is absent."""
        first, n = self.index.find([key])[0]
        return [self.row(r) for r in range(first, first + n)]


def shard_starts(manifest: DataFrame) -> DataFrame:
    """(shard, shard_start): ids in all shards before it. A row for each shard, counted before the window."""
    from pyspark.sql import Window

    sums = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shard_start"))


def read_store(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Every document of a store, read back from its files by keyed access.

    Returns doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (unsigned, of unsigned 32-bit
    little-endian ids) and, with_ids, the ids as an array.
    """
    manifest = spark.read.schema("doc_id long, shard string, row long, n_tokens long").parquet(f"{path}/manifest")
    schema = "doc_id long, shard string, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def fetch(batches):
        shards: dict[str, Shard] = {}
        for batch in batches:
            keys, names, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            runs: dict[str, list[int]] = {}
            for i, name in enumerate(names):
                runs.setdefault(name, []).append(i)
            for name, at in runs.items():
                if name not in shards:
                    if len(shards) >= 4:
                        shards.clear()
                    shards[name] = Shard(path, name)
                shard = shards[name]
                for i, (first, n) in zip(at, shard.index.find([keys[i] for i in at]), strict=True):
                    if not first <= rows[i] < first + n:
                        raise ValueError(f"{name}: the index does not lead to document {keys[i]}")
                    ids = shard.row(rows[i])
                    for column, value in zip(out, (keys[i], name, int(shard.index.offset[rows[i]]), len(ids), common.crc_u32(ids), ids.tolist() if with_ids else None), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "shard", "local", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids])

    rows = manifest.select("doc_id", "shard", "row").mapInArrow(fetch, schema)
    starts = shard_starts(manifest)
    return rows.join(starts, "shard").select("doc_id", (F.col("shard_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """ids of a few documents by key: the manifest's range of each shard names the shards that may hold it."""
    manifest = spark.read.schema("doc_id long, shard string, row long, n_tokens long").parquet(f"{path}/manifest")
    wanted = [k for k in keys if k is not None]
    match = F.col("doc_id").isin(wanted) if wanted else F.lit(False)
    if None in keys:
        match = match | F.col("doc_id").isNull()
    out: dict[int | None, list[np.ndarray]] = {k: [] for k in keys}
    for r in manifest.where(match).select("doc_id", "shard").distinct().orderBy("shard").toLocalIterator():
        out[r.doc_id] += Shard(path, r.shard).get(r.doc_id)
    return out


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word_bpe_49k ids in a store, read back by key; see write_store() for hostile rows."""
    path = f"{common.shared_dir(spark)}/tokens"
    docs = common.read_table(spark, sf_dir, "documents")
    write_store(docs, path, common.tokenizer_path("word_bpe_49k.json"))
    return read_store(spark, path)
