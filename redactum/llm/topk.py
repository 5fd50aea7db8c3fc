"""Exact top-k inner products from an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactum.llm import common
from redactum.llm.token_store import filesystem

#: Vectors of an index block and queries of a query block; both bound what a task holds.
BLOCK, QUERY_BLOCK, LANES = 8192, 1024, 256
#: Largest quantised impact.
TOP = 127


class ImpactIndex:
    """Posting segments of one block: for each impact level, highest first, and each dimension, (vector, impact).

    An impact is a component divided by `step` and rounded; a level holds the impacts of one power of two. `rest` has,
    for each level and dimension, the largest part of a component that is still unseen once that level is done.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.step = max(1, -(-int(np.abs(x).max(initial=0)) // TOP))
        impact = (x + self.step // 2) // self.step
        self.error = np.abs(x - impact * self.step).max(axis=0, initial=0)
        level = np.frexp(np.abs(impact).astype(np.float64))[1]
        self.levels, self.rest = [], []
        for n in range(int(level.max(initial=0)), 0, -1):
            segments = []
            for d in range(x.shape[1]):
                rows = np.flatnonzero(level[:, d] == n)
                if len(rows):
                    segments.append((d, rows, (impact[rows, d] * self.step).astype(np.float64)))
            self.levels.append(segments)
            self.rest.append(np.where(level < n, np.abs(impact) * self.step, 0).max(axis=0, initial=0))
        self.where: dict[int, list[int]] = {}
        for i, v in enumerate(ids.tolist()):
            self.where.setdefault(v, []).append(i)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(positions, exact scores) of at most k best per query; ties to the smaller id. The query's own id is left out."""
        out: list = [None] * len(q)
        active = np.arange(len(q))
        size = np.abs(q).astype(np.float64)
        seen = np.zeros((len(self.ids), len(q)))
        own = [self.where.get(int(i), []) for i in query_ids]
        for n, segments in enumerate(self.levels or [[]]):
            weights = q[active].T.astype(np.float64)
            for d, rows, impact in segments:
                seen[rows] += impact[:, None] * weights[d]
            last = n + 1 >= len(self.levels)
            unseen = self.error + (0 if not self.levels else self.rest[n])
            slack = size[active] @ unseen
            for lane, i in enumerate(active):
                seen[own[i], lane] = -np.inf
            # a vector may be among the k best only if its upper bound reaches the k-th lower bound
            kth = np.partition(seen, len(self.ids) - k, axis=0)[len(self.ids) - k] if len(self.ids) > k else np.full(len(active), -np.inf)
            possible = (seen >= kth - 2 * slack - 1e-6) & (seen > -np.inf)
            done = np.full(len(active), True) if last else possible.sum(axis=0) <= 4 * k + 60
            for lane in np.flatnonzero(done):
                out[active[lane]] = self.best(np.flatnonzero(possible[:, lane]), q[active[lane]], k)
            if done.all():
                break
            active, seen = active[~done], np.ascontiguousarray(seen[:, ~done])
        return out

    def best(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = self.x[rows] @ q
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, short ones filled with zeros."""
    n = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _parts(folder: str):
    """Batches of at most QUERY_BLOCK queries of the files in a folder of the shared store."""
    store, root = filesystem(folder)
    for info in sorted(store.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(QUERY_BLOCK)


def integers(vector: Column) -> Column:
    """floor(256 * x) of every component as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: finite(x.cast("double")))


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Queries are the rows whose id is divisible by `every`, candidates all rows with another id. Null ids, null
    vectors and vectors with a null or non-finite component take no part. A repeated candidate row counts as often
    as it stands, a repeated query row is answered as often; shorter vectors are filled with zeros. Integers must stay
    below 2^53 in sum. Other columns are ignored; an empty table gives no rows.

    Candidates are packed into blocks of bounded size and shuffled once; queries are written once as files of bounded
    parts, which the task of every block reads one after the other. It returns k rows for each query, and a window
    picks the best of these.
    """
    spark = vectors.sparkSession
    x = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    x = common.materialize(x.select("vec_id", integers(F.col("v")).alias("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.col("vec_id") % every == 0
    sizes = x.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("v")).alias("d")).first()
    blocks, width = max(1, -(-sizes.n // BLOCK)), max(1, sizes.d or 0)
    folder = f"{common.shared_dir(spark)}/queries"
    x.where(is_query).select("vec_id", "row", "v").repartition(max(1, -(-sizes.q // (16 * QUERY_BLOCK)))).write.parquet(folder)
    packed = x.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    candidates = packed.select(F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vs"))

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                index = ImpactIndex(one.column(0).flatten().to_numpy(), _matrix(one.column(1).flatten(), width))
                for part in _parts(folder):
                    names, rows, q = part.column("vec_id").to_numpy(), part.column("row").to_numpy(), _matrix(part.column("v"), width)
                    for a in range(0, len(q), LANES):
                        found = index.search(names[a : a + LANES], q[a : a + LANES], k)
                        n = [len(p) for p, _ in found]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(names[a : a + LANES], n)), pa.array(np.repeat(rows[a : a + LANES], n)), pa.array(np.concatenate([index.ids[p] for p, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                            ["query_id", "row", "vec_id", "score"],
                        )

    best = candidates.mapInArrow(search, "query_id long, row long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for every query row; see top_k() for hostile rows."""
    return top_k(common.read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
