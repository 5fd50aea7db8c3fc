"""Best-fit packing by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactum.llm import common, tokens


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The fullest feasible combination of available lengths that fits into `room`: [(length, how many)].

    Bounded subset sums as one bitset: the multiples of a length are added by powers of two, longest lengths first, and
    the search ends early once `room` itself is reachable. Ties go to the combination of the longest lengths.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length <= room else 0
        take = 1
        while left > 0:
            take = min(take, left)
            new = (reach | reach << (length * take)) & mask
            if new != reach:
                steps.append((reach, length, take))
                reach = new
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return sorted(chosen.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces per bin)])]: minimum bin slack, a combination taken as often as the counts allow.

    The longest remaining piece opens the bin. The work depends on the distinct lengths, at most `capacity` of them,
    and not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    order = [-n for n in left]
    heapq.heapify(order)
    out = []
    while order:
        top = -order[0]
        if top not in left:
            heapq.heappop(order)
            continue
        left[top] -= 1
        combo = dict(fullest({n: c for n, c in left.items() if c > 0}, capacity - top))
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        bins = min(left[n] // m for n, m in combo.items())
        for n, m in combo.items():
            left[n] -= m * bins
            if not left[n]:
                del left[n]
        out.append((bins, sorted(combo.items(), reverse=True)))
    return out


class Placement:
    """Where the i-th piece of a length goes, for every length of a plan."""

    def __init__(self, steps: list[tuple[int, list[tuple[int, int]]]]) -> None:
        self.by_length: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
        first = 0
        for bins, combo in steps:
            offset = 0
            for length, m in combo:
                ends, runs = self.by_length.setdefault(length, ([0], []))
                runs.append((first, m, offset))
                ends.append(ends[-1] + m * bins)
                offset += length * m
            first += bins
        self.bins = first

    def place(self, length: int, i: int) -> tuple[int, int]:
        ends, runs = self.by_length[length]
        k = bisect.bisect_right(ends, i) - 1
        first, m, offset = runs[k]
        j = i - ends[k]
        return first + j // m, offset + j % m * length


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int, id_col: str, text_col: str, kind: str, with_ids: bool, batch_bytes: int | None = None, held: int | None = None) -> DataFrame:
    """Pieces of each document with a rank among the equally long pieces of the same task."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        e = tokens.encoder(tokenizer, kind, limit=held)
        w = e.dtype.itemsize
        tail = int(end_id).to_bytes(w, "little")
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b, texts in tokens.slices(batch.column(1), batch_bytes or tokens.ENCODE_BATCH):
                out: list[list] = [[] for _ in range(7)]
                for key, ids in zip(keys[a:b], e.encode(texts), strict=True):
                    ids += tail
                    n = len(ids) // w
                    end = (n - 1) % capacity + 1  # of the first piece
                    start = piece = 0
                    while start < n:
                        part_ids = np.frombuffer(ids, e.dtype, end - start, start * w)
                        row = (key, piece, start, end - start, common.crc_u32(part_ids), int(seen[end - start]), part_ids.tolist() if with_ids else None)
                        seen[end - start] += 1
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        start, end, piece = end, end + capacity, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
                arrays.append(pa.array([part] * len(out[0]), pa.int32()))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "ids", "part"]
                keep = [i for i in range(8) if with_ids or i != 6]
                yield pa.RecordBatch.from_arrays([arrays[i] for i in keep], [names[i] for i in keep])
        tokens.trim()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<int>" * with_ids + ", part int"
    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kind: str = "spaced", with_ids: bool = False, batch_rows: int | None = None, batch_bytes: int | None = None, held: int | None = None) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as minimum bin slack finds.

    A document is its ids and then `end_id`; only longer ones are cut, into pieces of `capacity` tokens of which the
    first may be shorter. Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and,
    with_ids, the ids. A null or empty text is one piece, the end id; a text of any length is cut whole; repeated rows
    and null ids are packed as documents of their own; which of equally long pieces comes first is free; other columns
    are ignored, whatever their names; an empty table gives no rows.

    Pieces are written once to shared storage; only the histogram of their lengths (at most `capacity` rows) reaches
    the driver, and the plan it yields is bounded likewise. A piece finds its place by its rank among equal lengths: its
    rank in its task plus the counts of earlier tasks, so that no length is gathered in one task.

    A worker gets `batch_rows` rows at once, encodes `batch_bytes` of text together (at least one text) and holds `held`
    pieces already encoded; less of any takes less memory and more time and gives the same ids. None: as the session has
    it, tokens.ENCODE_BATCH and tokens.TABLE_LIMIT.
    """
    spark = docs.sparkSession
    cut = token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, kind=kind, with_ids=with_ids, batch_bytes=batch_bytes, held=held)
    with common.arrow_rows(spark, batch_rows):
        pieces = common.materialize(cut, "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {int(r.length): int(r.n) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placement = spark.sparkContext.broadcast(Placement(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("earlier")).drop("nth", "earlier", "part")

    def place(batches):
        where = placement.value.place
        for batch in batches:
            at = [where(n, i) for n, i in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True)]
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array([x for x, _ in at], pa.int64()))
            yield out.append_column("offset", pa.array([x for _, x in at], pa.int64()))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "rank"] if n != "rank") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte_bpe_50k tokens in sequences of 2048; see pack() for hostile rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    return pack(docs, common.tokenizer_path("byte_bpe_50k.json"))
