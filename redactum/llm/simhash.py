"""SimHash near-duplicates; pigeonring filtering finds fingerprints within a Hamming distance."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactum.llm import common, tokens
from redactum.llm.components import components

#: Fingerprints of one key compared in one task; larger keys go through neighbourhoods instead of pairs.
BUCKET_LIMIT = 4096


def fingerprints(texts: list[str], *, words_per_shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if it is set in over half of the shingles' XXH64, repeats included."""
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    out = np.zeros(len(texts), np.uint64)
    hashes, ends, at = [], [], []
    n = 0

    def flush() -> None:
        nonlocal n
        if not at:
            return
        h = np.concatenate(hashes)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.array([0, *ends[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        sizes = np.diff(np.array([0, *ends]))
        out[at] = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        hashes.clear(), ends.clear(), at.clear()
        n = 0

    k = words_per_shingle
    for i, text in enumerate(texts):
        w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not w:
            continue
        shingles = map(b" ".join, zip(*(w[j:] for j in range(k)))) if len(w) >= k else [b" ".join(w)]
        count = max(1, len(w) - k + 1)
        hashes.append(np.fromiter(map(digest, shingles), np.uint64, count))
        n += count
        ends.append(n)
        at.append(i)
        if n > 200_000:
            flush()
    flush()
    return out


class Ring:
    """The bits of a fingerprint as a ring of segments.

    Pigeonring: if two fingerprints differ in at most `distance` bits, then some segment starts a chain around the ring
    in which, for every length l, the first l segments differ in at most floor(l * distance / segments) bits together.
    The first `prefix` segments of a chain are its key: the most that allow one differing bit, so that a fingerprint is
    dealt by its own bits and once more for each set bit that it may have too many; the two sides of a pair within the
    budgets of the prefix meet in exactly one of these.
    """

    def __init__(self, distance: int, segments: int, prefix: int | None = None) -> None:
        if segments <= distance:
            raise ValueError("a chain starts with an exact segment: more segments than differing bits are needed")
        self.distance, self.m = distance, segments
        edges = [round(64 * i / segments) for i in range(segments + 1)]
        self.masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
        self.budget = [(n * distance) // segments for n in range(1, segments + 1)]
        at_most_one = sum(b <= 1 for b in self.budget)
        self.prefix = at_most_one if prefix is None else min(prefix, at_most_one)

    def chain(self, start: int, length: int) -> list[int]:
        return [(start + n) % self.m for n in range(length)]

    def key_mask(self, start: int) -> int:
        return sum(self.masks[j] for j in self.chain(start, self.prefix))

    def loose_bits(self, start: int) -> list[int]:
        """Bits of the prefix in which a pair may differ (in one of them)."""
        loose = sum(self.masks[j] for n, j in enumerate(self.chain(start, self.prefix)) if self.budget[n])
        return [b for b in range(64) if loose >> b & 1]

    def within(self, x: np.ndarray, start: int) -> np.ndarray:
        """x: xor of pairs. True where the chain from `start` keeps all its budgets; the last one is the distance.

        Only pairs that still keep them are looked at further: a broken budget ends a chain before the full count."""
        left, total = np.arange(len(x)), np.zeros(len(x), np.uint8)
        for n, j in enumerate(self.chain(start, self.m)):
            total = total + np.bitwise_count(x[left] & np.uint64(self.masks[j]))
            keep = total <= self.budget[n]
            if not keep.all():
                left, total = left[keep], total[keep]
            if not len(left):
                break
        ok = np.zeros(len(x), bool)
        ok[left] = True
        return ok


def bucket_links(values: np.ndarray, ring: Ring, start: int, part: int) -> list[tuple[int, int]]:
    """Links that span the components among one key's fingerprints: at most one for each.

    Fingerprints whose own bits are the key meet all others; two that both differ from it in a bit are no candidates.
    """
    f = np.unique(values.astype(np.int64)).view(np.uint64)
    own = (f & np.uint64(ring.key_mask(start))) == np.uint64(part % (1 << 64))
    f = np.concatenate([f[own], f[~own]])
    n = len(f)
    root = np.arange(n)
    for i in range(int(own.sum())):
        hit = np.flatnonzero(ring.within(f[i] ^ f[i + 1 :], start))
        if len(hit):
            roots = np.unique(root[np.append(hit + i + 1, i)])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    signed = f.view(np.int64)
    return [(int(signed[i]), int(signed[r])) for i, r in enumerate(root) if i != r]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(prints: DataFrame, ring: Ring) -> DataFrame:
    """(fp, k, part, own): the keys of each fingerprint. k is the segment where the chain starts, part the bits of its
    prefix, own whether these are the fingerprint's bits or those of a partner with one set bit fewer."""
    fp = F.col("fp")

    def keys(k: int) -> Column:
        part = fp.bitwiseAND(F.lit(_signed(ring.key_mask(k))))
        key = lambda bits, own: F.struct(F.lit(k).alias("k"), bits.alias("part"), F.lit(own).alias("own"))
        loose = F.filter(F.lit([_signed(1 << b) for b in ring.loose_bits(k)]).cast("array<bigint>"), lambda bit: fp.bitwiseAND(bit) != 0)
        return F.concat(F.array(key(part, True)), F.transform(loose, lambda bit: key(part.bitwiseXOR(bit), False)))

    dealt = prints.select("fp", F.explode(F.concat(*map(keys, range(ring.m)))).alias("x"))
    return dealt.select("fp", "x.k", "x.part", "x.own")


def fingerprint_links(prints: DataFrame, *, distance: int = 3, segments: int | None = None, limit: int = BUCKET_LIMIT) -> DataFrame:
    """prints (fp), distinct longs. Links (u, v) that connect all fingerprints within `distance` bits, directly or not.

    Each fingerprint is dealt by the chain prefixes of its segments (see Ring); what shares a key has passed the first
    steps of its chain, and an Arrow function carries the cumulative difference on around the ring, stops at the first
    broken budget and returns spanning links only. Keys of more than `limit` fingerprints are never gathered: their
    members meet at values between them, a fixed number for each, and a link to the smallest one there connects them.
    The function takes any table with a long column fp; nulls link to nothing; an empty table gives no links.
    """
    ring = Ring(distance, segments or distance + 1)
    dealt = deal(prints.where("fp IS NOT NULL"), ring)  # cheaper to deal again than to write
    counted = dealt.groupBy("k", "part").agg(F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("owners"))
    sizes = common.materialize(counted.where("n > 1 AND owners > 0").select("k", "part", "n"), "sizes")
    few = dealt.join(sizes.where(F.col("n") <= limit), ["k", "part"], "left_semi")

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def spanning(groups: pd.Series, starts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([[{"u": u, "v": v} for u, v in bucket_links(np.asarray(g), ring, int(k), int(p))] for g, k, p in zip(groups, starts, parts, strict=True)])

    # a number of partitions of its own: the comparisons are more work than their bytes tell
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = few.repartition(tasks, "k", "part").groupBy("k", "part").agg(F.collect_list("fp").alias("fps"))
    links = gathered.select(F.explode(spanning("fps", "k", "part")).alias("l")).select("l.u", "l.v")
    many = sizes.where(F.col("n") > limit)
    if not many.isEmpty():
        links = links.unionByName(neighbourhood_links(dealt.join(many, ["k", "part"], "left_semi"), ring))
    return links.distinct()


def neighbourhood_links(hot: DataFrame, ring: Ring) -> DataFrame:
    """Links within the keys of `hot` (fp, k, part, own), at a fixed cost for each of its rows.

    Two fingerprints at most d bits apart outside the key's mask have a value within d // 2 bits of the one and
    d - d // 2 of the other. Owners of a key meet each other at d = distance; the others, which have spent one bit in
    the key, meet the owners at d = distance - 1. A link to the smallest owner at a value connects all that meet there,
    as the owners there are themselves linked.
    """
    out = None
    for k in range(ring.m):
        free = [b for b in range(64) if not ring.key_mask(k) >> b & 1]
        flips = lambda most, free=free: F.lit([_signed(sum(1 << b for b in c)) for n in range(most + 1) for c in combinations(free, n)]).cast("array<bigint>")
        rows = hot.where(F.col("k") == k).select("fp", "part", "own", F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in free)))).alias("rest"))
        at = lambda who, most, flips=flips, rows=rows: rows.where(who).select("fp", "part", F.explode(flips(most)).alias("x"), "rest").select("fp", "part", F.col("rest").bitwiseXOR(F.col("x")).alias("at"))
        for who, d in (("own", ring.distance), ("NOT own", ring.distance - 1)):
            centre = at("own", d // 2).groupBy("part", "at").agg(F.min("fp").alias("v"))
            links = at(who, d - d // 2).withColumnRenamed("fp", "u").join(centre, ["part", "at"]).select("u", "v").where("u <> v").distinct()
            out = links if out is None else out.unionByName(links)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, distance: int = 3, segments: int | None = None, details: bool = False) -> DataFrame:
    """Per row: doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable).

    With details also text_hash (xxhash64 of the text) and group, a number of the component.

    A null, empty or wordless text has fingerprint zero and links like any other; a long text is read whole. Copies
    share a fingerprint and are compared once; repeated rows stay. A null doc_id never names a component: such rows
    take the smallest id they reach, null if they reach none. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """

    def run(batches):
        tokens.release()
        for batch in batches:
            for a, b, texts in tokens.slices(batch.column(1), 2_000_000):
                fp = fingerprints(texts, words_per_shingle=words_per_shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(fp.view(np.int64)), batch.column(2)[a:b]], ["doc_id", "fp", "text_hash"])
        tokens.trim()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = common.materialize(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long"), "fingerprints")
    prints = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(prints.select("fp"), distance=distance, segments=segments))
    rooted = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", F.col("root").alias("group"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *["text_hash", "group"] * details)


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, distance: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, that represent their near-duplicate group: of each group the row of
    the smallest id (ids before null), then of the smallest text hash; of rows equal in both one stays.

    Null, empty and wordless texts are one group with all that link to them; long texts are read whole; other columns
    are passed on unchanged, whatever their names; an empty table stays empty.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, words_per_shingle=words_per_shingle, distance=distance, details=True)
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    lowest = F.lit(-(1 << 63))
    kept = first.select(F.coalesce("x.doc_id", lowest).alias("id"), F.col("x.text_hash").alias("hash"))
    # the row travels as one struct, so that no name of its columns can clash
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), lowest).alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("hash"), whole)
    return rows.join(kept, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("whole.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 3-word shingles and 3 bits; see near_duplicates() for hostile rows."""
    return near_duplicates(common.read_table(spark, sf_dir, "documents"), words_per_shingle=3, distance=3)
