"""SimHash, pigeonring links and components against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from redactum.llm import components, simhash
from tests.llm.fixtures import BASE, frame, rows


def fingerprint(text, k):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).replace(b"\x0b", b" ").replace(b"\x0c", b" ")
    w = [x for x in w.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").split(b" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(values, distance=3):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near_set(n, seed):
    """Fingerprints in clusters and chains, and far ones."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n // 20):
        c = rng.getrandbits(64)
        for _ in range(20):
            out.add(c)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                c ^= 1 << b
    return sorted(out)


def test_fingerprints():
    texts = [r[1] or "" for r in rows()]
    for k in (3, 5):
        assert simhash.fingerprints(texts, words_per_shingle=k).tolist() == [fingerprint(t, k) for t in texts]


def test_pigeonring_keeps_every_near_pair():
    rng = random.Random(2)
    for m in (4, 5, 6, 8):
        ring = simhash.Ring(3, m)
        x = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(5000)], np.uint64)
        chains = np.array([ring.within(x, k) for k in range(m)])
        assert (chains.any(axis=0) == (np.bitwise_count(x) <= 3)).all()
        for i, v in enumerate(x.tolist()):
            for k in range(m):  # what a chain accepts shares its key, up to one loose bit
                inside = v & ring.key_mask(k)
                assert not chains[k, i] or inside == 0 or (inside.bit_count() == 1 and inside.bit_length() - 1 in ring.loose_bits(k))


def links_of(spark, values, **how):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    return simhash.fingerprint_links(spark.createDataFrame(signed, "fp long").repartition(3), **how)


def check_links(spark, values, **how):
    found = components.components(links_of(spark, values, **how)).collect()
    groups = defaultdict(set)
    known = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
    for v in values:
        groups[known.get(v, v)].add(v)
    want = defaultdict(set)
    for v, r in roots(values).items():
        want[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_fewer_candidates_than_by_exact_segments(spark):
    """The pigeonhole index compares all that share one of four exact segments; the chain's prefix leaves few of them."""
    rng = random.Random(5)
    # far fingerprints over few values of each 16-bit segment, so that exact segments are shared by many
    pool = [rng.getrandbits(16) for _ in range(60)]
    values = sorted({sum(rng.choice(pool) << 16 * j for j in range(4)) for _ in range(4000)} | set(near_set(100, 6)))
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    ring = simhash.Ring(3, 4)
    pairs = 0
    for r in simhash.deal(signed, ring).groupBy("k", "part").agg(F.sum(F.col("own").cast("long")).alias("o"), F.sum((~F.col("own")).cast("long")).alias("x")).collect():
        pairs += r.o * (r.o - 1) // 2 + r.o * r.x
    holes = Counter((j, v >> 16 * j & 0xFFFF) for v in values for j in range(4))
    assert pairs * 10 < sum(n * (n - 1) // 2 for n in holes.values())
    check_links(spark, values)


def test_links_in_pairs_and_through_neighbourhoods(spark):
    values = near_set(300, 4)
    check_links(spark, values)
    check_links(spark, values, segments=6)
    check_links(spark, near_set(60, 9), limit=3)  # nearly every shared key counts as too large


def test_near_duplicates(spark):
    got = simhash.near_duplicates(frame(spark), words_per_shingle=3).collect()
    fp = [(r[0], fingerprint(r[1], 3)) for r in rows()]
    root = roots([f for _, f in fp])
    least = {}
    for d, f in fp:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    assert Counter(map(tuple, got)) == Counter((d, f"{f:016x}", least.get(root[f])) for d, f in fp)
    assert simhash.near_duplicates(frame(spark, []), words_per_shingle=3).count() == 0


def test_one_per_group(spark):
    kept = simhash.one_per_group(frame(spark), words_per_shingle=3)
    assert kept.columns == frame(spark).columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(BASE) <= 1 and len(texts) == len(set(map(str, texts)))
    groups = simhash.near_duplicates(frame(spark), words_per_shingle=3, details=True).select("group").distinct().count()
    assert len(texts) == groups


def test_no_column_is_overwritten(spark):
    docs = spark.createDataFrame([(1, BASE, 10, "a", 7, "z"), (2, "other words here", 20, "b", 8, "y"), (3, BASE, 30, "c", 9, "x")], "doc_id long, text string, _id long, _hash string, id long, hash string")
    assert sorted(map(tuple, simhash.one_per_group(docs).collect())) == [(1, BASE, 10, "a", 7, "z"), (2, "other words here", 20, "b", 8, "y")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(5, 5), (7, 6), (200, 300), (-4, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 130)}, 200: -4, 300: -4}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_no_pairs_are_made_for_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(BASE).alias("text"))
    got = simhash.near_duplicates(docs, words_per_shingle=3)
    assert got.select("component_id").distinct().collect() == [(0,)] and got.count() == 3000
