"""Profile tables: indexes, lookups, fuzzy and vector matching, merging, gates and audits."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T

# fixed values: word lists that decide which mined spans are noise
NOISE_TYPES = ["drug", "health-condition", "medical-procedure", "injury"]
KEEP = r"tocopherol|ascorbic|lipoic|cholecalciferol|niacin|riboflavin|thiamine|folic|pantothen|biotin|aminobutyric|retino|calciferol|menadione|pyridoxine|cobalamin|\binhibitor\b"
KEEP_TOKENS = "azo mmr pcp cla pop cad cva gerd copd cf chf dvt uti tia ckd mi ms ra ed tb af paraldehyde".split()
DEVICES = r"\b(wrap|wraps|bandage|gauze|tape|swab|kit|dressing|brace|splint|sponge|applicator|cloth|wipe|wipes|pump|pumps|catheter|catheters|stent|stents|pacemaker|pacemakers|nebulizer|nebulizers)\b"
ANATOMY = ["arm", "leg", "knee", "hip", "shoulder", "elbow", "wrist", "ankle", "back", "lower back", "neck", "chest", "abdomen", "foot", "hand", "lad"]
LEGAL = r"\b(power of attorney|living will|driver(?:s| s)? licen[sc]e|insurance policy|employment contract|advance directive)\b"
FRAGRANCE = r"aldehyde$|cinnamaldehyde|\blimonene\b|\blinalool\b"


def is_noise(surface: Column, kind: Column) -> Column:
    """Devices, anatomy, legal papers, bare numbers, fragrances and words of one or two letters; kept words win, other
    types never are noise."""
    s = T.noise_normal(surface)
    c = T.compact(s)
    return (
        F.when(~T.noise_type(kind).isin(NOISE_TYPES) | (s == ""), False)
        .when(c.isin(KEEP_TOKENS) | s.rlike(KEEP) | c.rlike(KEEP), False)
        .when(s.rlike(DEVICES) | s.isin("iud", "ace wrap") | c.isin("iud", "ace wrap"), True)
        .when(s.isin(ANATOMY) | s.rlike(LEGAL) | s.rlike("^[0-9][0-9 ]*$") | s.rlike(FRAGRANCE), True)
        .otherwise((F.instr(s, " ") == 0) & (F.length(c) <= 2))
    )


def surface_index(profiles: DataFrame) -> DataFrame:
    """profiles (type, canonical, aliases, count). (type, surface, canonical): the smallest canonical wins a surface."""
    rows = profiles.select("type", "canonical", F.explode(F.array_union(F.array("canonical"), "aliases")).alias("surface"))
    return rows.groupBy("type", T.normalized(F.col("surface")).alias("surface")).agg(F.min("canonical").alias("canonical"))


def level_counts(levels: DataFrame) -> DataFrame:
    """levels (type, level, explicit, legacy). (type, level, count): the highest explicit count, else the highest legacy one."""
    return levels.groupBy("type", T.normalized(F.col("level")).alias("level")).agg(F.coalesce(F.max("explicit"), F.max("legacy")).alias("count"))


def lookup(spans: DataFrame, index: DataFrame) -> DataFrame:
    """spans (type, surface) with canonical: exact, else by the plural fold of both sides."""
    exact = index.select(F.col("type").alias("_t"), F.col("surface").alias("_s"), F.col("canonical").alias("_c"))
    folded = index.groupBy(F.col("type").alias("_u"), T.strip_plural(F.col("surface")).alias("_p")).agg(F.min("canonical").alias("_d"))
    a = spans.join(exact, (spans["type"] == exact["_t"]) & (T.normalized(spans["surface"]) == exact["_s"]), "left")
    b = a.join(folded, (a["type"] == folded["_u"]) & (T.strip_plural(a["surface"]) == folded["_p"]), "left")
    return b.withColumn("canonical", F.coalesce("_c", "_d")).drop("_t", "_s", "_c", "_u", "_p", "_d")


def unambiguous(rows: DataFrame, surface: str, target: str) -> DataFrame:
    """(surface, target) of surfaces that name one target only."""
    return rows.groupBy(surface).agg(F.min(target).alias("_lo"), F.max(target).alias("_hi")).where("_lo = _hi").select(surface, F.col("_lo").alias(target))


def best_label(spans: DataFrame, surface: str = "surface", least: int = 2) -> DataFrame:
    """(surface, type, score): each surface's best label; ties to the smaller type."""
    return spans.where(F.length(surface) >= least).groupBy(surface).agg(F.min(F.struct(-F.col("score"), "type")).alias("x")).select(surface, "x.type", (-F.col("x.col1")).alias("score"))


def majority(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """(key, tag, n): the most frequent tag of each key; ties to the smaller."""
    n = rows.groupBy(key, tag).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(tag).alias("t"))).alias("x")).select(key, F.col("x.t").alias(tag), (-F.col("x.m")).alias("n"))


def prefix_members(codes: DataFrame, code: str, sizes: tuple[int, ...]) -> DataFrame:
    """(prefix, members): how many codes share each prefix."""
    return codes.select(F.explode(F.array(*[F.substring(code, 1, n) for n in sizes])).alias("prefix"), code).groupBy("prefix").agg(F.countDistinct(code).alias("members"))


def merge_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of (type, canonical, aliases, count): aliases united and sorted, the higher count; origin says
    which side a row comes from."""
    x = a.select("type", "canonical", F.col("aliases").alias("_a"), F.col("count").alias("_n"))
    y = b.select("type", "canonical", F.col("aliases").alias("_b"), F.col("count").alias("_m"))
    both = x.join(y, ["type", "canonical"], "full_outer")
    empty = F.array().cast("array<string>")
    aliases = F.array_sort(F.array_union(F.coalesce("_a", empty), F.coalesce("_b", empty)))
    return both.select("type", "canonical", aliases.alias("aliases"), F.greatest("_n", "_m").alias("count"), F.when(F.col("_n").isNull(), "incoming").when(F.col("_m").isNull(), "existing").otherwise("both").alias("origin"))


def merge_rows(rows: DataFrame) -> DataFrame:
    """rows (type, surface, alias, count). One row per (type, surface): distinct aliases sorted, the highest count."""
    return rows.groupBy("type", "surface").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.max("count").alias("count"))


def duplicate_claims(profiles: DataFrame) -> DataFrame:
    """(type, surface, claims): surfaces that several canonical rows claim."""
    rows = profiles.select("type", "canonical", F.explode(F.array_union(F.array("canonical"), "aliases")).alias("surface"))
    return rows.groupBy("type", T.normalized(F.col("surface")).alias("surface")).agg(F.countDistinct("canonical").alias("claims")).where("claims > 1")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, epsilon: float = 1e-8) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + epsilon)


def unit(v: Column) -> Column:
    """v over its length; the zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def against_all(queries: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A stated query set against all rows, in blocks: rows are dealt to blocks by the hash of `key`, each query visits
    every block, and the two meet by an equi join, so neither side is broadcast or gathered."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_block").drop("_block")


def retrieve(queries: DataFrame, index: DataFrame, *, floor: float = 0.7, k: int = 5) -> DataFrame:
    """queries (query, v), index (row, canonical, v), unit vectors. (query, canonical, score): rows from `floor` on, the
    best k rows first, then the best of each canonical."""
    q = queries.select("query", F.col("v").alias("_q"))
    rows = against_all(q, index, "row").select("query", "row", "canonical", dot(F.col("_q"), F.col("v")).alias("score")).where(F.col("score") >= floor)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    return rows.withColumn("_r", F.row_number().over(w)).where(f"_r <= {k}").groupBy("query", "canonical").agg(F.max("score").alias("score"))


def nearest_by_words(rows: DataFrame, key: str, words: str, *, least: float = 0.3, k: int = 3, partitions: str | None = None) -> DataFrame:
    """(key, other, jaccard): for each row its k nearest by word overlap, itself left out.

    Words stand in order of rarity. Two sets whose overlap is over `least` share a word of their prefixes, which leave
    out the last ceil(least * size) - 1 words; only prefixes meet, so the common words make no pairs, and only sizes
    that can reach `least`. Candidates are then counted whole.
    """
    by = [partitions] if partitions else []
    sets = rows.select(*by, key, F.array_distinct(words).alias("_s")).where(F.size("_s") > 0)
    each = sets.select(*by, key, F.size("_s").alias("_n"), F.explode("_s").alias("_w"))
    rarity = each.groupBy(*by, "_w").agg(F.count("*").alias("_f"))
    ordered = each.join(rarity, [*by, "_w"]).groupBy(*by, key, "_n").agg(F.array_sort(F.collect_list(F.struct("_f", "_w"))).alias("_o"))
    kept = F.greatest(F.lit(1), F.col("_n") - F.ceil(F.lit(least) * F.col("_n")).cast("int") + 1)
    prefix = ordered.select(*by, key, "_n", F.transform("_o", lambda x: x["_w"]).alias("_s"), F.explode(F.transform(F.slice("_o", F.lit(1), kept), lambda x: x["_w"])).alias("_w"))
    other = prefix.select(*by, F.col(key).alias("other"), F.col("_n").alias("_m"), F.col("_s").alias("_t"), "_w")
    near = (F.least("_n", "_m") > least * F.greatest("_n", "_m")) & (F.col(key) != F.col("other"))
    met = prefix.join(other, [*by, "_w"]).where(near).dropDuplicates([key, "other"])
    common = F.size(F.array_intersect("_s", "_t"))
    j = met.select(key, "other", (common / (F.col("_n") + F.col("_m") - common)).alias("jaccard")).where(F.col("jaccard") > least)
    return j.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("jaccard"), "other"))).where(f"_r <= {k}").drop("_r")


def fuzzy_matches(left: DataFrame, right: DataFrame, *, ratio: float = 0.8, length_ratio: float = 0.55, delta: int = 3) -> DataFrame:
    """left (id, surface), right (row, surface). (id, row, score) of pairs that share a word, with lengths and word
    counts close, where one holds the other's words or the sequence ratio suffices."""
    words = lambda df, k: df.select(F.col(k), T.normalized(F.col("surface")).alias("s")).withColumn("w", F.array_distinct(F.split("s", " ")))
    a, b = words(left, left.columns[0]).toDF("id", "a", "wa"), words(right, right.columns[0]).toDF("row", "b", "wb")
    pairs = a.withColumn("t", F.explode("wa")).join(b.withColumn("t", F.explode("wb")), "t").drop("t").distinct()
    close = (F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b")) >= length_ratio) & (F.abs(F.size("wa") - F.size("wb")) <= delta)

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    whole = T.whole_words_contain(F.col("wa"), F.col("wb"))
    return pairs.where(close).withColumn("score", F.when(whole, 1.0).otherwise(similarity("a", "b"))).where(F.col("score") >= ratio).select("id", "row", "score")


def gate_chain(candidates: DataFrame, *, floor: float = 100.0, generic: list[str]) -> DataFrame:
    """candidates (item, pos, level, count, surface) with reason (null: accepted).

    Candidate rules first, in order: empty, same as the surface, generic, count below 1. Then, over what is left of an
    item: flat counts, only generic levels, a broadest level below `floor`, fewer than two levels.
    """
    low = F.trim(F.lower("level"))
    own = F.when(F.coalesce(low, F.lit("")) == "", "empty").when(low == F.trim(F.lower("surface")), "same").when(low.isin(generic), "generic").when(F.coalesce(F.col("count"), F.lit(0.0)) < 1, "count")
    rows = candidates.withColumn("reason", own)
    w = Window.partitionBy("item")
    ok = F.col("reason").isNull()
    kept = F.when(ok, F.col("count"))
    n, lo, hi = F.count(kept).over(w), F.min(kept).over(w), F.max(kept).over(w)
    chain = F.when(n < 2, "levels").when(lo == hi, "flat").when(hi < floor, "narrow")
    return rows.withColumn("_c", chain).withColumn("reason", F.coalesce("reason", "_c")).drop("_c")


def depth_ranks(chains: DataFrame) -> DataFrame:
    """chains (levels). (level, rank): mean relative position over all chains."""
    rows = chains.select(F.size("levels").alias("_n"), F.posexplode("levels").alias("pos", "level"))
    return rows.groupBy("level").agg(F.avg(F.col("pos") / F.greatest(F.lit(1), F.col("_n") - 1)).alias("rank"))


def pooled_counts(labels: DataFrame, key: str) -> DataFrame:
    """labels (key, pos, value, weight) with `pooled`: weighted isotonic regression in order of pos, two places.

    A fold over the key's values as blocks of (sum, weight, length); only strict violations pool.
    """
    block = "array<struct<s:double,w:double,n:int>>"

    def push(stack: Column, v: Column) -> Column:
        one = F.struct((v.value * v.weight).alias("s"), v.weight.alias("w"), F.lit(1).alias("n"))
        merged = F.aggregate(
            F.reverse(stack), F.struct(one.alias("b"), F.lit(0).alias("eaten"), F.lit(True).alias("go")),
            lambda acc, x: F.when(acc.go & (x.s / x.w > acc.b.s / acc.b.w), F.struct(F.struct((acc.b.s + x.s).alias("s"), (acc.b.w + x.w).alias("w"), (acc.b.n + x.n).alias("n")).alias("b"), (acc.eaten + 1).alias("eaten"), F.lit(True).alias("go"))).otherwise(F.struct(acc.b.alias("b"), acc.eaten.alias("eaten"), F.lit(False).alias("go"))),
        )
        return F.transform(F.array(merged), lambda m: F.concat(F.slice(stack, F.lit(1), F.size(stack) - m.eaten), F.array(m.b)))[0]

    rows = labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight")))).alias("v"))
    fitted = rows.select(key, "v", F.flatten(F.transform(F.aggregate("v", F.array().cast(block), push), lambda b: F.array_repeat(F.bround(b.s / b.w, 2), b.n))).alias("f"))
    return fitted.select(key, F.explode(F.arrays_zip(F.col("v.pos").alias("pos"), F.col("f").alias("pooled"))).alias("x")).select(key, "x.pos", "x.pooled")


def canonicalize(levels: DataFrame, variants: DataFrame) -> DataFrame:
    """levels (..., level) with variants (variant, level) replaced by their canonical level."""
    v = variants.select(F.col("variant").alias("_v"), F.col("level").alias("_l"))
    return levels.join(v, levels["level"] == v["_v"], "left").withColumn("level", F.coalesce("_l", "level")).drop("_v", "_l")


def append_unique(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is new, the first of each; rows without a key always."""
    keyed = incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")
    return keyed.select(*incoming.columns).unionByName(incoming.where(F.col(key).isNull()))


def events_report(parts: list[DataFrame]) -> DataFrame:
    """(code, action, n) over the union of event tables."""
    return reduce(DataFrame.unionByName, parts).groupBy("code", "action").agg(F.count("*").alias("n"))


def stop_word(word: Column, profile: Column, lists: dict[str, list[str]]) -> Column:
    """The word is on the stop list of its profile; an unknown profile has none."""
    out = F.lit(False)
    for name, words in lists.items():
        out = F.when(profile == name, word.isin(words)).otherwise(out)
    return out


def vector_index(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """rows (key, vector) as an index: key, unit vector v, norm and the row's fingerprint, which names the text and
    vector it was built from; vectors that are null or zero are left out."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    indexed = rows.select(key, F.col(vector).alias("v"), norm.alias("norm")).where("norm > 0")
    return indexed.select(key, F.transform("v", lambda x: x.cast("double") / F.col("norm")).alias("v"), "norm", F.xxhash64(key, "v").alias("fingerprint"))
