"""Span algebra: overlaps, resolution, chains, recall. Overlap is half-open: a.start < b.end and b.start < a.end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,surface:string,type:string,score:double,source:string>"


def overlaps(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def _greedy(sorted_spans: Column, clash) -> Column:
    """Keep each span, in order, that clashes with none kept before."""
    return F.aggregate(sorted_spans, F.array().cast(f"array<{SPAN}>"), lambda kept, s: F.when(F.exists(kept, lambda k: clash(k, s)), kept).otherwise(F.concat(kept, F.array(s))))


def resolve(spans: DataFrame, *, key: str = "doc_id", floor: float = 0.9) -> DataFrame:
    """Spans that win: of one type the widest, across types the highest score (patterns count `floor` at least), then
    the widest, then the first.

    A window first cuts each document's spans into islands that cannot overlap, so a fold sees one island only.
    """
    w = Window.partitionBy(key).orderBy("start", "end", "type", "surface", "source", "score")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    struct = F.struct("start", "end", "surface", "type", F.col("score").cast("double").alias("score"), "source").cast(SPAN)
    grouped = islands.groupBy(key, "island").agg(F.collect_list(struct).alias("s"))
    length = lambda x: x.end - x.start
    sure = lambda x: F.when(x.source == "pattern", F.greatest(x.score, F.lit(floor))).otherwise(x.score)

    def order(*by):
        """Comparator: the first difference decides, larger first for negated keys."""
        def compare(a: Column, b: Column) -> Column:
            out = F.when(F.lit(False), 0)
            for f in by:
                out = out.when(f(a) < f(b), -1).when(f(a) > f(b), 1)
            return out.otherwise(0)

        return compare

    tail = (lambda x: x.end, lambda x: x.type, lambda x: x.surface, lambda x: x.source)
    by_width = F.array_sort("s", order(lambda x: -length(x), lambda x: -x.score, lambda x: x.start, *tail))
    one_type = grouped.select(key, _greedy(by_width, lambda k, s: (k.type == s.type) & overlaps(k, s)).alias("s"))
    by_score = F.array_sort("s", order(lambda x: -sure(x), lambda x: -length(x), lambda x: x.start, *tail))
    return one_type.select(key, F.explode(_greedy(by_score, overlaps)).alias("x")).select(key, "x.*")


def chains(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """spans with `chain`: numbers of alias chains per document, in order of start; the latest chain that fits wins.

    Same type only. Surfaces of two or more words chain if one holds the other's words or their first words agree; a
    single word also joins by any word of a member. Words of one or two letters do not count. Order decides, so a
    document is folded as a whole; only its spans, not its text, are gathered.
    """
    kinds = dict(spans.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in spans.columns) + ", chain int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "type", "surface"], kind="stable").reset_index(drop=True)
        open_chains: list[tuple[str, list[list[str]]]] = []
        numbers = []
        for kind, surface in zip(pdf["type"], pdf["surface"], strict=True):
            words = [w for w in surface.lower().split() if len(w) > 2]
            chosen = None
            for n in range(len(open_chains) - 1, -1, -1):
                if open_chains[n][0] == kind and any(_alias(words, m) for m in open_chains[n][1]):
                    chosen = n
                    break
            if chosen is None:
                chosen = len(open_chains)
                open_chains.append((kind, []))
            open_chains[chosen][1].append(words)
            numbers.append(chosen)
        return pdf.assign(chain=pd.Series(numbers, dtype="int32"))

    return spans.groupBy(key).applyInPandas(fold, schema)


def _alias(words: list[str], member: list[str]) -> bool:
    if not words or not member:
        return False
    if words[0] == member[0] or (len(words) == 1 and words[0] in member):
        return True
    a, b = set(words), set(member)
    return min(len(words), len(member)) > 1 and (a <= b or b <= a)


def gate_types(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (surface, type, action, new_type): drops and retypes; spans without a decision stay."""
    d = decisions.select(F.col("surface").alias("_s"), F.col("type").alias("_t"), "action", "new_type")
    joined = spans.join(d, (spans["surface"] == d["_s"]) & (spans["type"] == d["_t"]), "left").where("action IS NULL OR action <> 'drop'")
    kind = F.when(F.col("action") == "retype", F.coalesce("new_type", "type")).otherwise(F.col("type"))
    return joined.withColumn("type", kind).drop("_s", "_t", "action", "new_type")


def gold(mentions: DataFrame, *, key: str = "doc_id", first_direct: bool = False) -> DataFrame:
    """One mention per (key, start, end): direct beats quasi; among direct ones the last annotator (or the first)."""
    rank = F.col("annotator") if first_direct else F.when(F.col("identifier") == "DIRECT", -F.col("annotator")).otherwise(F.col("annotator"))
    w = Window.partitionBy(key, "start", "end").orderBy((F.col("identifier") != "DIRECT").cast("int"), rank)
    return mentions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def overlap_hits(gold_spans: DataFrame, found: DataFrame, *, key: str = "doc_id", typed: bool = False) -> DataFrame:
    """gold spans with `hit`: a found span of the document (and type, if typed) overlaps them; equal spans count once.

    An equi join on the document and a bucket of offsets, so that a document with very many spans is no nested loop.
    """
    bucket = 1024
    g, columns = gold_spans, gold_spans.columns
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / bucket))))
    f = spread(found.select(key, F.col("start"), F.col("end"), F.col("type"))).select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("type").alias("_t"), F.col("_b").alias("_fb"))
    s = spread(g)
    on = (s[key] == f["_k"]) & (s["_b"] == f["_fb"]) & (s["start"] < f["_e"]) & (f["_s"] < s["end"])
    if typed:
        on = on & (s["type"] == f["_t"])
    return s.join(f, on, "left").groupBy(*columns).agg(F.max(F.col("_k").isNotNull()).alias("hit"))


def residuals(gold_spans: DataFrame, found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Gold spans whose exact offsets were not found."""
    return gold_spans.join(found.select(key, "start", "end").distinct(), [key, "start", "end"], "left_anti")


def unique_surfaces(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Surfaces that occur once in their document, with their span."""
    return spans.groupBy(key, "surface").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.min("end").alias("end")).where("n = 1").drop("n")


def coalesce_mentions(spans: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """One row per (key, type, surface) with all its ranges in order."""
    return spans.groupBy(key, "type", "surface").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def broken_offsets(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans whose offsets do not give their surface; empty if all are sound."""
    both = spans.join(docs.select(key, text), key)
    return both.where(F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("surface")).drop(text)


def noise_free(spans: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Spans prepared for substitution, and those rejected: health conditions below `least`; small-letter person
    phrases become roles."""
    bad = (F.col("type") == "health-condition") & (F.col("score") < least)
    role = (F.col("type") == "PERSON") & F.col("surface").rlike("^[a-z]")
    return spans.where(~bad).withColumn("type", F.when(role, "profession").otherwise(F.col("type"))), spans.where(bad)
