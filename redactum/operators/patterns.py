"""Pattern detection with offsets, as DataFrame operations only.

A text is its gaps and matches in turn: split() gives the gaps, regexp_extract_all() the matches, and running sums of
their lengths give every match its place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name: (type, pattern, score); explicit ASCII classes, so that every engine agrees on them
PATTERNS = {
    "email": ("CODE", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", 0.6),
    "ipv4": ("CODE", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.6),
    "phone": ("CODE", r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}(?:[ -][0-9]{2,4})?", 0.4),
    "card": ("CODE", r"[0-9]{13,16}", 0.5),
    "license": ("MISC", r"[A-Z][a-z]+(?: [A-Z][a-z]+)* [Ll]icense", 0.5),
    "name": ("PERSON", r"[A-Z][a-z]+(?: [A-Z][a-z]+)+", 0.85),
}


def matches(docs: DataFrame, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, i, start, end, surface): every match of the pattern, offsets in code points, ends exclusive.

    Only rows with a match are spread; a null text has none. The running sum is per document and pattern.
    """
    found = docs.where(F.col(text).rlike(pattern)).select(
        key, F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("hits")
    )
    rows = found.select(key, F.posexplode(F.arrays_zip("gaps", "hits")).alias("i", "x")).select(key, "i", F.length("x.gaps").alias("gap"), F.col("x.hits").alias("surface"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.length("surface"), F.lit(0))).over(before), F.lit(0)) + F.col("gap")
    rows = rows.withColumn("start", end.cast("int")).where("surface IS NOT NULL")
    return rows.select(key, "i", "start", (F.col("start") + F.length("surface")).cast("int").alias("end"), "surface")


def detect(docs: DataFrame, patterns: dict[str, tuple[str, str, float]] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, surface, type, score, source, recognizer) of every pattern's matches, in one scan of the texts;
    a null text has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = [
        F.when(t.rlike(pattern), _places(t, pattern, F.struct(F.lit(kind).alias("type"), F.lit(score).alias("score"), F.lit(name).alias("recognizer"))))
        for name, (kind, pattern, score) in (patterns or PATTERNS).items()
    ]
    rows = docs.select(key, F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("x"))
    return rows.select(key, "x.start", "x.end", "x.surface", "x.by.type", "x.by.score", F.lit("pattern").alias("source"), "x.by.recognizer")


def _places(text: Column, pattern: str, by: Column) -> Column:
    """Structs (start, end, surface, by) of a pattern's matches: a running sum over gaps and matches in one array."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,surface:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc.at + F.length(x.gap)
        end = begin + F.length(x.hit)
        more = F.concat(acc.out, F.array(F.struct(begin.alias("start"), end.alias("end"), x.hit.alias("surface"))))
        return F.when(x.hit.isNull(), acc).otherwise(F.struct(end.alias("at"), more.alias("out")))

    spans = F.aggregate(pairs, start, add).out
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.surface.alias("surface"), by.alias("by")))


def occurrences(docs: DataFrame, needles: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, surface, start): all places of each document's own literal needles (key, surface), not overlapping."""
    pairs = docs.select(key, text).join(needles.where(F.length("surface") > 0).select(key, "surface").distinct(), key)
    parts = pairs.select(key, "surface", F.split(text, F.concat(F.lit(r"\Q"), F.replace("surface", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))).alias("gaps"))
    rows = parts.where(F.size("gaps") > 1).select(key, "surface", F.posexplode("gaps").alias("i", "gap"))
    w = Window.partitionBy(key, "surface").orderBy("i")
    ends = F.sum(F.length("gap")).over(w) + F.col("i") * F.length("surface")
    return rows.withColumn("start", ends.cast("int")).withColumn("last", F.lead("i").over(w).isNull()).where("NOT last").select(key, "surface", "start")


def without_digit(surface: Column) -> Column:
    """Rejection of a code span without any digit."""
    return ~surface.rlike("[0-9]")
