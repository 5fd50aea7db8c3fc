"""Rewriting of texts at spans, and restoration of originals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T


def number_placeholders(spans: DataFrame, *, key: str = "doc_id", descending: bool = True) -> DataFrame:
    """spans with `replacement`: <TYPE_n>, counted per document and type from the end (or from the start)."""
    order = [F.desc("start"), F.desc("end")] if descending else [F.asc("start"), F.asc("end")]
    n = F.row_number().over(Window.partitionBy(key, "type").orderBy(*order))
    return spans.withColumn("replacement", T.placeholder(F.col("type"), n))


def splice(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "redacted") -> DataFrame:
    """docs with `out`: every span (key, start, end, replacement; not overlapping) replaced; other texts as they are.

    Only replacements are gathered, a document's own; its text is cut once.
    """
    r = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("_r"))
    joined = docs.join(r, key, "left")
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc.at + 1, s.start - acc.at)
        return F.struct(F.concat(acc.done, gap, s.replacement).alias("done"), s.end.alias("at"))

    folded = F.aggregate("_r", zero, step, lambda acc: F.concat(acc.done, F.substring(F.col(text), acc.at + 1, F.length(text))))
    return joined.withColumn(out, F.coalesce(folded, F.col(text))).drop("_r")


def keep_all(spans: DataFrame) -> DataFrame:
    """The record without privacy: every span kept at full risk."""
    return spans.select("*", F.lit("keep").alias("action"), F.col("surface").alias("replacement"), F.lit(1.0).alias("risk"))


def coarsest(lattice: Column, type_name: Column) -> Column:
    """The last level that is no placeholder, else the type's placeholder."""
    real = F.filter(lattice, lambda x: ~x.startswith("<"))
    return F.when(F.size(real) > 0, F.element_at(real, -1)).otherwise(T.placeholder(type_name))


def restore_longest_first(text: Column, pairs: Column) -> Column:
    """text with each pair's replacement turned back into its surface, longest replacement first."""
    def longer(a: Column, b: Column) -> Column:
        return F.when(F.length(a.replacement) > F.length(b.replacement), -1).when(F.length(a.replacement) < F.length(b.replacement), 1).when(a.replacement < b.replacement, -1).when(a.replacement > b.replacement, 1).otherwise(0)

    usable = F.filter(pairs, lambda p: F.length(p.replacement) > 0)
    return F.aggregate(F.array_sort(usable, longer), text, lambda acc, p: F.replace(acc, p.replacement, p.surface))


def substitute(spans: DataFrame, *, key: str = "doc_id", tau: float = 0.5) -> DataFrame:
    """spans (key, start, end, surface, type, chain, lattice, risks) with action and replacement.

    Each surface takes the first level of its lattice whose risk is below tau and that no other surface of the
    document has claimed; direct types and exhausted lattices take a placeholder per alias chain or surface. Choices
    depend on earlier ones, so a document's spans are walked from the right in one group.
    """
    kinds = dict(spans.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in spans.columns) + ", action string, replacement string"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end", "type", "surface"], ascending=False, kind="stable")
        owner: dict[str, tuple] = {}
        chosen: dict[tuple, tuple[str, str]] = {}
        counts: dict[str, int] = {}
        actions, replacements = [], []
        for row in pdf.itertuples():
            who = (row.type, row.chain) if row.type in ("PERSON", "CODE") else (row.type, row.surface.lower())
            if who not in chosen:
                pick = None
                if row.type not in ("PERSON", "CODE") and row.lattice is not None:
                    for level, risk in zip(row.lattice, row.risks, strict=True):
                        if risk < tau and not level.startswith("<") and owner.setdefault(level.lower(), who) == who:
                            pick = ("generalize", level)
                            break
                if pick is None:
                    token = re.sub("[^A-Z0-9]+", "_", row.type.upper()).strip("_") or "OTHER"
                    counts[token] = counts.get(token, 0) + 1
                    pick = ("placeholder", f"<{token}_{counts[token]}>")
                chosen[who] = pick
            actions.append(chosen[who][0])
            replacements.append(chosen[who][1])
        return pdf.assign(action=actions, replacement=replacements)

    return spans.groupBy(key).applyInPandas(walk, schema)


def restore(texts: pd.Series, records: pd.Series) -> pd.Series:
    """Placeholders, bare or bracketed, in one pass (longest first), then whole-word replacements without regard to case."""
    out = []
    for text, pairs in zip(texts, records, strict=True):
        if text is None or pairs is None:
            out.append(text)
            continue
        pairs = [(p["replacement"], p["surface"]) for p in pairs if p["replacement"]]
        holders = {r.strip("<>"): s for r, s in pairs if r.startswith("<") and r.endswith(">")}
        if holders:
            names = "|".join(re.escape(h) for h in sorted(holders, key=len, reverse=True))
            text = re.sub(rf"<({names})>|(?<![A-Za-z0-9_])({names})(?![A-Za-z0-9_])", lambda m, h=holders: h[m[1] or m[2]], text)
        for r, s in sorted((p for p in pairs if not p[0].startswith("<")), key=lambda p: (-len(p[0]), p[0])):
            text = re.sub(rf"(?<![A-Za-z0-9_]){re.escape(r)}(?![A-Za-z0-9_])", lambda m, s=s: s, text, flags=re.IGNORECASE)
        out.append(text)
    return pd.Series(out, dtype=object)


def restored(frame: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "redacted", out: str = "restored") -> DataFrame:
    """frame with `out`: the text with the originals of spans (key, surface, replacement) put back."""
    r = spans.groupBy(key).agg(F.collect_set(F.struct("surface", "replacement")).alias("_r"))
    turn = F.pandas_udf(restore, "string")
    return frame.join(r, key, "left").withColumn(out, F.when(F.col("_r").isNull(), F.col(text)).otherwise(turn(text, "_r"))).drop("_r")


def retained(action: Column, policy: Column) -> Column:
    """A generalisation that its policy keeps: it is not restored."""
    return F.coalesce((action == "generalize") & (policy == "keep"), F.lit(False))
