"""Answer scoring, assertion weights and gates, and the benchmark's metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T


def _words(c: Column) -> Column:
    return F.regexp_extract_all(T.clinical_canonical(c), F.lit("([a-z0-9_]+)"))


def _initials(w: Column) -> Column:
    return F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), "")


def fact_score(answer: Column, gold: Column) -> Column:
    """How far an answer states a fact: every number must be there; all words there, or an acronym either way, is 1;
    else the F1 of the common words, repeats counted."""
    def score(x: Column) -> Column:
        p, g = x.p, x.g
        numbers = F.filter(g, lambda t: t.rlike("^[0-9]+$"))
        acronym = lambda s, w: (F.size(s) == 1) & (F.length(s[0]) >= 2) & (s[0] == _initials(w))
        times = lambda a, t: F.size(F.filter(a, lambda y: y == t))
        common = F.aggregate(F.array_distinct(g), F.lit(0), lambda n, t: n + F.least(times(p, t), times(g, t)))
        f1 = 2.0 * common / (F.size(p) + F.size(g))
        return (
            F.when(F.size(g) == 0, (F.size(p) == 0).cast("double")).when(F.size(p) == 0, 0.0)
            .when(F.size(F.array_except(numbers, p)) > 0, 0.0).when(F.size(F.array_except(g, p)) == 0, 1.0)
            .when(acronym(p, g) | acronym(g, p), 1.0).otherwise(f1)
        )

    return T.let(F.struct(_words(answer).alias("p"), _words(gold).alias("g")), score)


def answer_score(answer: Column, accepted: Column) -> Column:
    """The best score over the accepted values; 0 without any."""
    return F.coalesce(F.array_max(F.transform(accepted, lambda g: fact_score(answer, g))), F.lit(0.0))


def set_recall(answer_lines: Column, members: Column, least: float = 0.999) -> Column:
    """Members of a set answer that some answer line states, each line used once in order, over all members."""
    def take(acc: Column, m: Column) -> Column:
        hit = F.filter(acc.left, lambda a: fact_score(a, m) >= least)
        at = F.array_position(acc.left, F.get(hit, F.lit(0)))
        rest = F.filter(acc.left, lambda a, i: i + 1 != at)
        return F.when(F.size(hit) > 0, F.struct((acc.n + 1).alias("n"), rest.alias("left"))).otherwise(acc)

    out = F.aggregate(members, F.struct(F.lit(0).alias("n"), answer_lines.alias("left")), take)
    return F.try_divide(out.n, F.size(members))


def contains_sequence(tokens: Column, alias: Column, extra: int = 6) -> Column:
    """The alias stands in the tokens as it is, with at most `extra` other tokens around it."""
    n = F.size(tokens) - F.size(alias)
    starts = F.when((F.size(alias) > 0) & (n >= 0), F.sequence(F.lit(1), n + 1)).otherwise(F.array().cast("array<int>"))
    return (n <= extra) & F.exists(starts, lambda i: F.slice(tokens, i, F.size(alias)) == alias)


def json_array(reply: Column, element: str = "string") -> Column:
    """The first [...] of a reply as an array; empty if it is malformed."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), f"array<{element}>", {"mode": "PERMISSIVE"})
    return F.coalesce(found, F.array().cast(f"array<{element}>"))


def permuted_options(question: Column, options: Column, turn: Column) -> Column:
    """Options in an order fixed by the question's hash, rotated by `turn`."""
    ordered = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.sha2(F.concat_ws("|", question, o), 256).alias("h"), o.alias("o")))), lambda x: x.o)
    k = (turn % F.size(options)).cast("int")
    return F.concat(F.slice(ordered, k + 1, F.size(options)), F.slice(ordered, F.lit(1), k))


def static_weights(assertions: DataFrame, budgets: DataFrame, structural_cap: float | None = None) -> DataFrame:
    """assertions (id, family, group, subtype) with weight: a family's budget shared by its groups, a group's by its rows.

    With a cap the structural groups of the delivered family together take at most that share of its budget.
    """
    groups = assertions.groupBy("family", "group").agg(F.count("*").alias("n"), F.max((F.col("subtype") == "structure").cast("int")).alias("s"))
    groups = groups.withColumn("s", F.when(F.col("family") == "delivered", F.coalesce("s", F.lit(0))).otherwise(0))
    w = Window.partitionBy("family")
    total, structural = F.count("*").over(w), F.sum("s").over(w)
    per = groups.join(budgets, "family")
    plain = F.col("budget") / total
    if structural_cap is not None:
        mass = F.least(F.col("budget") * structural_cap, F.col("budget") * structural / total)
        plain = F.when(structural == 0, plain).when(F.col("s") == 1, mass / structural).otherwise((F.col("budget") - mass) / (total - structural))
    per = per.withColumn("share", plain / F.col("n")).select(F.col("family").alias("_f"), F.col("group").alias("_g"), F.col("share").alias("weight"))
    return assertions.join(per, (assertions["family"] == per["_f"]) & (assertions["group"] == per["_g"])).drop("_f", "_g")


def three_point_gate(trials: DataFrame, threshold: float = 0.5, share: float = 0.6) -> DataFrame:
    """trials (assertion, original, representative, placeholder). status: accepted where enough trials answer from the
    original and the representative but not from the placeholder, unsupported where the original rarely answers, else unstable."""
    t = threshold
    ok = (F.col("original") >= t) & (F.col("representative") >= t) & (F.col("placeholder") < t)
    per = trials.groupBy("assertion").agg(F.avg(ok.cast("double")).alias("passed"), F.avg((F.col("original") >= t).cast("double")).alias("supported"))
    return per.select("assertion", "passed", F.when(F.col("passed") >= share, "accepted").when(F.col("supported") < share, "unsupported").otherwise("unstable").alias("status"))


def outcome_route(original: Column, representative: Column, placeholder: Column, deterministic: Column, t: float = 0.5) -> Column:
    o, r, p = original >= t, representative >= t, placeholder >= t
    return F.when(o & r & p, "floor_answerable").when((o != r) | (p & ~o & ~r), "lattice_suspect").when(~o & ~r & ~p & deterministic, "no_relation")


def first_by_fact(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per fact key, the first in order (primary before secondary)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def routed(dependencies: DataFrame, linked: DataFrame) -> DataFrame:
    """dependencies (assertion, occurrence), linked (occurrence, decision). (assertion, decisions, routing)."""
    per = dependencies.join(linked, "occurrence", "left").groupBy("assertion").agg(F.array_sort(F.collect_set("decision")).alias("decisions"))
    return per.withColumn("routing", F.when(F.size("decisions") > 0, "linked").otherwise("residual"))


def echo(replacement: Column, out: Column) -> Column:
    """exact where the replacement stands in the output as it is, else absent."""
    return F.when((replacement != "") & (F.instr(out, replacement) > 0), "exact").otherwise("absent")


def restoration_report(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """records (key, surface, replacement, out_p, out_final). Echoed and restored spans, recovery (null without echoes)
    and insertions that no echo supports."""
    has = lambda text, needle: (T.canonical(needle) != "") & (F.instr(T.canonical(text), T.canonical(needle)) > 0)
    echoed = echo(F.col("replacement"), F.col("out_p")) == "exact"
    back = has(F.col("out_final"), F.col("surface"))
    out = records.groupBy(key).agg(F.count_if(echoed).alias("echoed"), F.count_if(echoed & back).alias("restored"), F.count_if(~echoed & back).alias("unsupported"))
    return out.withColumn("recovery", F.try_divide("restored", "echoed"))


def lcs_length(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def rouge_l(prediction: pd.Series, references: pd.Series) -> pd.Series:
    """Longest-common-subsequence F measure over words, the best reference; null without references. No stemming."""
    import re

    words = lambda s: re.findall("[a-z0-9]+", (s or "").lower())
    out = []
    for p, refs in zip(prediction, references, strict=True):
        best, w = None, words(p)
        for r in refs if refs is not None else ():
            g = words(r)
            n = lcs_length(w, g)
            best = max(best or 0.0, 2 * n / (len(w) + len(g)) if w and g else 0.0)
        out.append(best)
    return pd.Series(out, dtype="float64")


def rouge_l_column(prediction: Column, references: Column) -> Column:
    return F.pandas_udf(rouge_l, "double")(prediction, references)


# fixed values: cumulative probabilities of a Poisson variable of mean 1 for 0, 1, ... 7
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def bootstrap_interval(values: DataFrame, value: str, key: str, samples: int = 1000, seed: int = 0) -> DataFrame:
    """One row (low, high): 2.5 and 97.5 percent of resampled means, six places; zeros without values.

    Poisson resampling: each row (its key says which) draws, from an MD5 of key, seed and the sample's number, how often
    it counts; one digest serves four samples. Sums per sample are combined before they meet, so rows are never gathered.
    """
    blocks = F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // 4)))
    rows = values.select(F.col(value).cast("double").alias("_v"), F.col(key).cast("string").alias("_k"), blocks.alias("_b"))
    digest = rows.withColumn("_d", F.md5(F.concat_ws("|", "_k", F.lit(str(seed)), F.col("_b").cast("string")).cast("binary")))
    draws = digest.select("_v", "_b", "_d", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("_i")).withColumn("s", F.col("_b") * 4 + F.col("_i")).where(F.col("s") < samples)
    u = F.conv(F.expr("substring(_d, 1 + 8 * _i, 8)"), 16, 10).cast("double") / float(1 << 32)
    n = sum(((u >= c).cast("int") for c in POISSON[1:]), (u >= POISSON[0]).cast("int"))
    counted = draws.select("s", "_v", n.alias("_n"))
    means = counted.groupBy("s").agg((F.sum(F.col("_v") * F.col("_n")) / F.nullif(F.sum("_n"), F.lit(0))).alias("m"))
    edge = lambda p: F.coalesce(F.round(F.percentile("m", F.lit(p)), 6), F.lit(0.0))
    return means.agg(edge(0.025).alias("low"), edge(0.975).alias("high"))


def bootstrap_sql(table: str, value: str, key: str, samples: int, seed: int = 0) -> str:
    """The same in DuckDB SQL, for oracles."""
    n = " + ".join(f"CAST(u >= {c!r} AS INTEGER)" for c in POISSON)
    return f"""WITH d AS (SELECT CAST({value} AS DOUBLE) AS v, s, CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}|' || (s // 4)), 1 + 8 * (s % 4), 8) AS BIGINT) / 4294967296.0 AS u FROM ({table}), range({samples}) t(s)),
m AS (SELECT s, sum(v * n) / nullif(sum(n), 0) AS m FROM (SELECT s, v, {n} AS n FROM d) GROUP BY s)
SELECT coalesce(round(quantile_cont(m, 0.025), 6), 0.0) AS low, coalesce(round(quantile_cont(m, 0.975), 6), 0.0) AS high FROM m"""


def merge_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): touching or overlapping inclusive intervals become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = rows.withColumn("_n", F.when(F.col(start) <= reach + 1, 0).otherwise(1)).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def turn_excerpts(turns: DataFrame, core: DataFrame, window: int = 1) -> DataFrame:
    """turns (conv_id, turn, text), core (conv_id, turn). (conv_id, excerpt): core turns with their neighbours, gaps
    elided as [...]; conversations without core turns whole."""
    near = core.select("conv_id", (F.col("turn") - window).alias("a"), (F.col("turn") + window).alias("b"))
    merged = merge_intervals(near, "conv_id", "a", "b").select(F.col("conv_id").alias("_c"), "a", "b")
    kept = turns.join(merged, (turns["conv_id"] == merged["_c"]) & turns["turn"].between(merged["a"], merged["b"]))
    block = kept.groupBy("conv_id", "a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n").alias("t"))
    part = block.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "t"))), lambda x: x.t), "\n[...]\n").alias("excerpt"))
    bare = turns.join(core.select("conv_id").distinct(), "conv_id", "left_anti").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n").alias("excerpt"))
    return part.unionByName(bare)
