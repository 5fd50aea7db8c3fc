"""Frozen decision environments: stable ids, validation, comparison, rendering choices, schedules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.functions import text as T


def stable_id(prefix: str, *columns: str) -> Column:
    """prefix and 16 hex digits of the sha256 of the columns' JSON, names sorted."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 16))


def freeze(spans: DataFrame, *, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """spans (key, start, end, surface, type): occurrences with ids, and one decision per document, type and entity."""
    entity = spans.withColumn("entity", T.canonical(F.col("surface")))
    decision = entity.withColumn("decision_id", stable_id("d", key, "type", "entity"))
    occurrences = decision.withColumn("occurrence_id", stable_id("o", key, "start", "end", "decision_id"))
    decisions = occurrences.groupBy(key, "type", "entity", "decision_id").agg(F.array_sort(F.collect_list(F.struct("start", "occurrence_id"))).alias("occurrences"))
    return occurrences, decisions


def same_rows(a: DataFrame, b: DataFrame, ignore: list[str]) -> DataFrame:
    """(side, n): rows of either table that the other lacks, without the ignored columns; empty if the tables agree."""
    x, y = a.drop(*ignore), b.drop(*ignore)
    y = y.select(*x.columns)
    return x.exceptAll(y).select(F.lit("left").alias("side")).unionByName(y.exceptAll(x).select(F.lit("right").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


def violations(occurrences: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(rule, n) of broken rules: empty or negative ranges, ids used twice, overlaps within a document."""
    w = Window.partitionBy(key).orderBy("start", "end")
    rows = occurrences.withColumn("_before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ids = occurrences.groupBy("occurrence_id").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))
    counts = rows.agg(F.count_if((F.col("start") < 0) | (F.col("end") <= F.col("start"))).alias("range"), F.count_if(F.col("start") < F.col("_before")).alias("overlap"))
    long = counts.select(F.explode(F.array(F.struct(F.lit("range").alias("rule"), F.col("range").alias("n")), F.struct(F.lit("overlap").alias("rule"), F.col("overlap").alias("n")))).alias("x")).select("x.*")
    return long.unionByName(ids.select(F.lit("duplicate").alias("rule"), "n")).where("n > 0")


def mapping_errors(decisions: DataFrame, policy: DataFrame, key: str) -> DataFrame:
    """(key, error): decisions without a policy entry, and entries for no decision."""
    a = decisions.select(key).distinct().withColumn("_a", F.lit(True))
    b = policy.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.where("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "missing").otherwise("unknown").alias("error"))


def structural_alternatives(actions: DataFrame, selected: DataFrame) -> DataFrame:
    """actions (decision, action, mode, index), selected (decision, action). (decision, action): for a selected level its
    neighbours in authored order and both ends keep and placeholder; for an end the level next to it and the other end.

    Rows meet by decision once, and the selected action's place is taken from within the decision. Levels usually come
    from an explode, of which size estimates know nothing, so the join is a merge join and no side reaches the driver."""
    w = Window.partitionBy("decision", "mode").orderBy("index")
    n = F.count("*").over(Window.partitionBy("decision", "mode"))
    rows = actions.select("decision", "action", "mode", "index").repartition("decision").withColumns({"_r": F.when(F.col("mode") == "level", F.row_number().over(w)), "_n": n})
    s = selected.select("decision", F.col("action").alias("_s")).withColumn("_k", F.monotonically_increasing_id())
    same = Window.partitionBy("decision", "_k")
    chosen = F.collect_list(F.when(F.col("action") == F.col("_s"), F.struct("mode", "_r"))).over(same)
    both = rows.join(s.hint("merge"), "decision").withColumn("_c", chosen).withColumn("_c", F.explode("_c")).where("action <> _s")
    level, at = F.col("mode") == "level", F.col("_c.mode")
    near = F.when(at == "level", ~level | (F.abs(F.col("_r") - F.col("_c._r")) == 1)).when(at == "keep", ~level | (F.col("_r") == 1)).otherwise(~level | (F.col("_r") == F.col("_n")))
    return both.where(near).select("decision", "action")


def anchor_walks(decisions: DataFrame, *, key: str = "doc") -> DataFrame:
    """decisions (key, position, fills array<string>). (key, walk, position, fill): three fixed walks, finest, middle and
    coarsest level first, that never give two decisions one fill; null stands for the placeholder. Claims run in order
    of position, so a document is walked as a whole."""
    kind = dict(decisions.dtypes)[key]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.sort_values("position")
        for name in ("finest", "middle", "coarsest"):
            claimed: set[str] = set()
            for row in pdf.itertuples():
                fills = list(row.fills if row.fills is not None else [])
                if name == "coarsest":
                    fills = fills[::-1]
                elif name == "middle" and fills:
                    fills = fills[len(fills) // 2 :] + fills[: len(fills) // 2][::-1]
                fill = next((f for f in fills if f.lower() not in claimed), None)
                if fill is not None:
                    claimed.add(fill.lower())
                out.append((getattr(row, key), name, row.position, fill))
        return pd.DataFrame(out, columns=[key, "walk", "position", "fill"])

    return decisions.groupBy(key).applyInPandas(walk, f"`{key}` {kind}, walk string, position int, fill string")


def render(docs: DataFrame, occurrences: DataFrame, choices: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """docs with `rendered`: choices (decision_id, mode, fill); placeholders are numbered per type by first offset."""
    from redactum.operators import rewrite

    chosen = occurrences.join(choices, "decision_id").where("mode <> 'keep'")
    first = chosen.where("mode = 'placeholder'").groupBy(key, "type", "decision_id").agg(F.min("start").alias("_f"))
    n = first.withColumn("_n", F.row_number().over(Window.partitionBy(key, "type").orderBy("_f", "decision_id"))).select("decision_id", "_n").distinct()
    rows = chosen.join(n, "decision_id", "left").withColumn("replacement", F.when(F.col("mode") == "placeholder", T.placeholder(F.col("type"), F.col("_n"))).otherwise(F.col("fill")))
    return rewrite.splice(docs, rows, key=key, out="rendered")


def schedule(pairs: DataFrame, budget: int, *, seed: str = "0") -> DataFrame:
    """pairs (pair, linked, entropy) chosen for measurement: a fifth of the budget by hash order, the rest by priority (no
    link first, then entropy, then hash)."""
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("pair").cast("string")), 256)
    explore = budget // 5
    rows = pairs.withColumn("_h", order)
    random = rows.orderBy("_h", "pair").limit(explore).withColumn("why", F.lit("explore"))
    rest = rows.join(random.select("pair"), "pair", "left_anti").orderBy("linked", F.desc("entropy"), "_h").limit(budget - explore).withColumn("why", F.lit("priority"))
    return random.unionByName(rest).drop("_h")


def weighted_median(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """One row `median`: the first value at half of the weight; sums per value first."""
    from redactum.operators.frontier import weighted_quantiles

    return weighted_quantiles(rows, [0.5], value, weight).select(F.col("value").alias("median"))


def age_summary(rows: DataFrame, by: list[str], age: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(age).alias("n"), F.min(age).alias("low"), F.max(age).alias("high"), F.avg(age).alias("mean"))


def population(evaluations: DataFrame, group: str) -> DataFrame:
    """evaluations (group, doc, before, after). Per group: documents, gains, losses, mean change and its median."""
    d = F.col("after") - F.col("before")
    return evaluations.groupBy(group).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("gains"), F.count_if(d < 0).alias("losses"), F.avg(d).alias("mean"), F.percentile(d, F.lit(0.5)).alias("median"))
