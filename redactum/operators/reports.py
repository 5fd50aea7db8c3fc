"""Small reports over measurements: support, balance, agreement, paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, by: list[str], **means: Column) -> DataFrame:
    """(by..., n, means...)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in means.items()])


def stratified(rows: DataFrame, by: list[str], **means: Column) -> DataFrame:
    """summary() for every prefix of the strata, the whole included; a missing stratum is null."""
    return rows.rollup(*by).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(k) for k, c in means.items()])


def failure_reasons(report: DataFrame, by: list[str], tests: dict[str, Column]) -> DataFrame:
    """(by..., reasons): the sorted names of the aggregate conditions that hold for a group."""
    found = F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in tests.items()])))
    return report.groupBy(*by).agg(found.alias("reasons"))


def collapse(rows: DataFrame, by: list[str], value: str, threshold: float) -> DataFrame:
    """(by..., observed, fires): the mean fell below the threshold; without values it does not fire."""
    m = F.avg(value)
    return rows.groupBy(*by).agg(m.alias("observed"), F.coalesce(m < threshold, F.lit(False)).alias("fires"))


def patterns(rows: DataFrame, by: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """(by, one count per outcome), 0 where a group has none."""
    return rows.groupBy(by).agg(*[F.count(F.when(F.col(outcome) == o, 1)).alias(o) for o in outcomes])


def shares(rows: DataFrame, by: str, size: str) -> DataFrame:
    """(by, n, total, share): share of each group in the sum of `size`; groups are counted before they are compared."""
    per = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(size).alias("total"))
    return per.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def balanced(rows: DataFrame, rare: Column) -> DataFrame:
    """Rows, rare ones twice."""
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.when(rare, 2).otherwise(1)))).drop("_i")


def within_budget(rows: DataFrame, by: str, size: str, most: int, at: float = 0.99) -> DataFrame:
    """(by, kept, quantile): rows of at most `most`, and the discrete quantile of their sizes."""
    kept = rows.where(F.col(size) <= most)
    return kept.groupBy(by).agg(F.count("*").alias("kept"), F.expr(f"percentile_disc({at}) WITHIN GROUP (ORDER BY `{size}`)").alias("quantile"))


def pools(rows: DataFrame, by: str, surface: str, least: int) -> DataFrame:
    """(by, surfaces, thin): the sorted distinct surfaces of a type; thin with fewer than `least`."""
    s = rows.groupBy(by).agg(F.array_sort(F.collect_set(surface)).alias("surfaces"))
    return s.withColumn("thin", F.size("surfaces") < least)


def last_mention(mentions: DataFrame, by: list[str], surface: str, at: str) -> DataFrame:
    """mentions, the last of each lower-cased surface of a document."""
    key = F.lower(F.col(surface))
    whole = F.max(F.struct(F.col(at), F.struct(*mentions.columns).alias("r"))).alias("x")
    return mentions.groupBy(*by, key.alias("_k")).agg(whole).select("x.r.*")


def first_mention(mentions: DataFrame, by: list[str], surface: str, at: str) -> DataFrame:
    """mentions, the first of each lower-cased surface of a document."""
    whole = F.min(F.struct(F.col(at), F.struct(*mentions.columns).alias("r"))).alias("x")
    return mentions.groupBy(*by, F.lower(F.col(surface)).alias("_k")).agg(whole).select("x.r.*")


def metric_with_support(rows: DataFrame, by: str, metric: Column, least: int) -> DataFrame:
    """(by, metric): null below `least` rows."""
    return rows.groupBy(by).agg(F.when(F.count("*") >= least, metric).alias("metric"))


def distinct_menus(rows: DataFrame, profile: str, menu: str, action: str) -> DataFrame:
    """(profile, menu, actions): identical sets of actions of a profile once, under the smallest menu's name."""
    sets = rows.groupBy(profile, menu).agg(F.array_sort(F.collect_set(action)).alias("actions"))
    return sets.groupBy(profile, "actions").agg(F.min(menu).alias(menu)).select(profile, menu, "actions")


def resolved_rule(document: Column, path: str, rules: list[tuple[str, float]], default: str) -> Column:
    """The first rule (name, least) whose bound the number at a JSON path reaches; a missing number takes the default."""
    v = F.get_json_object(document, path).cast("double")
    out = F.lit(default)
    for name, least in reversed(rules):
        out = F.when(v >= least, name).otherwise(out)
    return out


def missing(requests: DataFrame, cached: DataFrame, identity: list[str]) -> DataFrame:
    """Requests whose identity the cache does not hold; null fields match null ones."""
    c = cached.select(*[F.col(x).alias(f"_{x}") for x in identity]).distinct()
    on = [requests[x].eqNullSafe(c[f"_{x}"]) for x in identity]
    return requests.join(c, on, "left_anti")


def conflicts(results: DataFrame, identity: list[str], value: str) -> DataFrame:
    """(identity..., results): identities with more than one result, which a result store must not hold."""
    return results.groupBy(*identity).agg(F.countDistinct(value).alias("results")).where("results > 1")


def paired_difference(base: DataFrame, fresh: DataFrame, identity: list[str], value: str, by: list[str]) -> DataFrame:
    """(by..., difference): mean of fresh minus base over identities that both hold."""
    f = fresh.select(*identity, F.col(value).alias("_f"))
    both = base.select(*identity, F.col(value).alias("_b"), *[c for c in by if c not in identity]).join(f, identity)
    return both.groupBy(*by).agg(F.avg(F.col("_f") - F.col("_b")).alias("difference"))


def self_substitution(runs: DataFrame, by: list[str], word: str, output: str) -> DataFrame:
    """(by..., self_rate, outputs): how often a word stays itself, and its distinct outputs."""
    return runs.groupBy(*by).agg(F.avg((F.col(word) == F.col(output)).cast("double")).alias("self_rate"), F.countDistinct(output).alias("outputs"))


def rank_agreement(rows: DataFrame, by: str, truth: str, score: str) -> DataFrame:
    """(by, agreement): share of a span's pairs with different truths that the score orders alike. A span's candidates
    are a small menu, held as one array."""
    v = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(truth).alias("t"), F.col(score).alias("s")))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b.t > a.t), lambda b: (b.s >= a.s).cast("double"))))
    mean = F.aggregate("p", F.lit(0.0), lambda s, x: s + x) / F.size("p")
    return v.select(by, pairs.alias("p")).where(F.size("p") > 0).select(by, mean.alias("agreement"))


def proximity_reward(spans: DataFrame, by: list[str], value: str, generalized: Column) -> DataFrame:
    """(by..., mean, high, n) of the proximity of generalised spans, zeros where there is none."""
    v = F.when(generalized, F.col(value))
    return spans.groupBy(*by).agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.max(v), F.lit(0.0)).alias("high"), F.count(v).alias("n"))


def component_utility(scores: DataFrame, weights: DataFrame | None, by: str, component: str, score: str) -> DataFrame:
    """(by, component, score, utility): mean score of each component, and their weighted mean (plain without weights)."""
    s = scores.groupBy(by, component).agg(F.avg(score).alias("score"))
    s = s.withColumn("weight", F.lit(1.0)) if weights is None else s.join(weights, component)
    whole = s.groupBy(by).agg(F.try_divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("utility"))
    return s.join(whole, by).select(by, component, "score", "utility")


def tasks(docs: DataFrame, key: str, templates: dict[str, str], text: Column) -> DataFrame:
    """(key, task, prompt): every task's prompt for every document; {doc} stands for the text."""
    each = F.array(*[F.struct(F.lit(n).alias("task"), F.replace(F.lit(t), F.lit("{doc}"), text).alias("prompt")) for n, t in templates.items()])
    return docs.select(key, F.explode(each).alias("x")).select(key, "x.task", "x.prompt")


def scored_once(pairs: DataFrame, by: list[str], score) -> DataFrame:
    """pairs with score, computed once for each distinct pair and joined back by it (null fields match)."""
    once = score(pairs.select(*by).distinct()).select(*[F.col(c).alias(f"_{c}") for c in by], "score")
    return pairs.join(once, [pairs[c].eqNullSafe(once[f"_{c}"]) for c in by]).drop(*[f"_{c}" for c in by])


def offset_checked(rows: DataFrame, text: str, start: str, end: str, surface: str) -> DataFrame:
    """Rows whose offsets (code points, ends exclusive) give their surface."""
    return rows.where(F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)) == F.col(surface))


def positions(rows: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """rows with position (from 0) in the order of (bucket, *order), without one task for all of them: each bucket is
    ranked by itself and the counts of earlier buckets, of which there are few, are added."""
    rows = rows.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = sizes.select("_b", before.alias("_e"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    return ranked.join(earlier, "_b").withColumn("position", F.col("_e") + F.col("_r") - 1).drop("_b", "_r", "_e")
