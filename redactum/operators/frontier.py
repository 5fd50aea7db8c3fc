"""Decision menus, utility credit and the privacy-utility frontier, per document and as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.operators.reports import positions
from redactum.operators.running import running


def legal_actions(actions: DataFrame, claims: DataFrame) -> DataFrame:
    """actions (doc, decision, fill) whose fill, in lower case, no other decision of the document claims."""
    c = claims.select(F.col("doc").alias("_d"), F.col("decision").alias("_o"), F.lower("fill").alias("_f"))
    return actions.join(c, (actions["doc"] == c["_d"]) & (F.lower(actions["fill"]) == c["_f"]) & (actions["decision"] != c["_o"]), "left_anti")


def fill_collisions(claims: DataFrame) -> DataFrame:
    """(doc, fill, decisions): fills that more than one decision claims; should be empty."""
    return claims.groupBy("doc", F.lower("fill").alias("fill")).agg(F.countDistinct("decision").alias("decisions")).where("decisions > 1")


def merge_vectors(points: DataFrame) -> DataFrame:
    """One row per (doc, vector): sources merged and sorted; conflict where utilities differ."""
    return points.groupBy("doc", "vector").agg(F.array_sort(F.array_distinct(F.collect_list("source"))).alias("sources"), (F.countDistinct("u") > 1).alias("conflict"))


def merge_ties(points: DataFrame) -> DataFrame:
    """(doc, u, p, multiplicity, vector): equal points once, named by their smallest vector."""
    return points.groupBy("doc", "u", "p").agg(F.count("*").alias("multiplicity"), F.min("vector").alias("vector"))


def skyline(points: DataFrame) -> DataFrame:
    """Points (merged ties) that no other of the document weakly dominates: a running maximum in place of a self join."""
    w = Window.partitionBy("doc").orderBy(F.desc("u"), F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("_best", F.max("p").over(w)).where("_best IS NULL OR p > _best").drop("_best")


def upper_hull(points: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Points of the skyline on the upper convex envelope of p over u, in order of u."""
    def bad(a: Column, b: Column, c: Column) -> Column:
        return (b.p - a.p) / (b.u - a.u) <= (c.p - b.p) / (c.u - b.u) + tolerance

    kind = dict(points.dtypes)
    t = f"array<struct<u:{kind['u']},p:{kind['p']},vector:{kind['vector']}>>"

    def push(stack: Column, c: Column) -> Column:
        """The stack after popping: the longest prefix whose last corner turns right towards c."""
        n = F.size(stack)
        keep = F.aggregate(
            F.when(n > 1, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>")),
            F.struct(n.alias("n"), F.lit(True).alias("go")),
            lambda acc, i: F.when(acc.go & bad(F.element_at(stack, i - 1), F.element_at(stack, i), c), F.struct((i - 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(acc.n.alias("n"), F.lit(False).alias("go"))),
            lambda acc: acc.n,
        )
        return F.concat(F.slice(stack, F.lit(1), keep), F.array(c))

    ordered = points.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("u", "p", "vector"))).alias("s"))
    hull = F.aggregate("s", F.array().cast(t), push)
    return ordered.select("doc", F.posexplode(hull).alias("rank", "x")).select("doc", "rank", "x.u", "x.p", "x.vector")


def switch_points(hull: DataFrame, least: int = 3) -> DataFrame:
    """(doc, lam, weight): where the best of u + lam * p moves to the next hull point; documents of `least` points or
    more, weights 1 in sum."""
    w = Window.partitionBy("doc").orderBy("u")
    n = F.count("*").over(Window.partitionBy("doc"))
    lam = (F.lead("u").over(w) - F.col("u")) / (F.col("p") - F.lead("p").over(w))
    return hull.select("doc", lam.alias("lam"), (1.0 / (n - 1)).alias("weight"), n.alias("_n")).where(f"_n >= {least} AND lam IS NOT NULL").drop("_n")


def weighted_quantiles(values: DataFrame, qs: list[float], value: str = "lam", weight: str = "weight") -> DataFrame:
    """(q, value): the first value at which the cumulative weight reaches q of the total.

    Weights are summed per value, and then over ranges of values side by side.
    """
    per = values.groupBy(value).agg(F.sum(weight).alias("w"))
    total = per.agg(F.sum("w").alias("t"))  # one row
    run = running(per, value, "w").select(value, (F.col("before_w") + F.col("w")).alias("c")).join(F.broadcast(total), how="cross")
    return run.agg(*[F.min(F.when(F.col("c") >= q * F.col("t") - 1e-12, F.col(value))).alias(f"q{i}") for i, q in enumerate(qs)]).select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("value")) for i, q in enumerate(qs)])).alias("x")).select("x.*")


def snap(values: DataFrame, grid: list[float], value: str = "lam") -> DataFrame:
    """values with `snapped`: the grid value nearest by log ratio, ties to the smaller."""
    distance = lambda g: F.abs(F.ln(F.col(value) / g))
    best = F.array_min(F.array(*[F.struct(distance(g).alias("d"), F.lit(g).alias("g")) for g in grid]))
    return values.withColumn("snapped", best.g)


def winners(points: DataFrame, lam: float, tolerance: float = 1e-9) -> DataFrame:
    """(doc, vector): of the points within tolerance of the highest u + lam * p the smallest vector."""
    score = F.col("u") + lam * F.col("p")
    best = F.max(score).over(Window.partitionBy("doc"))
    return points.withColumn("_s", score).withColumn("_b", best).where(F.col("_s") >= F.col("_b") - tolerance).groupBy("doc").agg(F.min("vector").alias("vector"))


def exact_winner(scored: DataFrame) -> DataFrame:
    """scored (doc, vector, weight, score, p): exact decimal utility, then privacy, then the smallest vector."""
    exact = F.sum(F.col("weight").cast("decimal(18,6)") * F.col("score").cast("decimal(18,6)"))
    per = scored.groupBy("doc", "vector").agg(exact.alias("utility"), F.max("p").alias("p"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("utility"), F.desc("p"), "vector"))).where("_r = 1").drop("_r")


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def weighted_utility(assertions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, utility): weighted mean of scores over policy assertions; null where their weight is 0."""
    policy = F.when(F.col("status") == "policy", F.col("weight"))
    return assertions.groupBy(*keys).agg(F.try_divide(F.sum(policy * F.col("score")), F.sum(policy)).alias("utility"))


def leave_one_out(rollouts: DataFrame, doc: str = "doc", value: str = "value") -> DataFrame:
    """rollouts with `advantage`: value less the mean of the document's other rollouts; null for a single one."""
    w = Window.partitionBy(doc)
    n = F.count(value).over(w)
    return rollouts.withColumn("advantage", F.col(value) - F.try_divide(F.sum(value).over(w) - F.col(value), n - 1))


def delta_utility(assertions: DataFrame) -> DataFrame:
    """assertions (doc, decision, weight, before, after): change per decision over its own and over all weight."""
    total = F.sum("weight").over(Window.partitionBy("doc"))
    rows = assertions.withColumn("_t", total)
    change = F.sum(F.col("weight") * (F.col("after") - F.col("before")))
    return rows.groupBy("doc", "decision").agg(F.try_divide(change, F.sum("weight")).alias("own"), F.try_divide(change, F.max("_t")).alias("share"))


def work_slots(requests: DataFrame, keys: list[str]) -> DataFrame:
    """requests with `slot`: equal requests share one; slots are numbered by the hash of their key.

    Distinct keys are aggregated first, so the ordered numbering sees each once, and counted by the first digits of
    the hash, so that no task numbers them all.
    """
    h = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]), 256)
    keyed = requests.withColumn("_h", h)
    slots = positions(keyed.select("_h").distinct(), F.substring("_h", 1, 3), "_h").withColumnRenamed("position", "slot")
    return keyed.join(slots, "_h").drop("_h")


def latin_cycle(items: Column, offset: Column, epoch: Column) -> Column:
    """The element of a menu that an epoch visits: (offset + epoch) mod n."""
    return F.element_at(items, ((offset + epoch) % F.size(items) + 1).cast("int"))


def tie_labels(evidence: DataFrame, bound: float = 0.0, contexts: int = 3) -> DataFrame:
    """evidence (pair, context, delta): pairs never over the bound that were exactly zero in enough contexts."""
    return evidence.groupBy("pair").agg(F.max(F.abs("delta")).alias("_m"), F.countDistinct(F.when(F.col("delta") == 0, F.col("context"))).alias("contexts")).where(f"_m <= {bound} AND contexts >= {contexts}").drop("_m")


def scaled_rollouts(p: Column, target: float = 0.05, low: int = 2, high: int = 32) -> Column:
    """Rollouts until something of probability 1 - p was seen with 1 - target: ceil(ln target / ln p), clamped."""
    return F.when(p <= 0, low).when(p >= 1, high).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.ceil(F.ln(F.lit(target)) / F.ln(p))))).cast("int")


def responsiveness(runs: DataFrame, doc: str, order: str, output: str) -> DataFrame:
    """(doc, share): share of neighbouring runs whose output differs."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = runs.withColumn("_p", F.lag(output).over(w)).withColumn("_n", F.row_number().over(w)).where("_n > 1")
    return rows.groupBy(doc).agg(F.avg((~F.col("_p").eqNullSafe(F.col(output))).cast("double")).alias("share"))


def wildcard_spread(vectors: DataFrame, size: int) -> DataFrame:
    """(doc, position, rest, n, spread): vectors equal but for one position, and the spread of their values."""
    rows = vectors.select("doc", "vector", "value", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("position"))
    rest = F.array_join(F.transform("vector", lambda x, i: F.when(i + 1 == F.col("position"), "*").otherwise(x.cast("string"))), ",")
    return rows.groupBy("doc", "position", rest.alias("rest")).agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread")).where("n > 1")


def hash_fold(key: Column, salt: str = "split", folds: int = 5) -> Column:
    """sha256(salt NUL key) mod 5 as the sum of its hex digits mod 5 (16 is 1 mod 5)."""
    if folds != 5:
        raise ValueError("the digit sum holds for 5 folds")
    digits = F.split(F.sha2(F.concat(F.lit(salt), F.lit("\x00"), key.cast("string")), 256), "")
    value = lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda s, d: s + value(d)) % 5


def provisional_credit(assertions: DataFrame) -> DataFrame:
    """assertions (doc, decision, weight, score, linked). (doc, decision, credit): the weighted mean score of a decision's
    own linked assertions; a decision without any takes that of its whole document."""
    mean = lambda ok: F.try_divide(F.sum(F.when(ok, F.col("weight") * F.col("score"))), F.sum(F.when(ok, F.col("weight"))))
    whole = assertions.groupBy("doc").agg(mean(F.lit(True)).alias("whole"))
    return assertions.groupBy("doc", "decision").agg(mean(F.col("linked")).alias("own")).join(whole, "doc").select("doc", "decision", F.coalesce("own", "whole").alias("credit"))
