"""Statistics of evaluation: splits, ranks, quantiles, thresholds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactum.operators.running import running


def hash_order(key: Column, seed: str) -> Column:
    """A fixed pseudo-random order: sha256 of seed and key. Takes the place of a seeded shuffle."""
    return F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)


def stratified_split(rows: DataFrame, key: str, stratum: str, cuts: tuple[float, float] = (0.7, 0.85), seed: str = "0") -> DataFrame:
    """rows with `part` train, dev or test: cut points in hash order within each stratum."""
    w = Window.partitionBy(stratum)
    r = F.row_number().over(w.orderBy(hash_order(F.col(key), seed), key)) - 1
    share = r / F.count("*").over(w)
    return rows.withColumn("part", F.when(share < cuts[0], "train").when(share < cuts[1], "dev").otherwise("test"))


def folds(rows: DataFrame, key: str, stratum: str, k: int, seed: str = "0") -> DataFrame:
    """rows with `fold`: round robin in hash order within each stratum."""
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)) - 1
    return rows.withColumn("fold", (r % k).cast("int"))


def average_ranks(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """rows with `name`: rank within the group, ties the mean of their places."""
    w = Window.partitionBy(group)
    return rows.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(group, value)) - 1) / 2)


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, rho): Pearson correlation of the average ranks; null where either is constant."""
    ranked = average_ranks(average_ranks(rows, group, x, "_x"), group, y, "_y")
    rho = F.when((F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y")), F.corr("_x", "_y"))
    return ranked.groupBy(group).agg(rho.alias("rho"))


def mean_baseline(train: DataFrame, test: DataFrame, kind: str, value: str, floor: float = 1e-6) -> DataFrame:
    """test with mean and std of its type over train; types not seen take those of all of train."""
    stats = lambda df, *by: df.groupBy(*by).agg(F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("std"))
    whole = stats(train).select(F.col("mean").alias("_m"), F.col("std").alias("_s"))
    joined = test.join(stats(train, kind), kind, "left").crossJoin(F.broadcast(whole))
    return joined.withColumns({"mean": F.coalesce("mean", "_m"), "std": F.coalesce("std", "_s")}).drop("_m", "_s")


def quantile(value: str, p: float) -> Column:
    """Linearly interpolated quantile."""
    return F.percentile(value, F.lit(p))


def exact_bootstrap(differences: list[float]) -> list[float]:
    """Means of all n^n resamples of a few paired differences (seeds); sorted."""
    n = len(differences)
    return sorted(sum(d) / n for d in product(differences, repeat=n))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, extremes, mean and signs of a value."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"))


def choose_threshold(pairs: DataFrame, precision: float, recall: float, label: str = "label", score: str = "score") -> DataFrame:
    """One row `threshold`: the smallest score cut whose precision and recall both suffice; null if none does.

    Counts per distinct score come first; they are summed over ranges of scores side by side.
    """
    per = pairs.groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    cut = running(per, score, "pos", "n", descending=True)
    total = pairs.agg(F.sum(label).alias("t"))  # one row
    run = cut.select(score, (F.col("before_pos") + F.col("pos")).alias("tp"), (F.col("before_n") + F.col("n")).alias("taken")).join(F.broadcast(total), how="cross")
    ok = (F.col("tp") / F.col("taken") >= precision) & (F.col("tp") / F.col("t") >= recall)
    return run.agg(F.min(F.when(ok, F.col(score))).alias("threshold"))


def flat_share(levels: DataFrame, key: list[str], order: str, count: str) -> DataFrame:
    """(key..., flat, clipped): share of neighbouring levels with equal counts, and of counts below 1."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = levels.withColumn("_p", F.lag(count).over(w))
    return rows.groupBy(*key).agg(F.avg(F.when(F.col("_p").isNotNull(), (F.col("_p") == F.col(count)).cast("double"))).alias("flat"), F.avg((F.col(count) < 1).cast("double")).alias("clipped"))
