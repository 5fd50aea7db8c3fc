"""Running totals over a whole table, without passing it through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order that are summed side by side.
RANGES = 128


def running(rows: DataFrame, order: str, *values: str, descending: bool = False) -> DataFrame:
    """rows with before_<value>: the sum of a value over all rows that stand strictly before in the order; equal rows have
    equal sums. order is a number; nulls stand first.

    Approximate quantiles part the rows into ranges; each is summed by itself, and the totals of earlier ranges, of
    which there are at most RANGES + 1, are added. What the quantiles are does not change the sums.
    """
    key = F.col(order).cast("double")
    bounds = rows.select(key.alias("_k")).approxQuantile("_k", [i / RANGES for i in range(1, RANGES)], 0.01)
    rank = F.lit(0)
    if bounds:
        cuts = sorted(set(bounds))
        rank = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b <= key)), F.lit(0)) if cuts else rank
        rank = F.when(key.isNull(), -1).otherwise(rank)
    rows = rows.withColumn("_range", -rank if descending else rank).withColumn("_key", -key if descending else key)
    within = Window.partitionBy("_range").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_range", "_key")
    totals = rows.groupBy("_range").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_a{i}") for i in range(len(values))])
    near = rows.select("*", *[(F.coalesce(F.sum(v).over(within), F.lit(0)) - F.coalesce(F.sum(v).over(same), F.lit(0))).alias(f"_n{i}") for i, v in enumerate(values)])
    out = near.join(ahead, near["_range"].eqNullSafe(ahead["_range"])).drop("_range")
    return out.select("*", *[(F.col(f"_a{i}") + F.col(f"_n{i}")).alias(f"before_{v}") for i, v in enumerate(values)]).drop("_key", *[f"{p}{i}" for i in range(len(values)) for p in ("_a", "_n")])
