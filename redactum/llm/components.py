"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactum.llm import common


def _largest_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u")
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _smallest_star(links: DataFrame) -> DataFrame:
    """links: u > v. Every node links itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v), longs. Returns (node, root) for each node but the roots; root is the smallest node reachable.

    Each round is written to shared storage, which cuts the lineage; only a count and a checksum reach the driver.
    Self links, repeated links and an empty table are fine; links with a null end are ignored.
    """
    rounds = common.Rounds(links.sparkSession, "links")
    edges = rounds.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if not now.n or (now.n, now.h) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (now.n, now.h)
        edges = rounds.write(_smallest_star(_largest_star(edges)))
