"""Connected components of entity links by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(links: DataFrame) -> DataFrame:
    """links (u, v). (node, root): the smallest node each one reaches; links with a null end are ignored.

    Each round takes the smallest label among the neighbours and then that label's own label, so long chains shorten
    by half; rounds end when nothing changes, which is bounded by the number of nodes. A checkpoint ends every round's
    lineage, and the labels of earlier rounds are dropped from the store.
    """
    spark = links.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="redactum-"))
    links = links.where("u IS NOT NULL AND v IS NOT NULL")
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        better = labels.join(near, "node").select("node", F.least("root", "m").alias("root"))
        jump = better.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = better.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root")).checkpoint()
        if new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").isEmpty():
            return new
        _drop(spark, labels)
        labels = new


def _drop(spark, frame: DataFrame) -> None:
    """Remove the files of a checkpointed frame that no plan reads any more."""
    for rdd in [frame._jdf.queryExecution().logical().rdd()]:
        if rdd.getCheckpointFile().isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
