"""Where intermediate tables go, and small helpers that several operators use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.sources.tables import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: what follows no longer depends on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(id_col: str):
    """crc32 of the id as text, modulo 5: which fold a document belongs to."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def slots(spark: SparkSession) -> int:
    """Partitions for work that Spark does not size itself."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def smallest(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows of df with the smallest hash of keys, at most so many, in that order; the same whatever the partitions.

    Rows far above the hash that about four times as many lie below are left out before the sort, so that a large table sends
    few rows to it.
    """
    hashed = df.withColumn("__h", F.xxhash64(*keys))
    total = df.count()
    if total > 4 * rows:
        hashed = hashed.where(F.col("__h") < -(1 << 63) + int(4 * rows / total * (1 << 64)))
    return hashed.orderBy("__h", *keys).limit(rows).drop("__h")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of the undirected links; label is the smallest node reachable.

    Rounds of: each node takes the smallest label among its neighbours and itself, then labels jump to their own label.
    Both are an aggregate (combined before its shuffle) and an equi-join, so a hot node costs one partial row a task.
    Every round is written to the shared folder. No links: an empty table.
    """
    both = cut(
        links.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .unionByName(links.select(F.col(b).alias("node"), F.col(a).alias("other")))
        .distinct()
    )
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        best = both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(best, "node").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("top"))
        after = cut(
            step.join(up, "next", "left").select("node", "label", F.least("next", "top").alias("next"))
        )
        changed = after.where(F.col("next") < F.col("label")).limit(1).count()
        labels = after.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
