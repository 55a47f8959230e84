"""Rows dealt to tasks so that each has about the same number of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranks import BROADCAST_ROWS, sorted_ranks

#: Samples of a task, where there are enough for all cores.
TASK_SAMPLES = 1 << 24


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that repartition(n, number) sends there."""
    found = spark.range(40 * n + 100).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("k")).collect()  # n rows
    keys = {r.p: r.k for r in found}
    return [keys.get(p, p) for p in range(n)]


def balanced(rows: DataFrame, key: str, size: Column, task_samples: int = TASK_SAMPLES) -> DataFrame:
    """rows in partitions of about equal sums of `size`: bins take the rows by falling size, back and forth (bins 0, 1, ... n - 1, n - 1,
    ... 0), so two bins differ by less than the largest row. As many bins as there are task_samples samples, and no fewer than cores.

    rows are read twice, for the sizes and for the rows; only keys and sizes are ranked. Rows of equal or null keys stay together.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(key).agg(F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("_size"))
    ranked = sorted_ranks(sizes.withColumn("_all", F.lit(0)).withColumn("_neg", -F.col("_size")), "_all", ["_neg", key])
    n, total = ranked.agg(F.count(F.lit(1)), F.sum("_size")).first()
    bins = max(1, min(n or 1, max(spark.sparkContext.defaultParallelism, -(-(total or 0) // task_samples))))
    at = F.col("_r") % (2 * bins)
    keys = F.array(*[F.lit(k).cast("long") for k in partition_keys(spark, bins)])  # long, as the numbers that were hashed
    table = ranked.select(F.col(key).alias("_key"), F.get(keys, F.when(at < bins, at).otherwise(2 * bins - 1 - at).cast("int")).alias("_bin"))
    table = F.broadcast(table) if n <= BROADCAST_ROWS else table
    return rows.join(table, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").repartition(bins, "_bin").drop("_bin")
