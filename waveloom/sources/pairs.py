"""Signal tables in buckets of the base name, so that clean, noisy and enhanced signals meet without a shuffle of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.operators.catalog import base_name


def save_bucketed(clips: DataFrame, name: str, buckets: int) -> None:
    """Writes clips (file, x) as a table of the session's catalog, in buckets by `name`, the base name of the file. Tables that are to
    be paired have the same number of buckets: some times as many as cores, and so that a bucket fits a task. A name that
    occurs twice, or a file without a name, is an error, as it would make false pairs."""
    named = clips.where("file is not null").select(base_name("file").alias("name"), "file", "x")
    twice = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice.n} files are named {twice.name}")
    named.repartition(buckets, "name").sortWithinPartitions("name").write.bucketBy(buckets, "name").sortBy("name").format("parquet").mode("overwrite").saveAsTable(name)


def paired(spark: SparkSession, clean: str, noisy: str, enhanced: str | None = None) -> DataFrame:
    """filename, clean, noisy (and enhanced): the signals of bucketed tables by base name. No Exchange: each task reads one bucket of each."""
    tables = {"clean": clean, "noisy": noisy} | ({"enhanced": enhanced} if enhanced else {})
    out = None
    for column, table in tables.items():
        side = spark.table(table).select("name", F.col("x").alias(column)).hint("merge")
        out = side if out is None else out.join(side, "name")
    return out.withColumnRenamed("name", "filename")
