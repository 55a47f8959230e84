"""What was left out and why: rows with reasons beside the rows that go on, and counts taken while a job runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def with_reasons(rows: DataFrame, rules: list[tuple[str, Column]], column: str = "reasons") -> DataFrame:
    """rows with the names of the rules (name, condition) that a row does not meet; a condition that is null is not met."""
    return rows.withColumn(column, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])))


def split(rows: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame, Observation]:
    """(rows that meet all rules, rows that do not with `reasons`, counts). Once the kept rows have been written or counted in full, counts.get
    has `rows`, `kept` and one entry per rule with the rows that break it; no second pass is made for them."""
    seen = Observation("rejects")
    marked = with_reasons(rows, rules, "_reasons")
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_reasons") == 0).alias("kept"), *[F.count_if(F.array_contains("_reasons", name)).alias(name) for name, _ in rules])
    return counted.where(F.size("_reasons") == 0).drop("_reasons"), marked.where(F.size("_reasons") > 0).withColumnRenamed("_reasons", "reasons"), seen


def problems(rows: DataFrame, key: str, column: str = "failed") -> DataFrame:
    """key, reason: one row for each entry of an array column of names."""
    return rows.select(key, F.explode(column).alias("reason"))


def failed_scores(scores: DataFrame) -> DataFrame:
    """filename, variant, metric, error: measures of an evaluation that gave no value because of an error."""
    return scores.where(F.col("error").isNotNull()).select("filename", "variant", "metric", "error")
