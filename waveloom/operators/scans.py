"""Running values along ordered groups of any size: rows are dealt into ranges, each range is scanned, and what a range hands on to those
after it travels through a table with one row for each range of a group. No window spans a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom.sources.paths import save

from .ranks import BROADCAST_ROWS, RANGE_ROWS


def in_ranges(rows: DataFrame, group: str, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with _p, a number of the range they are in, and _t, which tells equal rows apart: ranges ascend with (group, order), none is
    much longer than range_rows, and a group may have many. Written once, as scans read them twice."""
    cut = rows.withColumn("_t", F.monotonically_increasing_id())
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // range_rows))
    return save(cut.repartitionByRange(parts, group, *order, "_t").withColumn("_p", F.spark_partition_id()), "ranges")


def _joined(rows: DataFrame, group: str, table: DataFrame) -> DataFrame:
    """rows with the columns of the table (_g, _q, ...), of which there is one row for each range of a group."""
    side = F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
    return rows.join(side, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")), "left").drop("_g", "_q")


def running(rows: DataFrame, group: str, order: list[str], value: Column, how: str, name: str, before: bool = False) -> DataFrame:
    """rows (of in_ranges) with the least ('min') or greatest ('max') value of the rows of the group up to each, or (before) of those before
    it; nulls do not count, and null where there is none."""
    best, pick = (F.min, F.least) if how == "min" else (F.max, F.greatest)
    each = rows.groupBy(group, "_p").agg(best(value).alias("_v"))
    carry = best("_v").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    carries = save(each.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), carry.alias("_carry")), "carries")
    own = W.partitionBy(group, "_p").orderBy(*order, "_t").rowsBetween(W.unboundedPreceding, -1 if before else 0)
    out = rows.withColumn("_own", best(value).over(own))
    out = _joined(out, group, carries)
    return out.withColumn(name, pick("_own", "_carry")).drop("_own", "_carry")


def trailing_mean(rows: DataFrame, group: str, order: list[str], value: str, n: int, name: str) -> DataFrame:
    """rows (of in_ranges) with the mean of the values of the last n rows of the group, each its own last.

    The last n - 1 rows of a range are lent to the ranges after it that reach back to them.
    """
    counts = rows.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    start = F.coalesce(F.sum("_c").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    table = save(counts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), "_c", start.alias("_s")), "range-starts")
    place = W.partitionBy(group, "_p").orderBy(*order, "_t")
    ranked = _joined(rows.withColumn("_i", F.row_number().over(place) - 1), group, table)
    tails = ranked.where(F.col("_i") >= F.col("_c") - (n - 1)).withColumn("_r", F.col("_s") + F.col("_i")).drop("_i", "_c", "_s", "_p")
    later = table.select("_g", F.col("_q").alias("_p"), "_s")
    lent = tails.join(F.broadcast(later) if later.count() <= BROADCAST_ROWS else later, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_s") > F.col("_r")) & (F.col("_s") <= F.col("_r") + (n - 1)))
    both = rows.withColumn("_lent", F.lit(False)).unionByName(lent.drop("_g", "_s", "_r").withColumn("_lent", F.lit(True)))
    w = W.partitionBy(group, "_p").orderBy(*order, "_t").rowsBetween(-(n - 1), 0)
    return both.withColumn(name, F.avg(value).over(w)).where(~F.col("_lent")).drop("_lent")
