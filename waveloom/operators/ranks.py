"""Ranks inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom.sources.paths import save

#: Rows of a hash range or a sorted part, about; and rows of a table of counts that is still broadcast.
RANGE_ROWS, BROADCAST_ROWS = 500_000, 200_000


def _with_offsets(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with _p (parts of each group, in order) get _r, the rank in the group from 0, and _n, the group's rows."""
    counts = rows.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = save(counts.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), before.alias("_b"), F.sum("_c").over(W.partitionBy(group)).alias("_n")), "rank-offsets")
    side = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    rank = F.row_number().over(W.partitionBy(group, "_p").orderBy(*order)) - 1
    out = rows.withColumn("_r", rank).join(side, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return out.withColumn("_r", F.col("_r") + F.col("_b")).drop("_g", "_q", "_b", "_p")


def random_ranks(rows: DataFrame, group: str, bits: Column, tie: str) -> DataFrame:
    """rows with _r, the rank by (48 hashed bits, tie) within the group, and _n, the group's size.

    Each group is cut into hash ranges, as many as its table has RANGE_ROWS rows and 64 at least; ranks are counted inside them and
    moved on by the counts of those before.
    """
    parts = 64
    n = rows.count()
    while parts * RANGE_ROWS < n and parts < 1 << 20:
        parts *= 2
    cut = rows.withColumn("_h", bits).withColumn("_p", F.floor(F.col("_h") / float((1 << 48) // parts)).cast("int"))
    return _with_offsets(cut, group, ["_h", tie]).drop("_h")


def sorted_ranks(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with _r, the rank by the columns `order` within the group (equal ones in any order), and _n, the group's size.

    Rows are dealt by ranges of (group, order, number of the row), so neither a group nor equal values have to fit into one
    task, and written once, as both the counts and the ranks read them.
    """
    cut = rows.withColumn("_t", F.monotonically_increasing_id())
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    dealt = save(cut.repartitionByRange(parts, group, *order, "_t").withColumn("_p", F.spark_partition_id()), "sorted-parts")
    return _with_offsets(dealt, group, [*order, "_t"]).drop("_t")
