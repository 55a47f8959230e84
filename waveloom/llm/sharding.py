"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import save, table

#: Ring places, cells of each place, virtual nodes of a shard, and how far a shard may exceed the mean.
#: The driver sees PLACES sums, and tables of at most PLACES * CELLS + PLACES * shards rows are broadcast.
PLACES, CELLS, NODES, SLACK = 16384, 16, 512, 0.002


def ring(shards: int, nodes: int = NODES, places: int = PLACES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise. A shard's nodes do not depend on how many shards there are."""
    at = [(int(hashlib.md5(f"node:{s}:{v}".encode()).hexdigest()[:12], 16) % places, s, v) for s in range(shards) for v in range(nodes)]
    return [(p, s) for p, s, _ in sorted(at)]


def plan(loads: dict[int, int], shards: int, slack: float = SLACK, nodes: int = NODES, places: int = PLACES) -> dict[int, list[tuple[int, int]]]:
    """For each place the stretches of its bytes, (first byte, shard), under the bound.

    A place belongs to the first virtual node at or after it. Home loads fill their shards up to (1 + slack) times the
    mean, places in clockwise order; what then overflows goes on clockwise to the next virtual
    nodes whose shards have room.
    """
    total = sum(loads.values())
    bound = -(-total * (1 + slack) // shards)
    nodes_of = ring(shards, nodes, places)
    room = [bound] * shards
    owner, out, over = {}, {}, []
    k = 0
    for p in range(places):
        while k < len(nodes_of) and nodes_of[k][0] < p:
            k += 1
        owner[p] = k % len(nodes_of)
    for p in sorted(loads):
        s = nodes_of[owner[p]][1]
        take = min(loads[p], room[s])
        room[s] -= take
        if take:
            out[p] = [(0, s)]
        if take < loads[p]:
            over.append((p, take))
    for p, done in over:
        k = owner[p]
        while done < loads[p]:
            k = (k + 1) % len(nodes_of)
            s = nodes_of[k][1]
            take = min(loads[p] - done, room[s])
            if take:
                room[s] -= take
                out.setdefault(p, []).append((int(done), s))
                done += take
    return out


def shard_rows(docs: DataFrame, shards: int = 8, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of text and 1), text_crc32, shard, slot.

    The ring place of a row is hashed from doc_id, its order there from doc_id, text and size. No shard
    exceeds (1 + slack) times the mean load by more than a document for each place it shares. slot numbers the rows of a
    shard from 0 without gaps. Equal rows are counted before anything is shuffled and told apart
    after, so one id, text or row may hold any share of the table. A null text has size 1 and crc 0; a null
    doc_id is an id like any other; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    each = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    key = F.md5(F.concat_ws(":", F.lit("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    number = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("long")
    each = each.withColumn("h", key).withColumn("place", (number(1, 12) % PLACES).cast("int")).withColumn("cell", (number(13, 6) % CELLS).cast("int"))
    bytes_ = F.col("size") * F.col("copies")
    in_cell = W.partitionBy("place", "cell").orderBy("h", "doc_id", "text_crc32", "size")
    each = each.withColumn("before", F.coalesce(F.sum(bytes_).over(in_cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("turn", F.row_number().over(in_cell)).drop("h")
    each = save(each, "ring-rows")
    cells = save(each.groupBy("place", "cell").agg(F.sum(bytes_).alias("bytes")), "ring-cells")
    loads = {r.place: r.bytes for r in cells.groupBy("place").agg(F.sum("bytes").alias("bytes")).collect()}  # PLACES rows at most
    stretches = [{"place": p, "to": [{"first": f, "shard": s} for f, s in x]} for p, x in plan(loads, shards, slack).items()]
    dealt = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(stretches)), "array<struct<place:int,to:array<struct<first:long,shard:int>>>>")))
    first = F.coalesce(F.sum("bytes").over(W.partitionBy("place").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("place", "cell", first.alias("first"))
    rows = each.join(F.broadcast(cells), ["place", "cell"]).join(F.broadcast(dealt), "place")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = F.col("first") + F.col("before") + F.col("copy") * F.col("size")
    rows = rows.withColumn("at", at).withColumn("shard", F.element_at(F.filter("to", lambda x: x["first"] <= F.col("at")), -1)["shard"])
    rows = save(rows.select("doc_id", "size", "text_crc32", "place", "cell", "turn", "copy", "shard"), "shard-rows")
    counts = rows.groupBy("shard", "place", "cell").agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("place", "cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "place", "cell", base.alias("base"))
    slot = F.col("base") + F.row_number().over(W.partitionBy("place", "cell", "shard").orderBy("turn", "copy")) - 1
    return rows.join(F.broadcast(counts), ["shard", "place", "cell"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
