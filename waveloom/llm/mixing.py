"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, table

#: The table of rates is broadcast up to this many bytes (names and distribution functions). Beyond that it is joined
#: by a shuffle; both sides are plain shuffles then, so Spark splits a hot source and repeats its one row of rates.
BROADCAST_BYTES = 32 << 20
#: A larger mean is drawn as a sum of equal parts up to this, so that exp(-mean) stays far from 0.
LARGEST_MEAN = 500.0
SEED = 17


def draw(*parts):
    """A uniform number in [0, 1) from the first 48 bits of the md5 of the parts joined by ':'."""
    return bits48(*parts) / F.lit(float(1 << 48))


def bits48(*parts):
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 12), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None, total: int | None, column: str) -> DataFrame:
    """One row per source: source, mean (target rows / rows), and cdf, the Poisson distribution function of the mean.

    Targets are total * weight / sum of the weights of the sources that have rows.
    """
    counts = save(docs.groupBy(F.col(column).alias("source")).agg(F.count(F.lit(1)).alias("n")), "source-counts")
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("weight", weight)
    sums = counts.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows")).first()
    goal = float((sums.rows or 0) if total is None else total)
    mean = F.lit(goal) * F.col("weight") / F.lit(float(sums.weights)) / F.col("n") if sums.weights else F.lit(0.0)
    out = counts.select("source", mean.alias("mean"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / LARGEST_MEAN)).cast("int")).withColumn("m", F.col("mean") / F.col("parts"))
    steps = F.sequence(F.lit(1), (F.col("m") + 12 * F.sqrt("m") + 24).cast("int"))
    first = F.exp(-F.col("m"))
    cdf = F.aggregate(steps, F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
                      lambda a, i: F.struct((a["p"] * F.col("m") / i).alias("p"), (a["c"] + a["p"] * F.col("m") / i).alias("c"), F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("m") / i)).alias("all")),
                      lambda a: a["all"])
    return out.select("source", "mean", "parts", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, column: str = "source", shuffle: bool = True) -> DataFrame:
    """docs with each row repeated by a Poisson draw, so that sources come to their target shares in the mean.

    weights: source to weight (None: all sources equal; a source not named gets none); total: mean number of rows
    (None: as many as docs has). A row's count inverts the Poisson distribution of its source's mean at a
    uniform number hashed from (seed, doc_id), so it does not depend on partitions; rows with equal or null ids draw
    alike. Adds copy (0-based) and mix_key, 48 hashed bits of (seed, doc_id, copy); a column of docs that has one of
    these names already stays, and the added one gets a name with "_" behind. Rows are dealt to partitions by mix_key
    and sorted by it inside: a global random order. A null source is a source, and so is the empty
    string. Text is not looked at; an empty table stays empty.
    """
    keep = docs.columns
    names = {n: n if n in ("copy", "mix_key") else f"_{n}" for n in ("source", "parts", "cdf", "n", "copy", "mix_key")}
    for n in names:
        while names[n] in keep:
            names[n] += "_"
    found = save(rates(docs, weights, total, column).select(F.col("source").alias(names["source"]), F.col("parts").alias(names["parts"]), F.col("cdf").alias(names["cdf"])), "source-rates")
    size = found.agg(F.sum(64 + 8 * F.size(names["cdf"]) + F.coalesce(F.octet_length(F.col(names["source"]).cast("string")), F.lit(0)))).first()[0] or 0
    here = F.col(column)
    there = F.col(names["source"])
    if size <= BROADCAST_BYTES:
        both = docs.join(F.broadcast(found), here.eqNullSafe(there))
    else:
        both = docs.join(found, (F.coalesce(F.xxhash64(here), F.lit(0)) == F.coalesce(F.xxhash64(there), F.lit(0))) & here.eqNullSafe(there))
    id_ = F.col("doc_id")

    def part(j):
        u = F.when(j == 0, draw(F.lit(seed), id_)).otherwise(draw(F.lit(seed), id_, j))
        return F.size(F.filter(names["cdf"], lambda c: c <= u))

    count = F.when(F.col(names["parts"]) == 1, part(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.col(names["parts"]) - 1), F.lit(0), lambda a, j: a + part(j)))
    out = both.withColumn(names["n"], count).where(F.col(names["n"]) > 0)
    out = out.select(*keep, F.explode(F.sequence(F.lit(0), F.col(names["n"]) - 1)).alias(names["copy"])).withColumn(names["mix_key"], bits48(F.lit(seed), F.lit("order"), id_, F.col(names["copy"])))
    return out.repartition(names["mix_key"]).sortWithinPartitions(names["mix_key"], "doc_id", names["copy"]) if shuffle else out


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
with recursive n as (select source, count(*) as n from documents group by source),
r as (select source, (select sum(n) from n)::double * 1.0::double / (select count(*) from n)::double / n::double as m from n),
c(source, m, i, p, c) as (select source, m, 0, exp(-m), exp(-m) from r
  union all select source, m, i + 1, p * m / (i + 1), c + p * m / (i + 1) from c where i < floor(m + 12 * sqrt(m) + 24)),
u as (select d.*, ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 12))::bigint / 281474976710656.0::double as u from documents d),
k as (select u.*, (select count(*) from c where c.source is not distinct from u.source and c.c <= u.u) as k from u),
e as (select * exclude (u, k), unnest(range(0, k)) as copy from k)
select * exclude (copy), cast(copy as integer) as copy, ('0x' || substr(md5('{SEED}:order:' || coalesce(cast(doc_id as varchar), 'null') || ':' || copy), 1, 12))::bigint as mix_key from e
"""
