"""The given tables read as clips, frames, catalogs and scores, with the same adapters as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom.functions import draws
from waveloom.functions import signal as S
from waveloom.operators import catalog as catalog_ops
from waveloom.operators import chunks as chunk_ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL twin."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(S.col(c), digits) + F.lit(0.0)


def R(e: str, digits: int = 6) -> str:  # noqa: N802
    return f"(round(({e})::double, {digits}) + 0::double)"


def bits_sql(seed, idx: str, slot) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {idx} || ':{slot}'), 1, 12))::bigint)"


# clips from events: the values of a user in time order

def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, x."""
    each = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", (F.col("value") / 1000).alias("v")).alias("s"))
    return each.groupBy(F.col("user_id").alias("clip_id")).agg(F.sort_array(F.collect_list("s"))["v"].alias("x"))


def signal_chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The same signals in chunk rows: clip_id, ch, start, x. No user's events meet in one row or task."""
    v = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), "ts", "event_id", (F.col("value") / 1000).alias("v"))
    return chunk_ops.gather(v, ["ts", "event_id"], size)


SIG = "sig as (select user_id as clip_id, list((value / 1000)::double order by ts, event_id) as x from events group by user_id)"

SNRS = [-5, 0, 5, 10, 20, 40]
GAINS = [-6, 0, 6]


def numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The clips with u, a number from 0 without gaps whatever the ids are, and how many there are."""
    ids, n = catalog_ops.dense_index(table(spark, sf_dir, "events").select(F.col("user_id").alias("key")).distinct())
    return signals(spark, sf_dir).join(ids.select(F.col("key").alias("clip_id"), F.col("pool_idx").alias("u")), "clip_id"), n


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, clean, noise (of another user, as long as clean), snr and gain drawn, noisy, enhanced.

    enhanced is the mixture with a tenth of its noise, a stand-in for a model's output.
    """
    sig, n = numbered(spark, sf_dir)
    other = sig.select(F.col("u").alias("other"), F.col("x").alias("y"))
    both = sig.withColumn("other", (F.col("u") * 7 + 3) % n).join(other, "other")
    both = both.select("clip_id", F.col("x").alias("clean"), S.fit_length("y", F.size("x")).alias("noise"), draws.choice(SNRS, 1, F.col("clip_id"), "snr").alias("snr"), draws.choice(GAINS, 1, F.col("clip_id"), "gain").alias("gain"))
    k = S.mix_gain("clean", "noise", "snr")
    both = both.withColumn("k", k)
    mixed = lambda k: F.zip_with("clean", "noise", lambda c, n: c + k * n)
    weak = lambda k: F.zip_with("clean", "noise", lambda c, n: c + k * 0.1 * n)
    return both.withColumn("noisy", S.once("k", mixed)).withColumn("enhanced", S.once("k", weak))


def _choice_sql(values: list, idx: str, slot: str) -> str:
    return f"list_extract([{', '.join(map(str, values))}], (({bits_sql(1, idx, slot)} % {len(values)}) + 1))"


def en(x: str) -> str:
    return f"list_reduce(list_transform({x}, lambda v: v * v), lambda a, b: a + b, 0::double)"


def dt(x: str, y: str) -> str:
    return f"list_reduce(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2]), lambda a, b: a + b, 0::double)"


def sm(x: str) -> str:
    return f"list_reduce({x}, lambda a, b: a + b, 0::double)"


NUMBERED = f"{SIG}, un as (select clip_id, x, row_number() over (order by {bits_sql(0, 'clip_id', 'pool')}, clip_id) - 1 as u, count(*) over () as n from sig)"
PAIRS = f"""{NUMBERED},
p0 as (select a.clip_id, a.x as clean, b.x as y, {_choice_sql(SNRS, 'a.clip_id', 'snr')} as snr, {_choice_sql(GAINS, 'a.clip_id', 'gain')} as gain
       from un a join un b on b.u = (a.u * 7 + 3) % a.n),
p1 as (select *, list_transform(range(0, len(clean)), lambda i: y[(i % len(y)) + 1]) as noise from p0),
p2 as (select *, 1 / sqrt(({en('noise')} + 1e-10::double) / ({en('clean')} + 1e-10::double) * pow(10::double, snr / 10::double) + 1e-10::double) as k from p1),
pairs as (select clip_id, clean, noise, snr, gain, k, list_transform(list_zip(clean, noise), lambda z: z[1] + k * z[2]) as noisy,
          list_transform(list_zip(clean, noise), lambda z: z[1] + k * 0.1::double * z[2]) as enhanced from p2)"""


# frames from embeddings

BINS = 32


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, ch, t, re, im: two halves of each vector, numbered within its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    t = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("clip_id"), F.lit(0).alias("ch"), t.cast("long").alias("t"), F.slice("e", 1, BINS).alias("re"), F.slice("e", BINS + 1, BINS).alias("im"))


FRAMES = f"""fr as (select label::bigint as clip_id, 0 as ch, (row_number() over (partition by label order by vec_id) - 1)::bigint as t,
  list_transform(embedding[1:{BINS}], lambda v: v::double) as re, list_transform(embedding[{BINS + 1}:{2 * BINS}], lambda v: v::double) as im from embeddings)"""


# a catalog from documents

FACTORS = [0.5, 1.0, 1.5, 2.5]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ds_name, ds_type, key, n_samples, sr, group (speaker), factor of the dataset."""
    d = table(spark, sf_dir, "documents")
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    kind = F.when(F.col("lang") == "en", "speech").when(F.col("lang") == "de", "noise").otherwise("rir")
    return d.select(F.col("source").alias("ds_name"), kind.alias("ds_type"), F.col("doc_id").alias("key"), F.col("n_chars").alias("n_samples"), F.when(F.col("doc_id") % 2 == 0, 48000).otherwise(16000).alias("sr"),
                    F.element_at(F.array(*map(F.lit, FACTORS)), number % 4 + 1).alias("factor"))


CATALOG = f"""cat as (select source as ds_name, case lang when 'en' then 'speech' when 'de' then 'noise' else 'rir' end as ds_type, doc_id as key, n_chars as n_samples,
  case when doc_id % 2 = 0 then 48000 else 16000 end as sr, ([0.5::double, 1, 1.5, 2.5])[regexp_extract(source, '([0-9]+)$', 1)::int % 4 + 1] as factor from documents)"""


# score tables from lineitem and orders

def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filename, variant, metric, snr, value; of repeated keys the mean."""
    li = table(spark, sf_dir, "lineitem")
    variant = F.when(F.col("l_linestatus") == "O", "noisy").otherwise("enhanced")
    return li.groupBy(F.col("l_orderkey").alias("filename"), variant.alias("variant"), F.col("l_returnflag").alias("metric")).agg(F.min("l_linenumber").alias("snr"), F.avg("l_quantity").alias("value"))


SCORES = """sc as (select l_orderkey as filename, case when l_linestatus = 'O' then 'noisy' else 'enhanced' end as variant, l_returnflag as metric, min(l_linenumber) as snr, avg(l_quantity) as value
  from lineitem group by 1, 2, 3)"""
METRICS = ["A", "N", "R"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, epoch, value from orders."""
    e = F.row_number().over(W.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), e.cast("long").alias("epoch"), F.col("o_totalprice").alias("value"))


RUNS = "runs as (select o_orderpriority as run, row_number() over (partition by o_orderpriority order by o_orderkey) as epoch, o_totalprice as value from orders)"
