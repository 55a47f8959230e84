"""Queries through sources, sinks and streams; streams read the events table as files and run to its end."""

from __future__ import annotations

import contextlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom.functions import signal as S
from waveloom.sources import audio as A
from waveloom.sources.paths import new_path, open_write
from waveloom.sources.wav_source import read_wav_chunks
from waveloom.streaming import streams as T
from waveloom.streaming.ordered import BUCKETS

from . import score_queries, spectral_queries  # noqa: F401  their SQL is that of the streams
from .adapters import METRICS, PAIRS, SCORES, SIG, SQL, R, pairs, query, r, scores, signals, sm, table


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session inside of the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without_empty_batches(spark: SparkSession):
    """For queries with timers that run to the end of their source: they would wait for timers in micro-batches without rows for ever."""
    return setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false")


def state_partitions(spark: SparkSession):
    """Partitions of state, which a query keeps for life. Each starts a worker and a store in every micro-batch, for about a second, with rows or
    without, so there are two for each core, and not more because the tables are larger; `BUCKETS` keys fill no more than so many anyway."""
    name = "spark.sql.shuffle.partitions"
    return setting(spark, name, str(min(int(spark.conf.get(name)), 2 * spark.sparkContext.defaultParallelism, BUCKETS)))


def drained(df: DataFrame, name: str, timers: bool = True, paths: tuple[str, str] | None = None) -> DataFrame:
    """All rows of a stream after it has run to the end of its source. timers: whether it has some of processing time. paths: those of an
    earlier run, for its output and state, to go on where it ended."""
    spark = df.sparkSession
    out, state = paths or (new_path(spark, name), new_path(spark, name + "-state"))
    with state_partitions(spark), without_empty_batches(spark) if timers else contextlib.nullcontext():
        started = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def late_log(numbered: DataFrame, name: str, slices: int = 4) -> DataFrame:
    """Rows (stream_id, seq from 0, ...) as a stream of several micro-batches in which packets overtake each other by up to three places and
    one in ten comes a second time, a slice later."""
    spark, path = numbered.sparkSession, new_path(numbered.sparkSession, name)
    h = F.pmod(F.xxhash64("stream_id", "seq"), F.lit(70)).cast("int")
    at = F.least(F.greatest(F.floor(slices * (F.col("seq") + h % 7 - 3) / F.col("_n")), F.lit(0)), F.lit(slices - 1)).cast("int")
    rows = numbered.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("stream_id"))).withColumn("_at", F.explode(F.when(h < 7, F.array(at, F.least(at + 1, F.lit(slices - 1)))).otherwise(F.array(at))))
    rows.drop("_n").write.partitionBy("_at").parquet(path + "-all")
    schema = numbered.schema
    for k in range(slices):  # one after another, so that the source takes them as micro-batches in this order
        spark.read.parquet(path + "-all").where(F.col("_at") == k).drop("_at").write.mode("append").parquet(path)
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // slices)).parquet(path)


def _packets(spark: SparkSession, d: str, name: str, samples=None, **more) -> DataFrame:
    """The events of each user as packets 0, 1, ... in time order, as a log of late packets."""
    seq = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    rows = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), seq.alias("seq"), *([] if samples is None else [samples.alias("samples")]), *[c.alias(k) for k, c in more.items()])
    return late_log(rows, name)


def _v():
    return F.col("value") / 1000


@query(f"""with {SIG}, f as (select clip_id as stream_id, flatten(list_transform(x, lambda v: [v, v / 2, v / 4])) as y from sig), k as (select stream_id, y, unnest(range(0, len(y) // 4)) as t from f)
select stream_id, t, {R(sm('y[t * 4 + 1:t * 4 + 4]'), 8)} as total, {R('y[t * 4 + 1]', 8)} as first from k""")
def w1_rechunk(spark, d):
    out = drained(T.rechunk(_packets(spark, d, "packets", F.array(_v(), _v() / 2, _v() / 4)), 4), "rechunk")
    return out.select("stream_id", "t", r(S.total("samples"), 8).alias("total"), r(F.get("samples", F.lit(0)), 8).alias("first"))


@query(SQL["e3_features"])
def w2_stream_features(spark, d):
    x = drained(T.stream_features(_packets(spark, d, "packets", F.array(_v())), 16, 8, [1, 2, 2, 4], 5, 0.9), "features")
    x = x.select(F.col("stream_id").alias("clip_id"), "t", F.posexplode("feat_erb").alias("f", "v"))
    return x.select("clip_id", "t", F.col("f").cast("long").alias("f"), r("v", 5).alias("feat_erb"))


_W3 = """q as (select user_id, event_id, ts, (value / 1000) * (value / 1000) < 0.004 as quiet, row_number() over (partition by user_id order by ts, event_id) as n from events),
l as (select *, coalesce(max(case when not quiet then n end) over (partition by user_id order by n rows unbounded preceding), 0) as last from q)"""


@query(f"with {_W3} select user_id as stream_id, event_id as t, n - last > 5 as silent from l")
def w3_silence_gate(spark, d):
    return drained(T.silence_gate(_packets(spark, d, "frames", t=F.col("event_id"), level=_v() * _v()), 0.004, seq="seq"), "gate")


@query(f"with {SIG}, k as (select clip_id as stream_id, x, unnest(range(0, (len(x) // 8) * 8)) as i from sig) select stream_id, i, {R('case when i < 8 then 0 else 0.5::double * x[i - 8 + 1] end', 7)} as x from k")
def w4_stream_enhance(spark, d):
    import numpy as np

    half = lambda s: (np.full(s.shape, 0.5), None)
    out = drained(T.stream_enhance(_packets(spark, d, "packets", F.array(_v())), half, 16, 8), "enhance")
    out = out.select("stream_id", "t", F.posexplode("samples").alias("k", "x"))
    return out.select("stream_id", (F.col("t") * 8 + F.col("k")).alias("i"), r("x", 7).alias("x"))


@query(SQL["j7_asof_controls"])
def w5_live_controls(spark, d):
    """Frames and controls are two streams; both are cut into slices of time, and rows come up to a day late within them."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value", (F.col("event_type") == "signup").alias("control"))
    low, high = rows.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    day, slices = 86_400.0, 4
    late = F.col("ts").cast("double") + F.pmod(F.xxhash64("id"), F.lit(int(day))) - (low or 0.0)
    at = F.least(F.floor(late * slices / max((high or 0.0) + day - (low or 0.0), 1.0)), F.lit(slices - 1)).cast("int")
    # a last row of a stream of its own moves both watermarks past the end
    end = spark.range(1).select(F.lit(None).cast("long").alias("stream_id"), F.timestamp_seconds(F.lit((high or 0.0) + 3 * day)).alias("ts"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("value"), F.explode(F.array(F.lit(True), F.lit(False))).alias("control"), F.lit(slices).alias("at"))
    path = new_path(spark, "late")
    rows.withColumn("at", at).unionByName(end).write.partitionBy("control", "at").parquet(path)
    part = rows.drop("control").schema
    kinds = {}
    for control in ("false", "true"):
        spark.createDataFrame([], part).write.parquet(f"{path}-{control}")
        kinds[control] = spark.readStream.schema(part).parquet(f"{path}-{control}")
    out = T.with_controls(kinds["false"].select("stream_id", "ts", "id"), kinds["true"].select("stream_id", "ts", "value"), "2 days")
    held = new_path(spark, "controls"), new_path(spark, "controls-state")
    for k in range(slices + 1):  # the query takes up each slice whole when it has come: a part of one would move the watermark past the rest
        for control in ("false", "true"):
            spark.read.parquet(path).where((F.col("control") == (control == "true")) & (F.col("at") == k)).select(*part.names).write.mode("append").parquet(f"{path}-{control}")
        done = drained(out, "controls", timers=False, paths=held)
    return done.where("stream_id is not null").select(F.col("id").alias("event_id"), r("setting").alias("setting"))


@query("""with recursive c as (select o_custkey as stream_id, row_number() over (partition by o_custkey order by o_orderkey) as seq, o_totalprice / (o_custkey * 200 + 250000) as rtf from orders),
f(stream_id, seq, delay, n) as (select distinct stream_id, 0::bigint, 100::bigint, (-1)::bigint from c union all
  select f.stream_id, c.seq, case when rtf >= 1 then delay + 100 when rtf < 0.5 and n + 1 > 10 and delay > 100 then greatest(100, delay - 100) else delay end,
  case when rtf >= 1 or (rtf < 0.5 and n + 1 > 10 and delay > 100) then 0 else n + 1 end from f join c on c.stream_id = f.stream_id and c.seq = f.seq + 1)
select stream_id, seq, delay, delay >= 400 as failed from f where seq > 0""")
def w6_latency_adapt(spark, d):
    o = table(spark, d, "orders")
    seq = (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")  # the calls of one customer
    calls = late_log(o.select(F.col("o_custkey").alias("stream_id"), seq.alias("seq"), (F.col("o_totalprice") / (F.col("o_custkey") * 200 + 250000)).alias("rtf")), "calls")
    out = drained(T.latency_adapt(calls, 100, 100, start=100), "latency")
    return out.withColumns({"seq": F.col("seq") + 1, "failed": F.col("delay") >= 400})


@query(f"select user_id as stream_id, time_bucket(interval '1 day', ts) as start, count(*) as n, {R('sqrt(avg(value / 300 * (value / 300)))')} as rms, {R('max(abs(value / 300))')} as peak, sum((abs(value / 300) > 0.9999)::int)::bigint as clipped from events group by 1, 2")
def w7_level_meter(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), "ts", (F.col("value") / 300).alias("sample"))
    m = T.level_meter(e, "1 day")
    return m.select("stream_id", "start", "n", r("rms").alias("rms"), r("peak").alias("peak"), "clipped")


@query(f"with e as (select *, (select max(ts) from events) as top from events) select user_id as stream_id, time_bucket(interval '1 day', ts) as start, count(*) as n, {R('sqrt(avg(value / 300 * (value / 300)))')} as rms, {R('max(abs(value / 300))')} as peak, sum((abs(value / 300) > 0.9999)::int)::bigint as clipped from e group by 1, 2 having time_bucket(interval '1 day', max(ts)) + interval '1 day' <= any_value(top) - interval '10 minutes'")
def w7_level_meter_stream(spark, d):
    e = event_stream(spark, d).select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 300).alias("sample"))
    return drained(T.level_meter(e, "1 day"), "meter", timers=False).select("stream_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", r("rms").alias("rms"), r("peak").alias("peak"), "clipped")


@query("with sig as (select user_id as clip_id, list((value / 1000)::double order by ts, event_id) as x from events group by user_id) select clip_id, len(x)::bigint as n_samples, 8000 as sr, unnest(range(0, len(x))) as i, unnest(list_transform(x, lambda v: trunc(v * 32767)::int)) as pcm from sig")
def s1_wav_round_trip(spark, d):
    path = new_path(spark, "wavs")
    A.write_wav_clips(signals(spark, d).select(F.concat("clip_id", F.lit(".wav")).alias("file"), F.lit(8000).alias("sr"), F.array("x").alias("samples")), path, "enh")
    w = read_wav_chunks(spark, path, chunk=1024)
    w = w.select(F.regexp_extract("file", "([0-9]+)_enh.wav$", 1).cast("long").alias("clip_id"), "n_samples", "sr", "start", F.posexplode(F.get("samples", F.lit(0))).alias("k", "v"))
    return w.select("clip_id", "n_samples", "sr", (F.col("start") + F.col("k")).alias("i"), F.round(F.col("v").cast("double") * 32767).cast("int").alias("pcm"))


@query("select case source_no % 3 when 0 then 'train' when 1 then 'valid' else 'test' end as split, source || '.h5' as file, (case when source_no % 2 = 0 then 1.0 else source_no / 2.0 end * 2)::double as factor, case when source_no % 4 = 1 then 16000 end as fallback_sr from (select distinct source, regexp_extract(source, '([0-9]+)$', 1)::int as source_no from documents)")
def s4_read_ds_config(spark, d):
    path = new_path(spark, "config") + "/dataset.cfg"
    names = sorted(x.source for x in table(spark, d, "documents").select("source").distinct().collect())  # a list of datasets, as a user writes it
    lists: dict[str, list] = {"train": [], "valid": [], "test": []}
    for n in names:
        k = int(n[3:])
        lists[("train", "valid", "test")[k % 3]].append([n + ".h5", *([k / 2] if k % 2 else []), *([16000] if k % 4 == 1 else [])])
    with open_write(path) as f:
        f.write(json.dumps(lists).encode())
    return A.read_ds_config(spark, path, 2.0).select("split", "file", "factor", "fallback_sr")


@query(f"with {SCORES}, w as (select filename::varchar as filename, " + ", ".join(f"max(value) filter (where metric = '{m}') as {m}" for m in METRICS) + " from sc where variant = 'noisy' group by filename) select filename, " + ", ".join(f"{R(m)} as {m}" for m in METRICS) + " from w union all select filename, " + ", ".join(f"{R(m)} as {m}" for m in METRICS) + " from w")
def s7_read_scores(spark, d):
    a, b = new_path(spark, "scores"), new_path(spark, "scores")
    s = scores(spark, d).where("variant = 'noisy'")
    for p in (a, b):
        A.write_scores_csv(s, p, METRICS)
    return A.read_scores(spark, [a, b], METRICS).select("filename", *[r(m).alias(m) for m in METRICS])


@query("select conv_id || '-' || turn as filename, replace(replace(text, chr(10), ' '), chr(9), ' ') as text from conversations where text is not null and length(trim(text)) > 0")
def s8_read_transcripts(spark, d):
    path = new_path(spark, "transcripts")
    t = table(spark, d, "conversations").where("text is not null and length(trim(text)) > 0")
    line = F.concat(F.concat_ws("-", "conv_id", "turn"), F.lit("\t"), F.translate("text", "\n\t", "  "))
    t.select(line.alias("value")).write.text(path)
    return A.read_transcripts(spark, path)


@query(f"with {PAIRS}, c as (select clip_id, clean, noisy from pairs order by ('0x' || substr(md5('3:' || clip_id || ':export'), 1, 12))::bigint, clip_id limit 20) select clip_id || '_speech.wav' as file, unnest(range(0, len(clean))) as i, unnest(list_transform(clean, lambda v: {R('v')})) as x from c union all select clip_id || '_noisy.wav', unnest(range(0, len(noisy))), unnest(list_transform(noisy, lambda v: {R('v')})) from c")
def s9_export_mixtures(spark, d):
    p = pairs(spark, d).select(F.col("clip_id").alias("idx"), F.col("clean").alias("speech"), "noisy")
    return A.export_mixtures(p, 20, seed=3).select("file", F.posexplode("x").alias("i", "x")).select("file", F.col("i").cast("long").alias("i"), r("x").alias("x"))

