"""Queries over score, transcript, run and control tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom.operators import scoring as G

from .adapters import METRICS, RUNS, SCORES, R, query, r, runs, scores, table


@query(f"with {SCORES} select filename, " + ", ".join(R(f"max(value) filter (where metric = '{m}')") + f" as {m}" for m in METRICS) + " from sc where variant = 'noisy' group by filename")
def s6_wide_scores(spark, d):
    w = G.wide_scores(scores(spark, d).where("variant = 'noisy'"), METRICS)
    return w.select("filename", *[r(m).alias(m) for m in METRICS])


@query(f"with {SCORES}, t as (select filename, metric, avg(value) as target from sc group by 1, 2) select sc.filename, variant, sc.metric, abs(value - target) <= 1e-4::double + 1e-4::double * abs(target) as ok from sc join t on t.filename = sc.filename and t.metric = sc.metric")
def j8_check_targets(spark, d):
    s = scores(spark, d)
    return G.check_targets(s, s.groupBy("filename", "metric").agg(F.avg("value").alias("target"))).select("filename", "variant", "metric", "ok")


@query(f"with {SCORES} select a.filename, a.metric, {R('a.value')} as noisy, {R('b.value')} as enhanced, {R('b.value - a.value')} as gain from sc a join sc b on a.filename = b.filename and a.metric = b.metric and a.variant = 'noisy' and b.variant = 'enhanced'")
def j9_compare_variants(spark, d):
    return G.compare_variants(scores(spark, d)).select("filename", "metric", r("noisy").alias("noisy"), r("enhanced").alias("enhanced"), r("gain").alias("gain"))


@query(f"with {SCORES} select variant, metric, {R('avg(value)')} as mean, count(*) as n from sc group by 1, 2")
def a6_metric_means(spark, d):
    return G.metric_means(scores(spark, d)).select("variant", "metric", r("mean").alias("mean"), "n")


@query(f"with {SCORES} select metric, coalesce(snr, -1) as snr, {R('avg(value)')} as mean from sc group by grouping sets ((metric, snr), (metric))")
def a7_metric_by_snr(spark, d):
    return G.metric_by_snr(scores(spark, d)).select("metric", F.coalesce("snr", F.lit(-1)).alias("snr"), r("mean").alias("mean"))


@query(f"with {SCORES} select metric, count(value) as n, {R('avg(value)')} as mean, {R('stddev_samp(value)')} as std, {R('min(value)')} as low, {R('quantile_cont(value, 0.25)')} as q1, {R('quantile_cont(value, 0.5)')} as q2, {R('quantile_cont(value, 0.75)')} as q3, {R('max(value)')} as high from sc group by metric")
def a8_describe_scores(spark, d):
    x = G.describe_scores(scores(spark, d))
    return x.select("metric", "n", *[r(c).alias(c) for c in ("mean", "std", "low", "q1", "q2", "q3", "high")])


def _word_pairs(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return a.join(b, ["conv_id", "turn"])


@query()  # SQL has no edit distance of words; tested against a plain loop
def x8_word_edits(spark, d):
    p = _word_pairs(spark, d)
    return p.select("conv_id", "turn", F.size(G.normalized_words("reference")).alias("words"), G.word_edits("reference", "hypothesis").alias("edits"))


@query()
def a9_word_error_rate(spark, d):
    p = _word_pairs(spark, d).select("turn", F.size(G.normalized_words("reference")).alias("words"), G.word_edits("reference", "hypothesis").alias("edits"))
    return G.wer(p, ["turn"]).select("turn", r("wer").alias("wer"), r("accuracy").alias("accuracy"), "n")


_SEG = "sg as (select user_id as clip_id, 1 + least(value / 100, 4::double) as sig_raw, 1.5::double + least(value / 200, 3::double) as bak_raw, 1.2::double + least(value / 150, 3.5::double) as ovr_raw from events)"


def _segments(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(F.col("user_id").alias("clip_id"), (1 + F.least(v / 100, F.lit(4.0))).alias("sig_raw"), (1.5 + F.least(v / 200, F.lit(3.0))).alias("bak_raw"), (1.2 + F.least(v / 150, F.lit(3.5))).alias("ovr_raw"))


def _poly(kind: str, x: str) -> str:
    out = "0::double"
    for c in G.MOS_MAPS[kind]:
        out = f"({out} * {x} + ({c})::double)"
    return out


@query(f"with {_SEG} select clip_id, " + ", ".join(f"{R(f'avg({k}_raw)')} as {k}_raw, {R(f'avg({_poly(k, k + chr(95) + 'raw')})')} as {k}" for k in ("sig", "bak", "ovr")) + ", count(*) as num_hops from sg group by clip_id")
def a10_aggregate_segments(spark, d):
    a = G.aggregate_segments(_segments(spark, d))
    return a.select("clip_id", *[r(c).alias(c) for k in ("sig", "bak", "ovr") for c in (k + "_raw", k)], "num_hops")


@query(f"with {_SEG} select " + ", ".join(f"{R(f'min({_poly(k, k[:3] + chr(95) + 'raw')})')} as low_{k}, {R(f'avg({_poly(k, k[:3] + chr(95) + 'raw')})')} as mean_{k}" for k in G.MOS_MAPS) + ", clip_id from sg group by clip_id")
def x9_mos_polynomial(spark, d):
    s = _segments(spark, d)
    cols = [x for k in G.MOS_MAPS for x in (r(F.min(G.mos_polynomial(k[:3] + "_raw", k))).alias("low_" + k), r(F.avg(G.mos_polynomial(k[:3] + "_raw", k))).alias("mean_" + k))]
    return s.groupBy("clip_id").agg(*cols)


_LIM = lambda e: f"least(greatest({e}, 1::double), 5::double)"


@query("with q as (select l_orderkey, l_linenumber, 1 + l_quantity / 14 as pesq, l_discount * 20 as llr, l_tax * 500 as wss, l_extendedprice / 4000 - 5 as ssnr from lineitem) "
       f"select l_orderkey, count(*) as n, {R('sum(' + _LIM('3.093::double - 1.029::double * llr + 0.603::double * pesq - 0.009::double * wss') + ')')} as csig, {R('sum(' + _LIM('1.634::double + 0.478::double * pesq - 0.007::double * wss + 0.063::double * ssnr') + ')')} as cbak, "
       f"{R('sum(' + _LIM('1.594::double + 0.805::double * pesq - 0.512::double * llr - 0.007::double * wss') + ')')} as covl from q group by l_orderkey")
def x10_composite(spark, d):
    c = F.col
    parts = G.composite(1 + c("l_quantity") / 14, c("l_discount") * 20, c("l_tax") * 500, c("l_extendedprice") / 4000 - 5)
    q = table(spark, d, "lineitem").select("l_orderkey", *[v.alias(k) for k, v in parts.items()])
    return q.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), *[r(F.sum(k)).alias(k) for k in parts])


@query(f"with t as (select o_orderpriority as run, o_totalprice / (o_custkey * 100 + 50000) as rtf from orders) select run, {R('avg(rtf)')} as mean_rtf, {R('max(rtf)')} as max_rtf, sum((rtf >= 1)::int)::bigint as underruns from t group by run")
def a11_rtf_stats(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_totalprice").alias("processing"), (F.col("o_custkey") * 100 + 50000).alias("audio"))
    x = G.rtf_stats(t, ["run"])
    return x.select("run", r("mean_rtf").alias("mean_rtf"), r("max_rtf").alias("max_rtf"), "underruns")


@query(f"with {RUNS}, a as (select run, epoch, avg(value) over (partition by run order by epoch rows between 99 preceding and current row) as v from runs) select run, epoch, {R('v', 4)} as recent from a where epoch % 10 = 0")
def a12_recent_loss(spark, d):
    return G.recent_loss(runs(spark, d)).select("run", "epoch", r("recent", 4).alias("recent"))


_N12 = "nb as (select *, min(value) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before from runs), bs as (select run, epoch, value, before is null or value < before as is_best, least(value, before) as best from nb)"


@query(f"with {RUNS}, {_N12} select run, epoch, is_best, {R('best')} as best from bs")
def n12_running_best(spark, d):
    return G.running_best(runs(spark, d)).select("run", "epoch", "is_best", r("best").alias("best"))


@query(f"with {RUNS}, {_N12}, w as (select run, epoch, epoch - max(case when is_best then epoch end) over (partition by run order by epoch rows unbounded preceding) as waited from bs) select run, min(epoch) filter (where waited >= 40) as stop_epoch from w group by run")
def n13_early_stop(spark, d):
    return G.early_stop(runs(spark, d), 40)


@query(f"with {RUNS} select run, epoch, row_number() over (partition by run order by epoch desc) <= 3 as kept from runs")
def n14_retention(spark, d):
    return G.retention(runs(spark, d)).select("run", "epoch", "kept")


@query(f"with {RUNS} select run, epoch, least(case when epoch >= 1000 then 64 when epoch >= 200 then 32 when epoch >= 20 then 8 else 48 end, 48)::int as batch_size from runs")
def n15_schedule(spark, d):
    return G.schedule_asof(runs(spark, d).select("run", "epoch"), [(20, 8), (200, 32), (1000, 64)], 48)


@query(f"with {SCORES} select filename, variant, metric, {R('value')} as value from sc order by sc.value, filename, variant, metric limit 50")
def t6_worst_files(spark, d):
    return G.worst_files(scores(spark, d), 50).select("filename", "variant", "metric", r("value").alias("value"))


@query("with s as (select o_orderstatus as split, (o_custkey % 6)::int as snr, o_orderkey as step, row_number() over (partition by o_orderstatus, o_custkey % 6 order by o_orderkey desc) as n from orders) select split, snr, step from s where n = 1")
def t7_example_per_snr(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 6).cast("int").alias("snr"), F.col("o_orderkey").alias("step"))
    return G.example_per_snr(s)


@query("with l as (select event_id, value / 5 - 15 as lsnr from events) select event_id, case when lsnr < -10 then 'zero' when lsnr > 30 then 'pass' when lsnr > 20 then 'mask' else 'filter' end as stage from l")
def f7_stage_decision(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 5 - 15).alias("lsnr"))
    return e.select("event_id", G.stage_decision("lsnr").alias("stage"))


@query(f"with a as (select user_id, event_id, ts, event_type, last_value(case when event_type = 'signup' then value end ignore nulls) over (partition by user_id order by ts, case when event_type = 'signup' then 0 else 1 end rows unbounded preceding) as v from events) select event_id, {R('v')} as setting from a where event_type <> 'signup'")
def j7_asof_controls(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "stream_id")
    f = e.where("event_type <> 'signup'").select("stream_id", "ts", "event_id")
    return G.asof_controls(f, e.where("event_type = 'signup'").select("stream_id", "ts", "value")).select("event_id", r("setting").alias("setting"))
