"""Queries over clips: statistics, framing, mixing and time-domain quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveloom.functions import signal as S

from waveloom.operators import chunks

from .adapters import PAIRS, SIG, R, bits_sql, dt, en, pairs, query, r, signal_chunks, signals, sm


@query(f"with {SIG} select clip_id, len(x)::int as n, {R(f'sqrt({en("x")} / len(x))')} as rms, {R(f'{sm("x")} / len(x)')} as mean, {R('list_max(x)')} as top, {R('list_min(x)')} as low, "
       f"{R('list_max(list_transform(x, lambda v: abs(v)))')} as max_abs, {R('list_min(list_transform(x, lambda v: abs(v)))')} as min_abs, (list_position(x, list_max(x)) - 1)::bigint as argmax, (list_position(x, list_max(x)) - 1)::bigint as argmax_abs from sig")
def a3_signal_stats(spark, d):
    s = signals(spark, d)
    return s.select("clip_id", F.size("x").alias("n"), r(S.rms("x")).alias("rms"), r(S.mean("x")).alias("mean"), r(F.array_max("x")).alias("top"), r(F.array_min("x")).alias("low"), r(S.max_abs("x")).alias("max_abs"),
                    r(F.array_min(F.transform("x", F.abs))).alias("min_abs"), S.argmax("x").cast("long").alias("argmax"), S.argmax_abs("x").cast("long").alias("argmax_abs"))


@query(f"with {SIG} select clip_id, {R('list_sort(x)[len(x) // 2 + 1]')} as median from sig")
def a4_median_upper(spark, d):
    return signals(spark, d).select("clip_id", r(S.median_upper("x")).alias("median"))


@query(f"with {SIG}, p as (select clip_id, unnest(range(0, len(x))) as i, x from sig), q as (select clip_id, i, least(greatest(x[i + 1] * 32767, -32768), 32767) as y from p) "
       f"select clip_id, i, trunc(y)::int as pcm, {R('trunc(y) / 32767')} as back, {R('trunc(y) / 32768')} as back_tools from q")
def f1_pcm_scale(spark, d):
    s = signals(spark, d).select("clip_id", S.float_to_pcm("x").alias("p"))
    s = s.select("clip_id", F.posexplode(F.arrays_zip("p", S.pcm_to_float("p").alias("a"), S.pcm_to_float("p", 32768).alias("b"))).alias("i", "z"))
    return s.select("clip_id", F.col("i").cast("long").alias("i"), F.col("z.p").alias("pcm"), r("z.a").alias("back"), r("z.b").alias("back_tools"))


@query(f"with {PAIRS} select clip_id, {R(sm('clean'))} as first, {R(sm('noise'))} as second, {R(f'case when {bits_sql(3, "clip_id", "channel")} % 2 = 0 then {sm("clean")} else {sm("noise")} end')} as drawn, "
       f"{R(sm('list_transform(list_zip(clean, noise), lambda z: (z[1] + z[2]) / 2)'))} as mono from pairs")
def f2_channels(spark, d):
    p = pairs(spark, d).withColumn("x", F.array("clean", "noise"))
    return p.select("clip_id", r(S.total(S.channel("x", 0))).alias("first"), r(S.total(S.channel("x", 1))).alias("second"), r(S.total(S.random_channel("x", 3, F.col("clip_id")))).alias("drawn"), r(S.total(S.mono_mix("x"))).alias("mono"))


@query(f"with {SIG}, c as (select *, case when len(x) > 50 then {bits_sql(3, 'clip_id', 'crop')} % (len(x) - 50) else 0 end as s from sig) "
       f"select clip_id, {R(sm('x[11:30]'))} as part, {R(sm('x[s + 1:s + 50]'))} as crop, least(len(x), 50)::int as n_crop, (20 * 16000 // 48000)::int as n_scaled from c")
def f3_range_read(spark, d):
    s = signals(spark, d)
    crop = S.random_crop("x", 50, 3, F.col("clip_id"))
    return s.select("clip_id", r(S.total(S.slice_range("x", 10, 30))).alias("part"), r(S.total(crop)).alias("crop"), F.size(crop).alias("n_crop"), F.floor(F.lit(20) * 16000 / 48000).cast("int").alias("n_scaled"))


@query(f"with {SIG} select clip_id, len(x) >= 60 and list_max(list_transform(x, lambda v: abs(v))) >= 1e-10 as noise_ok, sqrt({en('x')} / len(x)) >= 0.06 as speech_ok from sig")
def f5_usable_clips(spark, d):
    from waveloom.operators.curation import usable_noise, usable_speech

    s = signals(spark, d)
    return s.select("clip_id", usable_noise("x", least=60).alias("noise_ok"), usable_speech("x", least_rms=0.06).alias("speech_ok"))


@query(f"with {SIG} select clip_id, list_max(list_transform(x, lambda v: case when v > 0.3 then 1 else 0 end)) = 0 as finite from sig")
def f8_finite(spark, d):
    s = signals(spark, d).withColumn("x", F.transform("x", lambda v: F.when(v > 0.3, F.lit(float("nan"))).otherwise(v)))
    return s.select("clip_id", S.is_finite("x").alias("finite"))


@query(f"with {SIG}, f as (select clip_id, x, unnest(range(0, (len(x) - 16 + 8) // 8)) as t from sig) select clip_id, t, {R(sm('x[t * 8 + 1:t * 8 + 16]'))} as total, 16 as n from f")
def n1_frames(spark, d):
    f = chunks.frame_signal(signal_chunks(spark, d, 4096), 16, 8, 4096)
    return f.select("clip_id", F.col("t").cast("long").alias("t"), r(S.total("w")).alias("total"), F.size("w").alias("n"))


_N9 = f"""{SIG}, z as (select clip_id, list_concat(list_transform(range(0, 5), lambda i: 0::double), list_concat(x, list_transform(range(0, 5), lambda i: 0::double))) as y, list_max(x) as top, len(x) as n0 from sig),
w as (select clip_id, y, top, n0, unnest(range(0, (len(y) - 10 + 5) // 5)) as t from z),
e as (select clip_id, n0, t, 20 * {sm('list_transform(y[t * 5 + 1:t * 5 + 10], lambda v: log10(pow(v / top, 2) + 1e-10::double))')} / 10 as e from w)"""


@query(f"with {_N9} select clip_id, t, {R('e', 5)} as energy from e")
def n9_windowed_energy(spark, d):
    s = signals(spark, d).select("clip_id", F.posexplode(S.windowed_energy(F.array("x"), 100)).alias("t", "e"))
    return s.select("clip_id", F.col("t").cast("long").alias("t"), r("e", 5).alias("energy"))


# thresholds of the fixture lie inside the range of the fixture's energies
@query(f"""with {_N9}, b as (select clip_id, any_value(n0) as n, min(t) filter (where e > -20 and t > 3) as first, max(t) as last, max(t) filter (where e > -20 and (select 1) = 1) as dummy from e group by clip_id),
k as (select e.clip_id, e.t, e.e, (select max(t) from e e2 where e2.clip_id = e.clip_id) - e.t as back from e),
g as (select b.clip_id, n, coalesce((first - 4) * 5, 0) as start, coalesce((select -(min(back) - 2) * 5 from k where k.clip_id = b.clip_id and k.e > -20 and k.back > 3), 0) as stop from b)
select clip_id, n::bigint as n_before, (case when stop < -10 then greatest(0, n + stop - greatest(start, 0)) else n end)::bigint as n_after from g where greatest(start, 0) - stop < n""")
def n10_trim_silence(spark, d):
    from waveloom.operators.curation import trim_silence

    s = signals(spark, d).select("clip_id", F.array("x").alias("samples"))
    out = trim_silence(s, 100, start_db=-20, stop_db=-20, start_skip=3, stop_skip=3, start_back=4, stop_back=2)
    return out.select("clip_id", F.col("n_before").cast("long").alias("n_before"), F.size(F.get("samples", F.lit(0))).cast("long").alias("n_after"))


_N11 = """, l as (select clip_id, list_transform(range(0, (len(x) * pow(2, greatest(ceil(log2(90::double / len(x))), 0)))::int), lambda i: x[(i % len(x)) + 1]) as y from sig),
h as (select clip_id, y, trunc(floor(len(y) / 10) - 9.01::double)::int + 1 as hops from l), s as (select clip_id, y, unnest(range(0, hops)) as seg from h)"""


@query(f"with {SIG}{_N11} select clip_id, seg, {R(sm('y[seg * 10 + 1:seg * 10 + 90]'))} as total from s where len(y) >= seg * 10 + 90")
def n11_segments(spark, d):
    s = signals(spark, d).select("clip_id", F.posexplode(S.segments("x", 10)).alias("seg", "w"))
    return s.select("clip_id", F.col("seg").cast("long").alias("seg"), r(S.total("w")).alias("total"))


@query(f"with {SIG} select clip_id, {R('pow(10::double, list_max(x) / 20)')} as gain, {R(f'10 * log10({en("x")} + 1e-10::double)')} as power_db, {R('20 * log10(list_max(x) + 1e-10::double)')} as amp_db from sig")
def x1_decibels(spark, d):
    return signals(spark, d).select("clip_id", r(S.db_to_gain(F.array_max("x"))).alias("gain"), r(S.power_db(S.energy("x"))).alias("power_db"), r(S.amp_db(F.array_max("x"))).alias("amp_db"))


@query(f"""with {SIG}, k as (select clip_id, x, ceil(100::double / len(x))::int * len(x) - 100 as room from sig), q as (select *, case when room > 0 then {bits_sql(5, 'clip_id', 'fit')} % greatest(room, 1) else 0 end as s from k)
select clip_id, 'fitted' as kind, unnest(range(0, 100)) as i, unnest(list_transform(range(s, s + 100), lambda i: {R('x[(i % len(x)) + 1]')})) as x from q
union all select clip_id, 'padded', unnest(range(0, greatest(120, len(x)))), unnest(list_transform(range(0, greatest(120, len(x))), lambda i: {R('coalesce(x[i + 1], 0)')})) from q
union all select clip_id, 'undelayed', unnest(range(0, len(x[9:28]))), unnest(list_transform(x[9:28], lambda v: {R('v')})) from q""")
def x12_length_fit(spark, d):
    kinds = {"fitted": S.fit_length("x", 100, 5, F.col("clip_id")), "padded": S.pad_to("x", 120), "undelayed": S.undelay("x", 16, 8, 20)}
    each = signals(spark, d).select("clip_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("x")) for k, c in kinds.items()])).alias("z"))
    return each.select("clip_id", "z.kind", F.posexplode("z.x").alias("i", "x")).select("clip_id", "kind", F.col("i").cast("long").alias("i"), r("x").alias("x"))


@query(f"with {SIG}, k as (select clip_id, x, sqrt({en('x')} / len(x)) + 1e-8::double as k from sig) select clip_id, {R(sm('list_transform(x, lambda v: v / k)'))} as total, {R('list_max(x) / k')} as top from k")
def x14_rms_normalize(spark, d):
    return signals(spark, d).withColumn("y", S.rms_normalize("x")).select("clip_id", r(S.total("y")).alias("total"), r(F.array_max("y")).alias("top"))


_SISDR = lambda c, e: f"10 * log10((a * a * {en(c)} + 2.220446049250313e-16::double) / ({sm(f'list_transform(list_zip({c}, {e}), lambda z: (z[2] - a * z[1]) * (z[2] - a * z[1]))')} + 2.220446049250313e-16::double))"
_A = lambda c, e: f"({dt(c, e)} + 2.220446049250313e-16::double) / ({en(c)} + 2.220446049250313e-16::double)"


@query(f"with {PAIRS}, n as (select *, {_A('clean', 'noisy')} as a from pairs), m as (select clip_id, clean, enhanced, {_SISDR('clean', 'noisy')} as noisy_sdr, {_A('clean', 'enhanced')} as a from n) "
       f"select clip_id, {R('noisy_sdr', 5)} as noisy_sdr, {R(_SISDR('clean', 'enhanced'), 5)} as enhanced_sdr from m")
def q1_si_sdr(spark, d):
    return pairs(spark, d).select("clip_id", r(S.si_sdr("clean", "noisy"), 5).alias("noisy_sdr"), r(S.si_sdr("clean", "enhanced"), 5).alias("enhanced_sdr"))


@query(f"""with {PAIRS}, w as (select clip_id, ws, unnest(range(0, (len(clean) - ws) // ws + 1)) as t, clean, noisy from pairs, (select unnest([10, 20]) as ws)),
s as (select clip_id, ws, t, clean[t * ws + 1:t * ws + ws] as c, noisy[t * ws + 1:t * ws + ws] as e from w), k as (select *, {_A('c', 'e')} as a from s),
v as (select clip_id, ws, avg({_SISDR('c', 'e')}) as m from k group by clip_id, ws) select clip_id, {R('sum(m)', 5)} as segmental from v group by clip_id""")
def q2_segmental_si_sdr(spark, d):
    from waveloom.operators.metrics import segmental_si_sdr

    return pairs(spark, d).select("clip_id", r(segmental_si_sdr("clean", "noisy", [10, 20]), 5).alias("segmental"))


_HANN = "0.5::double * (1 - cos(2 * pi() * (i + 1) / 21))"


@query(f"""with {PAIRS}, w as (select clip_id, clean, noisy, unnest(range(0, floor(len(clean) / 5 - 20 / 5)::int)) as t from pairs),
f as (select clip_id, t, list_transform(range(0, 20), lambda i: clean[t * 5 + i + 1] * {_HANN}) as c, list_transform(range(0, 20), lambda i: noisy[t * 5 + i + 1] * {_HANN}) as e from w),
g as (select clip_id, least(greatest(10 * log10({en('c')} / ({en('list_transform(list_zip(c, e), lambda z: z[1] - z[2])')} + 2.220446049250313e-16::double) + 2.220446049250313e-16::double), -10), 35) as v from f)
select clip_id, {R('avg(v)', 5)} as ssnr from g group by clip_id""")
def q3_segmental_snr(spark, d):
    return pairs(spark, d).select("clip_id", r(S.segment_snr("clean", "noisy", 20, frame_ms=1000), 5).alias("ssnr"))


@query(f"with {PAIRS}, c as (select clip_id, clean, 0.5::double * list_max(list_transform(clean, lambda v: abs(v))) as edge from pairs), k as (select clip_id, clean, list_transform(clean, lambda v: least(greatest(v, -edge), edge)) as y from c) "
       f"select clip_id, {R(f'20 * log10({en("clean")} / ({en("list_transform(list_zip(clean, y), lambda z: z[1] - z[2])")} + 1e-10::double) + 1e-10::double)', 5)} as sdr, {R('list_max(y)')} as top from k")
def m8_clipping(spark, d):
    p = pairs(spark, d).withColumn("y", S.clip_samples("clean", 0.5))
    return p.select("clip_id", r(S.clip_sdr("clean", "y"), 5).alias("sdr"), r(F.array_max("y")).alias("top"))


@query(f"with {PAIRS}, k as (select clip_id, clean, noise, ({sm('clean')} + {sm('noise')}) / (2 * len(clean)) as m from pairs) select clip_id, {R(f'{sm("clean")} - len(clean) * m')} as first, {R(f'{sm("noise")} - len(clean) * m')} as second from k")
def m5_remove_dc(spark, d):
    p = pairs(spark, d).withColumn("y", S.remove_dc(F.array("clean", "noise")))
    return p.select("clip_id", r(S.total(F.get("y", F.lit(0)))).alias("first"), r(S.total(F.get("y", F.lit(1)))).alias("second"))


@query(f"with {PAIRS}, n as (select *, {_A('clean', 'noisy')} as a from pairs), m as (select snr, clean, enhanced, {_SISDR('clean', 'noisy')} as noisy_sdr, {_A('clean', 'enhanced')} as a from n), "
       f"v as (select snr, noisy_sdr, {_SISDR('clean', 'enhanced')} as enhanced_sdr from m) select snr, count(*) as n, {R('avg(noisy_sdr)', 4)} as noisy_sdr, {R('avg(enhanced_sdr)', 4)} as enhanced_sdr, {R('avg(enhanced_sdr - noisy_sdr)', 4)} as gain from v group by snr")
def sdr_by_snr(spark, d):
    """Mixtures at drawn ratios, their SI-SDR before and after enhancement, and the means per asked ratio."""
    p = pairs(spark, d).select("snr", S.si_sdr("clean", "noisy").alias("a"), S.si_sdr("clean", "enhanced").alias("b"))
    return p.groupBy("snr").agg(F.count(F.lit(1)).alias("n"), r(F.avg("a"), 4).alias("noisy_sdr"), r(F.avg("b"), 4).alias("enhanced_sdr"), r(F.avg(F.col("b") - F.col("a")), 4).alias("gain"))
