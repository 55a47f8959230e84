"""Queries that build training pairs, and helper-backed quality over pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveloom._np import audio
from waveloom.functions import signal as S
from waveloom.operators import quality as Q
from waveloom.operators import spectral as P
from waveloom.operators import synthesis as M

from .adapters import NUMBERED, PAIRS, SIG, R, bits_sql, en, frames, numbered, pairs, query, r, signals, sm

_SEED = 21


def _pick(values: list, idx: str, slot: str) -> str:
    return f"([{', '.join(map(str, values))}])[({bits_sql(_SEED, idx, slot)} % {len(values)}) + 1]"


@query(f"""with {SIG}, p as (select clip_id as idx, 2 + {bits_sql(_SEED, 'clip_id', 'n_noises')} % 4 as n from sig)
select idx, {_pick(M.SNRS, 'idx', 'snr')}::int as snr, {_pick(M.GAINS, 'idx', 'gain')}::int as gain, n::int as n_noises, {_pick(M.INTERFERER_SNRS, 'idx', 'interferer')}::int as interferer_snr, true as has_speech,
list_sum(list_transform(range(0, n), lambda i: ([-6, 0, 6])[(('0x' || substr(md5('{_SEED}:' || idx || ':noise_gain' || i), 1, 12))::bigint % 3) + 1]))::int as gains from p""")
def m1_sample_plan(spark, d):
    p = M.sample_plan(signals(spark, d).select(F.col("clip_id").alias("idx")), _SEED)
    return p.select("idx", "snr", "gain", "n_noises", "interferer_snr", "has_speech", F.aggregate("noise_gains", F.lit(0), lambda a, v: a + v).alias("gains"))


_PARTS = f"""{NUMBERED}, pt as (select a.clip_id as idx, s as slot, b.x from un a cross join (select unnest(range(0, 4)) as s) join un b on b.u = (a.u + s * 11) % a.n)"""


def _parts(spark, d):
    s, n = numbered(spark, d)
    other = s.select(F.col("u").alias("o"), "x")
    return s.select(F.col("clip_id").alias("idx"), "u", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot")).withColumn("o", (F.col("u") + F.col("slot") * 11) % n).join(other, "o").drop("o", "u")


@query(f"""with {_PARTS}, b as (select *, coalesce(sum(len(x)) over (partition by idx order by slot rows between unbounded preceding and 1 preceding), 0) as before from pt),
j as (select idx, flatten(list(x order by slot)) as x from b where before < 150 group by idx), c as (select idx, x, case when len(x) > 150 then {bits_sql(_SEED, 'idx', 'crop')} % (len(x) - 150) else 0 end as s from j)
select idx, i::int as i, {R('x[s + i + 1]')} as v from (select *, unnest(range(0, least(len(x), 150))) as i from c)""")
def m2_assemble_speech(spark, d):
    return M.assemble_speech(_parts(spark, d), 150, _SEED).select("idx", F.posexplode("speech").alias("i", "v")).withColumn("v", r("v"))


_NOISE = f"""nz as (select idx, slot, x, ceil(100::double / len(x))::int * len(x) - 100 as room, pow(10::double, (slot * 3 - 3) / 20.0::double) as g from pt where slot < 3),
nf as (select *, case when room > 0 then ('0x' || substr(md5('{_SEED}:' || idx || '-' || slot || ':fit'), 1, 12))::bigint % greatest(room, 1) else 0 end as s from nz),
nl as (select idx, i, sum(x[((s + i) % len(x)) + 1] * g) as v from nf, (select unnest(range(0, 100)) as i) group by 1, 2)"""


@query(f"with {_PARTS}, {_NOISE} select idx, i::int as i, {R('v / 2')} as v from nl")
def m3_combine_noises(spark, d):
    n = _parts(spark, d).where("slot < 3").withColumn("gain", (F.col("slot") * 3 - 3).cast("double"))
    return M.combine_noises(n, 100, _SEED, channels=2).select("idx", F.posexplode("noise").alias("i", "v")).withColumn("v", r("v"))


_MIX = f"""mx as (select clip_id, snr, list_transform(clean, lambda v: v * pow(10::double, (gain + 12) / 20.0::double)) as c, noise from pairs),
mk as (select *, 1 / sqrt(({en('noise')} + 1e-10::double) / ({en('c')} + 1e-10::double) * pow(10::double, snr / 10.0::double) + 1e-10::double) as k from mx),
mm as (select clip_id, snr, c, list_transform(noise, lambda v: v * k) as n, list_transform(list_zip(c, noise), lambda z: z[1] + k * z[2]) as m from mk),
mt as (select *, greatest(list_max(list_transform(c, lambda v: abs(v))), list_max(list_transform(n, lambda v: abs(v))), list_max(list_transform(m, lambda v: abs(v)))) as top from mm),
mf as (select *, case when top - 1 > 1e-10 then 1 / (top + 1e-10::double) else 1 end as f from mt)"""


def _mixed(spark, d):
    p = pairs(spark, d).select("clip_id", F.col("clean").alias("speech"), "noise", "snr", (F.col("gain") + 12).alias("gain"))
    return M.mix_at_snr(p)


@query(f"with {PAIRS}, {_MIX} select clip_id, unnest(range(0, len(c))) as i, unnest(list_transform(c, lambda v: {R('v * f')})) as clean, unnest(list_transform(n, lambda v: {R('v * f')})) as noise, unnest(list_transform(m, lambda v: {R('v * f')})) as noisy from mf")
def m4_mix_at_snr(spark, d):
    m = _mixed(spark, d).select("clip_id", F.posexplode(F.arrays_zip("speech", "noise", "noisy")).alias("i", "z"))
    return m.select("clip_id", F.col("i").cast("long").alias("i"), r("z.speech").alias("clean"), r("z.noise").alias("noise"), r("z.noisy").alias("noisy"))


@query(f"""with {PAIRS}, {_MIX} select snr, count(*) as n, {R(f'avg(10 * log10({en("c")} / {en("n")}))', 4)} as mean from mf group by snr""")
def snr_by_asked_snr(spark, d):
    m = _mixed(spark, d).select("snr", (10 * F.log10(S.energy("speech") / S.energy("noise"))).alias("measured"))
    return m.groupBy("snr").agg(F.count(F.lit(1)).alias("n"), r(F.avg("measured"), 4).alias("mean"))


def _slot(name: str, i: str = "i") -> str:
    return f"('0x' || substr(md5('{_SEED}:' || clip_id || ':{name}' || {i}), 1, 12))::bigint"


@query(f"""with recursive {SIG}, sh as (select clip_id, x, 0.01::double + {bits_sql(_SEED, 'clip_id', 'share')} / 281474976710656.0::double * (0.3::double - 0.01::double) as share from sig),
zr(clip_id, i, done, a, n) as (select clip_id, 0, 0::double, 0::bigint, 0::bigint from sh union all
  select z.clip_id, z.i + 1, z.done + (({_slot('n', 'z.i').replace('clip_id', 'z.clip_id')}) % 4 + 2) / len(sh.x)::double, ({_slot('at', 'z.i').replace('clip_id', 'z.clip_id')}) % greatest(len(sh.x) - 6, 1), ({_slot('n', 'z.i').replace('clip_id', 'z.clip_id')}) % 4 + 2
  from zr z join sh on sh.clip_id = z.clip_id where z.done < sh.share)
select sh.clip_id, count(*) filter (where hit)::bigint as zeros, {R('sum(case when hit then 0 else v end)')} as total from (
  select sh.clip_id, sh.x[j + 1] as v, exists (select 1 from zr where zr.clip_id = sh.clip_id and zr.i > 0 and j >= zr.a and j < zr.a + zr.n) as hit from (select *, unnest(range(0, len(x))) as j from sh) sh) sh group by sh.clip_id""")
def m9_zero_runs(spark, d):
    # zeros are the samples that runs cover; a clip may have others
    z = signals(spark, d).withColumn("at", M.zero_run_positions(F.size("x"), "clip_id", _SEED, max_percent=30.0, low=2, high=6))
    return z.select("clip_id", F.size("at").cast("long").alias("zeros"), r(S.total(M.zeroed_at("x", "at"))).alias("total"))


@query(f"""with {SIG}, s as (select clip_id, x, {bits_sql(_SEED, 'clip_id', 'half')} / 281474976710656.0::double <= 0.5::double as h, {bits_sql(_SEED, 'clip_id', 'clip')} / 281474976710656.0::double <= 0.3::double as c, list_max(list_transform(x, lambda v: abs(v))) as top from sig),
a as (select clip_id, c, case when h then list_transform(x, lambda v: v * 0.5::double) else x end as x, case when h then top * 0.5::double else top end as top from s)
select clip_id, {R(sm('case when c then list_transform(x, lambda v: least(greatest(v, -0.5::double * top), 0.5::double * top)) else x end'))} as total, 'fails' as failed from a""")
def m15_compose(spark, d):
    clips = signals(spark, d).withColumnRenamed("clip_id", "idx")
    steps = [("half", 0.5, lambda x, _: S.scaled(x, 0.5)), ("never", 0.0, lambda x, _: S.scaled(x, 9.0)), ("clip", 0.3, lambda x, _: S.clip_samples(x, 0.5)), ("fails", 1.0, lambda x, _: F.lit(None).cast("array<double>"))]
    return M.compose(clips, steps, _SEED, failed="failed").select(F.col("idx").alias("clip_id"), r(S.total("x")).alias("total"), F.array_join("failed", ",").alias("failed"))


@query(f"""with {PAIRS}, i0 as (select clip_id, clean, list_transform(noise, lambda v: v * 2) as o from pairs),
k as (select *, 1 / sqrt(({en('o')} + 1e-10::double) / ({en('clean')} + 1e-10::double) * 10 + 1e-10::double) as k from i0), m as (select clip_id, list_transform(list_zip(clean, o), lambda z: z[1] + k * z[2]) as y, clean, list_transform(o, lambda v: v * k) as n from k),
t as (select *, greatest(list_max(list_transform(y, lambda v: abs(v))), list_max(list_transform(clean, lambda v: abs(v))), list_max(list_transform(n, lambda v: abs(v)))) as top from m),
f as (select clip_id, y, case when top - 1 > 1e-10 then 1 / (top + 1e-10::double) else 1 end as f from t)
select clip_id, unnest(range(0, len(y))) as i, unnest(list_transform(y, lambda v: {R('v * f')})) as x from f""")
def m14_add_interferers(spark, d):
    p = pairs(spark, d)
    speech = p.select(F.col("clip_id").alias("idx"), F.col("clean").alias("speech"), F.lit(10).alias("interferer_snr"))
    other = p.select(F.col("clip_id").alias("idx"), F.lit(0).alias("slot"), F.col("noise").alias("x"), F.lit(6.0205999132796239).alias("gain"))
    out = M.add_interferers(speech, other, _SEED).select(F.col("idx").alias("clip_id"), F.posexplode("speech").alias("i", "x"))
    return out.select("clip_id", F.col("i").cast("long").alias("i"), r("x").alias("x"))


_B, _A = (c.tolist() for c in audio.biquad_coefficients("low_pass", 1000, 0.7, 0.0, 8000))


@query(f"""with recursive {SIG}, bq(clip_id, i, y, m0, m1) as (select clip_id, 0, 0::double, 0::double, 0::double from sig union all
select b.clip_id, b.i + 1, {_B[0]}::double * x[b.i + 1] + m0, m1 + {_B[1]}::double * x[b.i + 1] - ({_A[1]})::double * ({_B[0]}::double * x[b.i + 1] + m0), {_B[2]}::double * x[b.i + 1] - ({_A[2]})::double * ({_B[0]}::double * x[b.i + 1] + m0)
from bq b join sig on sig.clip_id = b.clip_id where b.i < len(x)) select clip_id, {R('sum(y)')} as total, {R('max(y) filter (where i > 0)')} as top from bq group by clip_id""")
def m6_biquad(spark, d):
    y = M.biquad(signals(spark, d).withColumnRenamed("clip_id", "idx"), "low_pass", 1000, 0.7, 0.0, 8000)
    return y.select(F.col("idx").alias("clip_id"), r(S.total("x")).alias("total"), r(F.array_max("x")).alias("top"))


@query()
def m6_random_filters(spark, d):
    y = M.random_biquad(M.random_lfilt(signals(spark, d).withColumnRenamed("clip_id", "idx"), _SEED), 8000, _SEED)
    return y.select("idx", F.size("x").alias("n"), r(S.rms("x")).alias("rms"))


def _resampled(src: str, out: str) -> str:
    """CTEs that bring src (clip_id, i, v, n samples at rate sr) to the rate nw, as `out` (clip_id, i, v): windowed-sinc sums."""
    return f"""{out}_h as (select *, ceil(16 / cut)::bigint as half from (select distinct clip_id, n, sr, nw, (n * nw + sr - 1) // sr as m, least(1::double, nw / sr::double) * 0.95::double as cut from {src})),
{out}_k as (select *, unnest(range(-half, half + 1)) as j from (select *, unnest(range(0, m)) as o from {out}_h)),
{out}_d as (select *, o * sr // nw as base, j - (o * sr % nw) / nw::double as d from {out}_k),
{out}_w as (select *, cut * case when d = 0 then 1 else sin(pi() * cut * d) / (pi() * cut * d) end * (0.5::double + 0.5::double * cos(pi() * least(greatest(d / (half + 1), -1), 1))) as k from {out}_d),
{out} as (select w.clip_id, o as i, sum(coalesce(s.v, 0) * k) / sum(k) as v from {out}_w w left join {src} s on s.clip_id = w.clip_id and s.i = base + j group by 1, 2)"""


_SAMPLES = "select clip_id, unnest(range(0, len(x))) as i, unnest(x) as v, len(x)::bigint as n, 8000::bigint as sr"


@query(f"with {SIG}, su as ({_SAMPLES}, 12000::bigint as nw from sig), sd as ({_SAMPLES}, 4000::bigint as nw from sig), {_resampled('su', 'up')}, {_resampled('sd', 'down')} "
       f"select clip_id, 'up' as way, i::int as i, {R('v')} as v from up union all select clip_id, 'down', i::int, {R('v')} from down")
def m7_resample(spark, d):
    x = signals(spark, d).withColumnRenamed("clip_id", "idx")
    one = lambda way, rate: M.resample(x, 8000, rate).select(F.col("idx").alias("clip_id"), F.lit(way).alias("way"), F.posexplode("x").alias("i", "v"))
    return one("up", 12000).unionByName(one("down", 4000)).withColumn("v", r("v"))


@query()
def m7_random_speed(spark, d):
    return M.random_speed(signals(spark, d).withColumnRenamed("clip_id", "idx"), 8000, _SEED).select("idx", F.size("x").alias("n"), r(S.rms("x")).alias("rms"))


@query()
def m8_clip_to_sdr(spark, d):
    x = signals(spark, d).withColumnRenamed("clip_id", "idx")
    y = M.clip_to_sdr(x, 30.0).select("idx", F.col("x").alias("y"))
    return x.join(y, "idx").select("idx", r(S.clip_sdr("x", "y"), 3).alias("sdr"))


@query()
def m10_coloured_noise(spark, d):
    return M.coloured_noise(signals(spark, d).select(F.col("clip_id").alias("idx")), 400, 200, _SEED).select("idx", F.size("x").alias("n"), r(S.rms("x")).alias("rms"))


@query()
def m11_reverb(spark, d):
    p = pairs(spark, d).select("clip_id", F.col("clean").alias("x"), F.transform("noise", lambda v, i: v * F.exp(-i / 4.0)).alias("rir"))
    return M.reverb(p, 8000).select("clip_id", r(S.rms("x")).alias("target"), r(S.rms("reverberant")).alias("reverberant"))


@query(f"with {SIG}, f as (select clip_id, x, 5000 + (clip_id % 5) * 4000 as m from sig), b as (select *, list_filter([{', '.join(map(str, M.CUT_OFFS))}], lambda c: c < m) as l from f), "
       f"c as (select *, l[({bits_sql(_SEED, 'clip_id', 'cut')} % len(l)) + 1]::bigint as cut from b), sa as ({_SAMPLES.replace('8000', '48000')}, 2 * cut as nw from c), {_resampled('sa', 'low')}, "
       f"sb as (select l.clip_id, i, v, count(*) over (partition by l.clip_id)::bigint as n, 2 * cut as sr, 48000::bigint as nw from low l join c on c.clip_id = l.clip_id), {_resampled('sb', 'back')} "
       f"select c.clip_id, i.i::int as i, {R('coalesce(k.v, 0)')} as v, cut::int as max_freq from c join sa i on i.clip_id = c.clip_id left join back k on k.clip_id = c.clip_id and k.i = i.i")
def m12_limit_bandwidth(spark, d):
    x = signals(spark, d).select(F.col("clip_id").alias("idx"), "x", (F.lit(5000) + (F.col("clip_id") % 5) * 4000).cast("int").alias("max_freq"))
    return M.limit_bandwidth(x, 48000, _SEED).select(F.col("idx").alias("clip_id"), F.posexplode("x").alias("i", "v"), "max_freq").withColumn("v", r("v"))


def _at_least(x: str, n: int):
    """Repeated to n samples; longer clips stay whole."""
    return S.fit_length(x, F.greatest(F.size(x), F.lit(n)))


def _long_pairs(spark, d):
    """Pairs, shorter ones repeated to half a second at 16 kHz: the signals that `_scored` scores."""
    p = pairs(spark, d)
    return p.select(F.col("clip_id").alias("filename"), *[_at_least(c, 8000).alias(c) for c in ("clean", "noisy", "enhanced")])


def _scored(spark, d, metrics):
    return Q.evaluate(pairs(spark, d).withColumnRenamed("clip_id", "filename"), metrics, 16000, noisy=True, at_least=8000)


@query()
def q11_evaluate(spark, d):
    e = _scored(spark, d, ["si_sdr", "ssnr", "fw_ssnr", "llr", "wss", "stoi"])
    return e.select("filename", "variant", "metric", r("value", 4).alias("value"), "error")


def _one(metric):
    def run(spark, d):
        return _scored(spark, d, [metric]).select("filename", "variant", r("value", 4).alias("value"))

    return run


for _name, _metric in (("q4_fw_segmental_snr", "fw_ssnr"), ("q5_llr", "llr"), ("q6_wss", "wss"), ("q7_stoi", "stoi")):
    _f = _one(_metric)
    _f.__name__ = _name
    query()(_f)


@query()
def e7_multiframe_mvdr(spark, d):
    f = frames(spark, d)

    def corr(df, name):
        c = P.frame_corr(df, 2).groupBy("clip_id", "ch", "t").agg(F.sort_array(F.collect_list(F.struct("i", "j", "r_re", "r_im"))).alias("z"))
        part = lambda k: F.array(*[F.array(*[F.get("z", F.lit(i * 2 + j))[k] for j in range(2)]) for i in range(2)])
        return c.select("clip_id", "ch", "t", part("r_re").alias(name + "_re"), part("r_im").alias(name + "_im"))

    noise = f.withColumns({"re": S.scaled("im", 0.2), "im": S.scaled("re", 0.2)})
    w = Q.multiframe_filter(corr(f, "rss").join(corr(noise, "rnn"), ["clip_id", "ch", "t"]), 2)
    return w.select("clip_id", "t", *[r(S.total(F.flatten(c)), 4).alias(c) for c in ("w_re", "w_im")])


@query()
def e9_log_spectra(spark, d):
    x = pairs(spark, d).select("clip_id", _at_least("clean", 1600).alias("x"))
    one = lambda k: Q.log_spectra(x, k).select("clip_id", "t", F.lit(k).alias("kind"), F.size("v").alias("bands"), r(S.mean("v"), 4).alias("mean"))
    return one("power").unionByName(one("mos")).unionByName(one("asr"))


@query()
def p3_no_reference_scores(spark, d):
    def predict(batches):
        import pandas as pd

        for b in batches:
            level = b.map(lambda w: float((w**2).mean()) ** 0.5)
            yield pd.DataFrame({"sig_raw": 1 + level, "bak_raw": 2 + level, "ovr_raw": 1.5 + level})

    s = Q.score_segments(signals(spark, d), predict, 10)
    return s.select("clip_id", r("sig", 5).alias("sig"), r("bak", 5).alias("bak"), r("ovr", 5).alias("ovr"), "num_hops")


@query()
def p4_provided_gains(spark, d):
    f = frames(spark, d)
    clean = f.withColumn("re", S.scaled("re", 0.6))
    return P.enhance(f, Q.provided_gains(f, None, clean)).select("clip_id", "t", r(S.total("re"), 5).alias("re"), r(S.total("im"), 5).alias("im"))
