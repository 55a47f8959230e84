"""Queries over frames: bands, masks, running norms, multi-frame filters, enhancement and distances."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waveloom._np import spectra as N
from waveloom.functions import signal as S
from waveloom.functions import tables
from waveloom.operators import chunks as K
from waveloom.operators import spectral as P

from .adapters import BINS, FRAMES, PAIRS, SIG, SQL, R, frames, pairs, query, r, signal_chunks, signals, sm, table

CHUNK = 4096

WIDTHS = [2, 2, 2, 3, 4, 5, 6, 8]


def _bins(df, *cols):
    """Rows of (clip_id, t, f, values) from array columns."""
    z = F.arrays_zip(*[F.col(c).alias(c) for c in cols])
    x = df.select("clip_id", "t", F.posexplode(z).alias("f", "z"))
    return x.select("clip_id", "t", F.col("f").cast("long").alias("f"), *[r(f"z.{c}").alias(c) for c in cols])


FX = f"{FRAMES}, fx as (select clip_id, t, f, re[f + 1] as a, im[f + 1] as b from (select *, unnest(range(0, {BINS})) as f from fr))"
_BANDS = ", ".join(f"({i}, {sum(WIDTHS[:i])}, {sum(WIDTHS[: i + 1])})" for i in range(len(WIDTHS)))
BX = f"bands(band, lo, hi) as (values {_BANDS}), eb as (select clip_id, t, band, avg(a * a + b * b) as e from fx join bands on f >= lo and f < hi group by 1, 2, 3)"


@query(f"select p_partkey, {R('9.265::double * ln(1 + p_retailprice / (24.7::double * 9.265::double))')} as erb, {R('24.7::double * 9.265::double * (exp((p_size / 2.0::double) / 9.265::double) - 1)')} as hz from part")
def x2_erb_scale(spark, d):
    return table(spark, d, "part").select("p_partkey", r(P.hz_to_erb("p_retailprice")).alias("erb"), r(P.erb_to_hz(F.col("p_size") / 2)).alias("hz"))


@query(f"with {FX}, {BX} select clip_id, t, band as f, {R('e')} as mean, {R('10 * log10(e + 1e-10::double)')} as erb from eb")
def x3_erb_energy(spark, d):
    f = frames(spark, d)
    e = P.erb_energy(P.erb_energy(f, WIDTHS, db=False).withColumnRenamed("erb", "mean"), WIDTHS)
    return _bins(e, "mean", "erb")


_GAIN = "(0.1::double + 0.12::double * band)"


@query(f"with {FX}, bands(band, lo, hi) as (values {_BANDS}) select clip_id, t, f, {R(f'a * greatest({_GAIN}, 0.25118864315095801::double)')} as re, {R(f'b * greatest({_GAIN}, 0.25118864315095801::double)')} as im from fx join bands on f >= lo and f < hi")
def x4_apply_gains(spark, d):
    g = F.array(*[F.lit(0.1 + 0.12 * i) for i in range(len(WIDTHS))])
    return _bins(P.apply_gains(frames(spark, d).withColumn("gains", g), "gains", WIDTHS, floor_db=12.0), "re", "im")


@query(f"with {FX} select clip_id, t, f, {R('a * 0.5011872336272722::double + 0.3::double * b * (1 - 0.5011872336272722::double)')} as y from fx")
def x5_limit_attenuation(spark, d):
    f = frames(spark, d).withColumn("e", S.scaled("im", 0.3))
    return _bins(f.withColumn("y", P.limit_attenuation("re", "e", 6.0)), "y")


def _pf(tail: str) -> str:
    g = "least(greatest(sqrt(0.09::double * (a * a + b * b) * (1 + f % 3)) / (sqrt(a * a + b * b) + 1e-12::double), 1e-12::double), 1::double)"
    return f"select clip_id, t, f, g, {R('(1.02::double * g / (1 + 0.02::double * pow(g / (g * sin(g * pi() / 2)), 2))) / g')} as y from (select clip_id, t, f, {g} as g from fx)"


@query(f"with {FX} select clip_id, t, f, y from ({_pf('all')})")
def x6_post_filter(spark, d):
    k = F.array(*[F.lit(math.sqrt(0.09 * (1 + i % 3))) for i in range(BINS)])
    f = frames(spark, d).withColumn("n", P.magnitude()).withColumn("e", F.zip_with("n", k, lambda a, b: a * b))
    return _bins(f.withColumn("y", P.post_filter("n", "e")), "y")


@query(f"with {FX}, m as (select clip_id, t, f, a * a * 0.49::double + b * b * 0.25::double as s2, (0.3::double * a) * (0.3::double * a) + (0.5::double * b) * (0.5::double * b) as n2, a * a + b * b as x2 from fx) "
       f"select clip_id, t, f, {R('least(greatest(s2 / (s2 + n2 + 1e-10::double), 0), 1)')} as wg, {R('least(greatest(sqrt(s2) / (sqrt(s2) + sqrt(n2) + 1e-10::double), 0), 1)')} as irm, {R('pow(least(greatest(sqrt(s2) / (sqrt(x2) + 1e-10::double), 0), 1), 0.6::double)')} as iam from m")
def x7_ideal_masks(spark, d):
    f = frames(spark, d).withColumns({"cr": S.scaled("re", 0.7), "ci": S.scaled("im", 0.5)})
    m = lambda kind, g=1.0: P.ideal_mask("cr", "ci", "re", "im", kind, g)
    return _bins(f.withColumns({"wg": m("wg"), "irm": m("irm"), "iam": m("iam", 0.6)}), "wg", "irm", "iam")


@query(f"with {FX} select clip_id, t, f, {R('10 * log10(greatest(a * a + b * b, 1e-10::double))')} as db from fx")
def x13_spectrogram_db(spark, d):
    return _bins(frames(spark, d).withColumn("db", P.spectrogram_db()), "db")


def _ema(alpha: float, x: str, lo: float, hi: float, n: int, extra: str = "") -> str:
    start = f"({lo}::double + i * ({hi}::double - ({lo}::double)) / {n - 1})"
    return (f"em(clip_id, t, i, x, s) as (select clip_id, t, i, x, x * (1 - {alpha}::double) + {start} * {alpha}::double from src where t = 0 "
            f"union all select n.clip_id, n.t, n.i, n.x, n.x * (1 - {alpha}::double) + em.s * {alpha}::double from em join src n on n.clip_id = em.clip_id and n.i = em.i and n.t = em.t + 1)")


@query(f"with recursive {FX}, {BX}, src as (select clip_id, t, band as i, 10 * log10(e + 1e-10::double) as x from eb), {_ema(0.9, 'x', -60, -90, len(WIDTHS))} select clip_id, t, i as f, {R('(x - s) / 40')} as erb_norm from em")
def n2_ema_mean_norm(spark, d):
    return _bins(P.ema_mean_norm(P.erb_energy(frames(spark, d), WIDTHS), 0.9), "erb_norm")


@query(f"with recursive {FX}, src as (select clip_id, t, f as i, sqrt(a * a + b * b) as x from fx where f < 20), {_ema(0.9, 'x', 1e-3, 1e-4, 20)} select em.clip_id, em.t, f, {R('a / sqrt(s)', 5)} as re, {R('b / sqrt(s)', 5)} as im from em join fx on fx.clip_id = em.clip_id and fx.t = em.t and fx.f = em.i")
def n3_ema_unit_norm(spark, d):
    u = P.ema_unit_norm(frames(spark, d), 0.9, 20)
    z = F.arrays_zip("re", "im")
    x = u.select("clip_id", "t", F.posexplode(z).alias("f", "z"))
    return x.select("clip_id", "t", F.col("f").cast("long").alias("f"), r("z.re", 5).alias("re"), r("z.im", 5).alias("im"))


@query(f"with recursive {FX}, src as (select clip_id, t, f as i, sqrt(a * a + b * b) as x from fx), {_ema(0.95, 'x', -60, -90, BINS)} select clip_id, t, i as f, {R('x - s', 5)} as mag_norm from em")
def n3b_ema_mag_norm(spark, d):
    u = P.ema_mag_norm(frames(spark, d), 0.95)
    return u.select("clip_id", "t", F.posexplode("mag_norm").alias("f", "v")).select("clip_id", "t", F.col("f").cast("long").alias("f"), r("v", 5).alias("mag_norm"))


@query(f"select o_orderkey, {R('exp(-480.0::double / 48000 / (1 + o_custkey % 9))', 3)} as alpha from orders where round(exp(-480.0::double / 48000 / (1 + o_custkey % 9)), 3) < 1")
def n4_norm_alpha(spark, d):
    taus = F.array(*[F.lit(N.norm_alpha(48000, 480, t)) for t in range(1, 10)])
    return table(spark, d, "orders").select("o_orderkey", r(F.get(taus, (F.col("o_custkey") % 9).cast("int")), 3).alias("alpha")).where("alpha < 1")


def _energy_sql(e: str, ws: int) -> str:
    ws += 1 - ws % 2
    return f"(select sum(o.{e} * 0.5::double * (1 - cos(2 * pi() * (o.t - x.t + {ws // 2}) / {ws}))) / {ws} from en o where o.clip_id = x.clip_id and o.t between x.t - {ws // 2} and x.t + {ws // 2})"


@query(f"with {FX}, en as (select clip_id, t, sum(a * a) as s, sum(0.01::double * b * b) as n from fx group by 1, 2), l as (select clip_id, t, {_energy_sql('s', 4)} / greatest({_energy_sql('n', 8)}, 1e-12::double) as snr from en x) "
       f"select clip_id, t, {R('least(greatest(10 * log10(greatest(snr, 1e-12::double)), -16), 36)', 5)} as lsnr from l")
def n5_local_snr(spark, d):
    f = frames(spark, d)
    zero = F.transform("re", lambda v: v * 0.0)
    clean, noise = f.withColumn("im", zero), f.withColumns({"re": S.scaled("im", 0.1), "im": zero})
    return P.local_snr(clean, noise, 4).select("clip_id", "t", r("lsnr", 5).alias("lsnr"))


@query(f"with {FX}, o as (select unnest(range(0, 3)) as o) select x.clip_id, x.t, o, {R('coalesce(sum(y.a), 0)')} as re, {R('coalesce(sum(y.b), 0)')} as im from fr x cross join o left join fx y on y.clip_id = x.clip_id and y.t = x.t - 1 + o group by 1, 2, 3")
def n6_unfold_frames(spark, d):
    u = P.unfold_frames(frames(spark, d), 3, lookahead=1)
    x = u.select("clip_id", "t", F.posexplode(F.arrays_zip("re_n", "im_n")).alias("o", "z"))
    return x.select("clip_id", "t", F.col("o").cast("long").alias("o"), r(S.total("z.re_n")).alias("re"), r(S.total("z.im_n")).alias("im"))


@query(f"""with {FX}, o as (select unnest(range(0, 3)) as o), c as (select x.clip_id, x.t, o, x.f, 0.5::double * y.a as c, 0.25::double * y.b as d from fx x cross join o join fx y on y.clip_id = x.clip_id and y.t = x.t and y.f = (x.f + o) % {BINS}),
y as (select c.clip_id, c.t, c.f, sum(x.a * c.c - x.b * c.d) as re, sum(x.a * c.d + x.b * c.c) as im from c join fx x on x.clip_id = c.clip_id and x.f = c.f and x.t = c.t - 2 + o group by 1, 2, 3)
select fx.clip_id, fx.t, fx.f, {R('case when fx.f < 20 then y.re else a end')} as re, {R('case when fx.f < 20 then y.im else b end')} as im from fx join y on y.clip_id = fx.clip_id and y.t = fx.t and y.f = fx.f""")
def n7_deep_filter(spark, d):
    f = frames(spark, d)
    roll = lambda c, o, k: F.transform(F.concat(F.slice(c, o + 1, BINS), F.slice(c, 1, o)) if o else F.col(c), lambda v: v * k)
    coefs = f.select("clip_id", "ch", "t", F.array(*[roll("re", o, 0.5) for o in range(3)]).alias("c_re"), F.array(*[roll("im", o, 0.25) for o in range(3)]).alias("c_im"))
    return _bins(P.deep_filter(f, coefs, 3, nb_df=20), "re", "im")


@query(f"with {FX}, o as (select unnest(range(0, 2)) as o), u as (select x.clip_id, x.t, o, x.f, coalesce(y.a, 0) as a, coalesce(y.b, 0) as b from fx x cross join o left join fx y on y.clip_id = x.clip_id and y.f = x.f and y.t = x.t - 1 + o) "
       f"select p.clip_id, p.t, p.o as i, q.o as j, {R('sum(p.a * q.a + p.b * q.b)')} as r_re, {R('sum(p.b * q.a - p.a * q.b)')} as r_im from u p join u q on q.clip_id = p.clip_id and q.t = p.t and q.f = p.f group by 1, 2, 3, 4")
def n8_frame_corr(spark, d):
    c = P.frame_corr(frames(spark, d), 2)
    return c.select("clip_id", "t", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r(S.total("r_re")).alias("r_re"), r(S.total("r_im")).alias("r_im"))


_DFT = f"""{SIG}, k as (select clip_id, x, unnest(range(0, len(x) // 8)) as t from sig), w as (select clip_id, t, x, unnest(range(0, 16)) as n from k),
s as (select clip_id, t, n, sin(pi() / 2 * pow(sin(pi() * (n + 0.5::double) / 16), 2)) * (case when t * 8 - 8 + n < 0 then 0 else x[t * 8 - 8 + n + 1] end) as v from w),
sp as (select clip_id, t, f, sum(v * cos(2 * pi() * f * n / 16)) / 16 as re, sum(-v * sin(2 * pi() * f * n / 16)) / 16 as im from s, (select unnest(range(0, 9)) as f) group by 1, 2, 3)"""


@query(f"with {_DFT} select clip_id, t, f, {R('re', 5)} as re, {R('im', 5)} as im from sp")
def e1_stft(spark, d):
    x = K.stft(signal_chunks(spark, d, CHUNK), 16, 8, CHUNK).select("clip_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("f", "z"))
    return x.select("clip_id", "t", F.col("f").cast("long").alias("f"), r("z.re", 5).alias("re"), r("z.im", 5).alias("im"))


@query(SQL["e1_stft"])
def p5_spectrum_function(spark, d):
    tables.register(spark)
    rows = spark.sql("select clip_id, t, re, im from {clips}, lateral clip_spectrum(x, 16, 8)", clips=signals(spark, d))
    x = rows.select("clip_id", "t", F.posexplode(F.arrays_zip("re", "im")).alias("f", "z"))
    return x.select("clip_id", "t", F.col("f").cast("long").alias("f"), r("z.re", 5).alias("re"), r("z.im", 5).alias("im"))


@query(f"with {SIG}, k as (select clip_id, x, unnest(range(0, (len(x) // 8) * 8)) as i from sig) select clip_id, i, {R('case when i < 8 then 0 else x[i - 8 + 1] end', 5)} as x from k")
def e2_istft(spark, d):
    y = K.istft(K.stft(signal_chunks(spark, d, CHUNK), 16, 8, CHUNK), 16, 8, CHUNK)
    x = y.select("clip_id", "start", F.posexplode("x").alias("k", "x"))
    return x.select("clip_id", (F.col("start") + F.col("k")).alias("i"), r("x", 5).alias("x"))


@query(f"""with recursive {_DFT}, bd(band, lo, hi) as (values (0, 0, 1), (1, 1, 3), (2, 3, 5), (3, 5, 9)), eb as (select clip_id, t, band as i, 10 * log10(avg(re * re + im * im) + 1e-10::double) as x from sp join bd on f >= lo and f < hi group by 1, 2, 3),
src as (select * from eb), {_ema(0.9, 'x', -60, -90, 4)} select clip_id, t, i as f, {R('(x - s) / 40', 5)} as feat_erb from em""")
def e3_features(spark, d):
    x = K.features(signal_chunks(spark, d, CHUNK), 16, 8, [1, 2, 2, 4], 5, 0.9, CHUNK).select("clip_id", "t", F.posexplode("feat_erb").alias("f", "v"))
    return x.select("clip_id", "t", F.col("f").cast("long").alias("f"), r("v", 5).alias("feat_erb"))


_BAND = P._band_of(BINS, 48000)
_LAST = [max(k for k in range(BINS) if _BAND[k] == b) for b in range(8)]


@query(f"""with {FX}, fb(f, band) as (values {', '.join(f'({k}, {b})' for k, b in enumerate(_BAND))}), lv as (select clip_id, t, band, avg(20 * log10(sqrt(a * a + b * b) + 1e-16::double)) as m from fx join fb on fb.f = fx.f group by 1, 2, 3),
w as (select clip_id, t // 10 as w, band, max(m) as m from lv group by 1, 2, 3), c as (select clip_id, w, coalesce(min(band - 1) filter (where band > 0 and m < -14), 7) as c from w group by 1, 2),
b as (select clip_id, list([{', '.join(map(str, _LAST))}][c + 1]) as l from c group by 1) select clip_id, list_sort(l)[len(l) // 2 + 1] as max_bin from b""")
def e4_estimate_bandwidth(spark, d):
    return P.estimate_bandwidth(frames(spark, d), BINS, cut_db=-14, window=10)


@query(f"with {FX}, m(f, src) as (values {', '.join(f'({k}, {s})' for k, s in enumerate(P.extension_map(BINS, 16, 48000, 2)))}) select x.clip_id, x.t, m.f, {R('x.a')} as re, {R('x.b')} as im from fx x join m on m.src = x.f")
def e5_extend_bandwidth(spark, d):
    return _bins(P.extend_bandwidth(frames(spark, d), BINS, 16, 48000, 2), "re", "im")


@query(f"with {FX}, bands(band, lo, hi) as (values {_BANDS}), k as (select clip_id, t, f, a, b, {_GAIN} as m from fx join bands on f >= lo and f < hi), g as (select *, least(greatest(sqrt(a * m * a * m + b * m * b * m) / (sqrt(a * a + b * b) + 1e-12::double), 1e-12::double), 1::double) as g from k), "
       "p as (select *, (1.02::double * g / (1 + 0.02::double * pow(g / (g * sin(g * pi() / 2)), 2))) / g as p from g) "
       f"select clip_id, t, f, {R('a * 0.1::double + a * m * p * 0.9::double')} as re, {R('b * 0.1::double + b * m * p * 0.9::double')} as im from p")
def e6_enhance(spark, d):
    f = frames(spark, d)
    gains = f.select("clip_id", "ch", "t", F.array(*[F.lit(0.1 + 0.12 * i) for i in range(len(WIDTHS))]).alias("gains"))
    return _bins(P.enhance(f, gains, WIDTHS, beta=0.02, atten_db=20.0), "re", "im")


@query(f"with {FX} select clip_id, c.ch, t, f, {R('greatest(abs(a), abs(b))')} as gains from fx cross join (select unnest([0, 1]) as ch) c")
def e8_reduce_mask(spark, d):
    f = frames(spark, d)
    both = f.select("clip_id", F.lit(0).alias("ch"), "t", F.transform("re", F.abs).alias("gains")).union(f.select("clip_id", F.lit(1), "t", F.transform("im", F.abs)))
    x = P.reduce_mask(both).select("clip_id", "ch", "t", F.posexplode("gains").alias("f", "g"))
    return x.select("clip_id", "ch", "t", F.col("f").cast("long").alias("f"), r("g").alias("gains"))


_C = [0, *N.AIR_CENTRES]
_V = "[" + ", ".join(f"exp(-10 * {c}::double * 1e-3::double)" for c in [N.AIR["20C_50-70%"][0], *N.AIR["20C_50-70%"]]) + "]"


@query(f"with {FX}, q as (select clip_id, t, f, a, b, f * 24000.0::double / {BINS - 1} as hz from fx), s as (select *, " + "case " + " ".join(f"when hz <= {c} then {i}" for i, c in enumerate(_C) if i) + f" else {len(_C) - 1} end as i from q), "
       f"v as (select *, {_V}[i] as y0, {_V}[i + 1] as y1, {_C}[i] as x0, {_C}[i + 1] as x1 from s) select clip_id, t, f, {R('a * (y0 + (y1 - y0) * (hz - x0) / (x1 - x0))')} as re, {R('b * (y0 + (y1 - y0) * (hz - x0) / (x1 - x0))')} as im from v")
def m13_air_absorption(spark, d):
    return _bins(P.air_absorption(frames(spark, d), BINS, 48000, "20C_50-70%", 10.0), "re", "im")


@query(f"with {FX}, q as (select clip_id, t, pow(greatest(abs(a), 1e-12::double), 0.6::double) as x, pow(greatest(abs(b), 1e-12::double), 0.6::double) as y from fx) select clip_id, t, {R('avg(pow(y - x, 2) * case when y < x then 2 else 1 end)')} as distance from q group by 1, 2")
def q8_spectral_distance(spark, d):
    f = frames(spark, d)
    return f.select("clip_id", "t", r(P.spectral_distance(F.transform("re", F.abs), F.transform("im", F.abs), 0.6, 2.0)).alias("distance"))


_M8 = "pow(greatest(sqrt({0} * {0} + {1} * {1}), 1e-12::double), 0.6::double)"


@query(f"with {FX}, q as (select clip_id, t, 0.5::double * a as y0, 0.5::double * b as y1, b as s0, a as s1 from fx), m as (select *, {_M8.format('y0', 'y1')} as y, {_M8.format('s0', 's1')} as s, sqrt(y0 * y0 + y1 * y1) as ya, sqrt(s0 * s0 + s1 * s1) as sa from q), "
       f"z as (select clip_id, t, pow(y - s, 2) * case when y < s then 2 else 1 end as d, pow(y0 / ya * y - s0 / sa * s, 2) + pow(y1 / ya * y - s1 / sa * s, 2) as c from m) select clip_id, t, {R('3 * avg(d) + 0.5::double * avg(c) / 2', 5)} as distance from z group by 1, 2")
def q9_masked_spectrum(spark, d):
    f = frames(spark, d)
    gains = f.select("clip_id", "ch", "t", F.transform("re", lambda v: F.lit(0.5)).alias("gains"))
    x = P.masked_distance(f, gains, f.withColumns({"re": F.col("im"), "im": F.col("re")}), gamma=0.6, magnitudes=3.0, numbers=0.5, under=2.0)
    return x.select("clip_id", "t", r("distance", 5).alias("distance"))


@query()
def q8_multires_distance(spark, d):
    p = pairs(spark, d).withColumnRenamed("clip_id", "filename")
    return P.multires_distance(p, [8, 16, 32], 0.6, 1.0, 0.5).select("filename", r("distance").alias("distance"))


@query(f"with {FX}, q as (select clip_id, t, pow(greatest(abs(a), 1e-12::double), 0.6::double) as p, pow(greatest(abs(b), 1e-12::double), 0.6::double) as t0 from fx where f < 24), e as (select clip_id, t, pow(p - t0, 2) * case when p < t0 then 2 else 1 end as d from q) select clip_id, t, {R('avg(d) + 10 * avg(d * d)')} as distance from e group by 1, 2")
def q9_mask_distance(spark, d):
    f = frames(spark, d)
    return f.select("clip_id", "t", r(P.mask_distance(F.transform("re", F.abs), F.transform("im", F.abs), max_bin=24)).alias("distance"))


@query(f"with {PAIRS} select snr, count(*) as n, {R('avg(pow(10 * log10(list_reduce(list_transform(clean, lambda v: v * v), lambda x, y: x + y, 0::double) / list_reduce(list_transform(noise, lambda v: k * v * k * v), lambda x, y: x + y, 0::double)) - snr, 2))')} as error from pairs group by snr")
def q10_lsnr_error(spark, d):
    p = pairs(spark, d)
    got = 10 * F.log10(S.energy("clean") / S.energy(S.scaled("noise", "k")))
    return p.withColumn("got", got).groupBy("snr").agg(F.count(F.lit(1)).alias("n"), r(P.lsnr_error("got", "snr")).alias("error"))
