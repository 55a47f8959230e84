"""Queries over clip catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from waveloom.functions import draws
from waveloom.operators import catalog as C
from waveloom.operators import curation

from .adapters import CATALOG, R, bits_sql, catalog, query, r, signals, table, SIG


@query(f"""with {CATALOG}, n as (select ds_type, key % 800 as key, ds_name, n_samples, sr, case when key % 3 = 0 then 0 else 8000 end as max_freq, key % 20 + 1 as n_channels from cat),
g as (select ds_type, key, ds_name, n_samples, sr, case when max_freq > 0 then max_freq else sr // 2 end as max_freq, n_samples < sr / 100.0 as is_short from
  (select *, row_number() over (partition by ds_type, key order by n_samples desc, ds_name) as k from n where n_samples > 0 and n_channels <= 16) where k = 1)
select ds_type, key, ds_name, n_samples, max_freq, is_short from g union all
select ds_type, key, ds_name, n_samples, 100 as max_freq, false as is_short from cat where not exists (select 1 from g where g.ds_type = cat.ds_type and g.key = cat.key)""")
def s3_build_clip_dataset(spark, d):
    c = catalog(spark, d).drop("factor")
    new = c.withColumn("max_freq", F.when(F.col("key") % 3 == 0, 0).otherwise(8000)).withColumn("n_channels", F.col("key") % 20 + 1).withColumn("key", F.col("key") % 800)
    old = c.withColumn("max_freq", F.lit(100)).withColumn("n_channels", F.lit(1).cast("long")).withColumn("is_short", F.lit(False))
    return C.build_clip_dataset(new, old).select("ds_type", "key", "ds_name", "n_samples", "max_freq", "is_short")


@query(f"""with {CATALOG}, f as (select distinct ds_name as file from cat) select cat.ds_name as file, key, (regexp_extract(ds_name, '([0-9]+)$', 1)::int % 3 = 0) as from_cache from cat""")
def s5_refresh_manifest(spark, d):
    c = catalog(spark, d)
    number = F.regexp_extract("file", "([0-9]+)$", 1).cast("int")
    listed = c.select(F.col("ds_name").alias("file"), "key")
    files = listed.select("file").distinct().withColumn("hash", C.fingerprint(F.lit(100), number))
    cache = listed.where(number % 3 != 1).withColumn("hash", C.fingerprint(F.when(number % 3 == 0, 100).otherwise(99), number))
    return C.refresh_manifest(files, cache, listed)


@query(f"""with {CATALOG} select key, coalesce(case when key % 3 > 0 then sr end, case when factor > 1 then 24000 end, 44100)::int as sr,
coalesce(case when key % 5 = 0 then 7000 end, case when factor > 2 then 9000 end, coalesce(case when key % 3 > 0 then sr end, case when factor > 1 then 24000 end, 44100) // 2)::int as max_freq from cat""")
def j4_resolve_attrs(spark, d):
    c = catalog(spark, d)
    config = c.select("ds_name", F.when(F.col("factor") > 1, 24000).alias("fallback_sr"), F.when(F.col("factor") > 2, 9000).alias("fallback_max_freq")).distinct()
    clips = c.select("ds_name", "key", F.when(F.col("key") % 3 > 0, F.col("sr")).alias("sr"), F.when(F.col("key") % 5 == 0, 7000).alias("max_freq"))
    return C.resolve_attrs(clips, config, 44100).select("key", F.col("sr").cast("int").alias("sr"), "max_freq")


@query("select doc_id as file from documents where doc_id not in (select doc_id from labels)")
def j5_missing_files(spark, d):
    return C.missing_files(table(spark, d, "documents").select(F.col("doc_id").alias("file")), table(spark, d, "labels").select(F.col("doc_id").alias("file")))


@query(f"with {CATALOG}, e as (select ds_type, ds_name, factor, count(*) as n from cat group by 1, 2, 3) select ds_type, sum(greatest(1, round(n * factor)))::bigint as n from e group by 1")
def a5_expected_lengths(spark, d):
    return C.expected_lengths(catalog(spark, d))


@query(f"with {CATALOG} select coalesce(ds_type, 'all') as ds_type, coalesce(ds_name, 'all') as ds_name, count(*) as n_clips, {R('sum(n_samples::double / sr / 3600)')} as hours from cat group by rollup(ds_type, ds_name)")
def a1_inventory(spark, d):
    return C.inventory(catalog(spark, d)).select(F.coalesce("ds_type", F.lit("all")).alias("ds_type"), F.coalesce("ds_name", F.lit("all")).alias("ds_name"), "n_clips", r("hours").alias("hours"))


@query(f"with {SIG} select clip_id, len(x)::int as true_samples, 1 as true_channels, (len(x) + clip_id % 3)::bigint as n_samples from sig where clip_id % 3 > 0")
def a2_audit_lengths(spark, d):
    s = signals(spark, d).select("clip_id", F.array("x").alias("samples"), (F.size("x") + F.col("clip_id") % 3).alias("n_samples"), F.lit(1).alias("n_channels"))
    return C.audit_lengths(s).select("clip_id", "true_samples", "true_channels", "n_samples")


_T1 = f"""t1 as (select *, row_number() over (partition by ds_name order by {bits_sql(4, 'key', 'split')}, key) - 1 as pos0, count(*) over (partition by ds_name) as n from cat),
sp as (select *, case when pos0 < floor(n * 0.7::double) then 'train' when pos0 < floor(n * 0.7::double) + floor(n * 0.15::double) then 'valid' else 'test' end as split from t1)"""


@query(f"with {CATALOG}, {_T1} select ds_name, key, split from sp")
def t1_split_dataset(spark, d):
    return C.split_dataset(catalog(spark, d), "ds_name", 4).select("ds_name", "key", "split")


_T2 = f"""k as (select *, row_number() over (partition by ds_name order by {bits_sql(6, 'key', 'epoch')}, key) - 1 as rr, count(*) over (partition by ds_name) as n from cat),
m as (select *, greatest(1, round(n * factor))::bigint as m from k), e as (select *, unnest(range(0, ceil(m::double / n)::bigint)) as rep from m),
ep as (select ds_name, ds_type, key, rep * n + rr as pos from e where rep * n + rr < m)"""


@query(f"with {CATALOG}, {_T2} select ds_name, key, pos from ep")
def t2_epoch_keys(spark, d):
    return C.epoch_keys(catalog(spark, d), 6).select("ds_name", "key", "pos")


@query(f"with {CATALOG} select bool_or(factor <> floor(factor)) as redraw from cat")
def t2b_needs_redraw(spark, d):
    return C.needs_redraw(catalog(spark, d))


@query(f"with {CATALOG}, k as (select *, row_number() over (partition by ds_type order by {bits_sql(8, 'key', 'sample')}, key) as n from cat) select ds_type, key from k where n <= 25")
def t3_sample_keys(spark, d):
    return C.sample_keys(catalog(spark, d), 25, 8).select("ds_type", "key")


@query(f"with {CATALOG}, {_T1}, b as (select split, key, row_number() over (partition by split order by {bits_sql(9, 'key', 'batch')}, key) - 1 as pos, count(*) over (partition by split) as t from sp) select split, key, pos, pos // 16 as batch_no from b where (pos // 16 + 1) * 16 <= t")
def t4_make_batches(spark, d):
    s = C.split_dataset(catalog(spark, d), "ds_name", 4).withColumn("idx", F.col("key"))
    return C.make_batches(s, 16, 9).select("split", "key", "pos", "batch_no")


@query(f"with {SIG}, b as (select clip_id // 16 as batch_no, max(len(x)) as n from sig group by 1) select clip_id // 16 as batch_no, list(len(x) order by clip_id)::int[] as lengths, any_value(n)::int as longest, count(*) * any_value(n) as cells from sig join b on b.batch_no = clip_id // 16 group by 1")
def t5_collate(spark, d):
    s = signals(spark, d).withColumn("batch_no", F.floor(F.col("clip_id") / 16)).withColumn("pos", F.col("clip_id"))
    c = C.collate(s)
    return c.select("batch_no", "lengths", F.array_max("lengths").alias("longest"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + F.size(v)).alias("cells"))


@query(f"with {CATALOG} select ds_name, key, 'train' as split from cat where factor < 1 union all select ds_name, key, 'train' from cat where factor > 2")
def u1_union_lists(spark, d):
    c = catalog(spark, d).withColumn("split", F.lit("train")).select("ds_name", "key", "split", "factor")
    return C.union_lists(c.where("factor < 1"), c.where("factor > 2")).select("ds_name", "key", "split")


_U2 = """cfg as (select doc_id % 300 as file, case doc_id % 3 when 0 then 'test' when 1 then 'valid' else 'train' end as split from documents)"""


def _config(spark, d):
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select((F.col("doc_id") % 300).alias("file"), F.when(k == 0, "test").when(k == 1, "valid").otherwise("train").alias("split"))


@query(f"with {_U2} select file, ['train', 'valid', 'test'][min(list_position(['train', 'valid', 'test'], split))::int] as split from cfg group by file")
def u2_dedupe_by_split(spark, d):
    return C.dedupe_by_split(_config(spark, d))


@query("with c as (select doc_id % 700 as key, doc_id % 3 as split from documents) select key, count(distinct split) as n_splits from c group by key having count(distinct split) > 1")
def u3_split_leaks(spark, d):
    return C.split_leaks(table(spark, d, "documents").select((F.col("doc_id") % 700).alias("key"), (F.col("doc_id") % 3).alias("split")))


@query("select doc_id as file, 'missing' as side from documents where doc_id not in (select page_id * 5 from pages) union all select page_id * 5, 'unlisted' from pages where page_id * 5 not in (select doc_id from documents)")
def u4_config_vs_files(spark, d):
    return C.config_vs_files(table(spark, d, "documents").select(F.col("doc_id").alias("file")), table(spark, d, "pages").select((F.col("page_id") * 5).alias("file")))


_MOS = "mos as (select key, 3.5::double + (key * 7 % 100) / 50.0::double as sig, 3.6::double + (key * 11 % 100) / 50.0::double as bak, 3.4::double + (key * 13 % 100) / 50.0::double as ovr from cat)"


@query(f"with {CATALOG}, {_MOS} select cat.key, cat.ds_name from cat join mos on mos.key = cat.key where sig > 4.2::double and bak > 4.5::double and ovr > 4.0::double")
def f4_filter_by_mos(spark, d):
    c = catalog(spark, d)
    k = F.col("key")
    s = c.select("key", (F.lit(3.5) + (k * 7 % 100) / 50).alias("sig"), (F.lit(3.6) + (k * 11 % 100) / 50).alias("bak"), (F.lit(3.4) + (k * 13 % 100) / 50).alias("ovr"))
    return curation.filter_by_mos(c, s).select("key", "ds_name")


@query("select conv_id, turn from conversations where not (text like '%unknown%' or text like '%<UNKNOWN%' or text like '%tion%') and text is not null")
def f6_drop_unknown(spark, d):
    t = table(spark, d, "conversations").withColumn("text", F.regexp_replace("text", "tion", "unknown"))
    return curation.drop_unknown(t).select("conv_id", "turn")


@query(f"with {CATALOG}, p as (select ds_name, sr, list(case when key % 4 = 0 then 6000 else 24000 end) as f from cat group by 1, 2) select ds_name, sr, {R('least(list_min(f), sr / 2.0)')} as max_freq, least(list_min(f), sr / 2.0) < sr / 2.0 as low_pass from p")
def f9_pair_max_freq(spark, d):
    p = catalog(spark, d).groupBy("ds_name", "sr").agg(F.min(F.when(F.col("key") % 4 == 0, 6000).otherwise(24000)).alias("f"))
    low, cut = C.pair_max_freq(F.array("f"), "sr")
    return p.select("ds_name", "sr", r(low).alias("max_freq"), cut.alias("low_pass"))


_PATHS = "select doc_id, case doc_id % 4 when 0 then 'datasets/noise/' when 1 then 'impulse_responses/' when 2 then 'clean/dev_testset/' else 'clean/' end || doc_id || '.wav' as p from documents"


@query(f"select doc_id, case when p like '%noise%' then 'noise' when p like '%impulse_responses%' then 'rir' else 'speech' end as ds_type, case when p like '%dev_testset%' then 'valid' else 'train' end as split from ({_PATHS})")
def f10_classify_source(spark, d):
    k = F.col("doc_id") % 4
    p = table(spark, d, "documents").select("doc_id", F.concat(F.when(k == 0, "datasets/noise/").when(k == 1, "impulse_responses/").when(k == 2, "clean/dev_testset/").otherwise("clean/"), "doc_id", F.lit(".wav")).alias("p"))
    kind, split = C.classify_source("p")
    return p.select("doc_id", kind.alias("ds_type"), split.alias("split"))


@query(f"select doc_id, replace(p, '/', '_') as key, regexp_extract(p, '([^/]*)$', 1) as name, regexp_replace(p, '\\.wav$', '_enh.wav') as enhanced from ({_PATHS})")
def x11_names(spark, d):
    k = F.col("doc_id") % 4
    p = table(spark, d, "documents").select("doc_id", F.concat(F.when(k == 0, "datasets/noise/").when(k == 1, "impulse_responses/").when(k == 2, "clean/dev_testset/").otherwise("clean/"), "doc_id", F.lit(".wav")).alias("p"))
    return p.select("doc_id", C.clip_key("p").alias("key"), C.base_name("p").alias("name"), C.suffixed("p", "enh").alias("enhanced"))


@query("select coalesce(a.n, b.n) as name, case when b.n is null then 'clean' when a.n is null then 'noisy' else 'both' end as sides from (select c_custkey || '.wav' as n from customer where c_custkey % 3 > 0) a full join (select c_custkey || '.wav' as n from customer where c_custkey % 4 > 0) b on a.n = b.n")
def j1_pair_by_name(spark, d):
    c = table(spark, d, "customer")
    name = lambda where: F.concat(F.lit(where), "c_custkey", F.lit(".wav")).alias("file")
    return C.pair_by_name(c.where("c_custkey % 3 > 0").select(name("clean/")), c.where("c_custkey % 4 > 0").select(name("noisy/"))).select("name", "sides")


@query("select 'noisy_clnsp' || (c_custkey * 7) || '_x_fileid_' || c_custkey || '.wav' as noisy, 'clean_fileid_' || c_custkey || '.wav' as clean from customer where c_custkey % 3 < 2")
def j2_pair_by_pattern(spark, d):
    c = table(spark, d, "customer")
    noisy = c.select(F.concat(F.lit("noisy_clnsp"), F.col("c_custkey") * 7, F.lit("_x_fileid_"), "c_custkey", F.lit(".wav")).alias("noisy"))
    clean = c.where("c_custkey % 3 < 2").select(F.concat(F.lit("clean_fileid_"), "c_custkey", F.lit(".wav")).alias("clean"))
    return C.pair_by_pattern(noisy, clean, [("noisy", "clean"), (r"clean_clnsp.*_fileid", "clean_fileid")])


@query("with c as (select conv_id || '-' || turn as filename, role, text from conversations) select a.filename, t.text from c a join c t on t.filename = a.filename where a.role = 'user' and t.text is not null")
def j3_with_transcripts(spark, d):
    c = table(spark, d, "conversations").withColumn("filename", F.concat_ws("-", "conv_id", "turn"))
    return C.with_transcripts(c.where("role = 'user'").select("filename"), c.where("text is not null").select("filename", "text"))


@query(f"""with {CATALOG}, pool as (select key, row_number() over (order by {bits_sql(0, 'key', 'pool')}, key) - 1 as i, count(*) over () as n from cat where ds_type = 'noise'),
pl as (select key as idx, 2 + {bits_sql(2, 'key', 'n_noises')} % 4 as c from cat where ds_type = 'speech'), s as (select idx, unnest(range(0, c)) as slot from pl)
select idx, slot::int as slot, pool.key as noise from s join pool on pool.i = ('0x' || substr(md5('2:' || idx || ':noise' || slot), 1, 12))::bigint % pool.n""")
def j6_attach_draws(spark, d):
    c = catalog(spark, d)
    plan = c.where("ds_type = 'speech'").select(F.col("key").alias("idx"), (draws.below(4, 2, F.col("key"), "n_noises") + 2).alias("n_noises"))
    return C.attach_draws(plan, c.where("ds_type = 'noise'").select("key"), "noise", "n_noises", 2).select("idx", "slot", F.col("key").alias("noise"))
