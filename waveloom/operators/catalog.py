"""Clip catalogs: loading, attributes, splits, epochs, sampling, batches and set checks. Keys only; samples stay in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom.functions import draws
from waveloom.functions import signal as S
from waveloom.sources.paths import save

from .ranks import random_ranks, sorted_ranks

#: A clip is repeated in a draw join so that no copy has more than one in so many of a task's even share of draws.
DRAW_SHARES = 4


def clip_key(path) -> Column:
    """The relative path with '/' replaced by '_'."""
    return F.regexp_replace(path, "/", "_")


def base_name(path) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffixed(path, suffix: str) -> Column:
    """'_suffix' before the extension."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(path, r"^(.*?)(\.[^./]+)?$", f"$1_{suffix}$2") if suffix else path


def fingerprint(mtime, length) -> Column:
    return F.xxhash64(mtime, length)


def classify_source(path: str | Column) -> tuple[Column, Column]:
    """(type, split) of a source file by its name."""
    p = F.col(path) if isinstance(path, str) else path
    kind = F.when(p.contains("noise"), "noise").when(p.contains("impulse_responses"), "rir").otherwise("speech")
    return kind, F.when(p.contains("dev_testset"), "valid").otherwise("train")


def build_clip_dataset(new: DataFrame, existing: DataFrame | None, max_channels: int = 16) -> DataFrame:
    """The clips of both, new ones in place of existing ones with the same (ds_type, key).

    Clips without samples or with more than max_channels channels are left out; is_short marks those under a hundredth of a second;
    a max_freq that is null or not positive becomes sr / 2. Of repeated keys inside `new` the one with the most samples stays.
    """
    good = new.where((F.col("n_samples") > 0) & (F.col("n_channels") <= max_channels))
    best = W.partitionBy("ds_type", "key").orderBy(F.desc("n_samples"), "ds_name")
    good = good.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    good = good.withColumn("max_freq", F.when(F.col("max_freq") > 0, F.col("max_freq")).otherwise((F.col("sr") / 2).cast("int"))).withColumn("is_short", F.col("n_samples") < F.col("sr") / 100)
    if existing is None:
        return good
    return good.unionByName(existing.join(good.select("ds_type", "key"), ["ds_type", "key"], "left_anti"))


def refresh_manifest(files: DataFrame, cache: DataFrame, listed: DataFrame) -> DataFrame:
    """(file, key) from the cache where file and fingerprint agree, else from a new listing; from_cache tells which.

    files: file, hash; cache: file, hash, key; listed: file, key, read for stale or missing files only.
    """
    valid = files.join(cache, ["file", "hash"]).select("file", "key")
    fresh = files.join(cache.select("file", "hash").distinct(), ["file", "hash"], "left_anti").select("file").join(listed, "file")
    return valid.withColumn("from_cache", F.lit(True)).unionByName(fresh.select("file", "key").withColumn("from_cache", F.lit(False)))


def resolve_attrs(clips: DataFrame, config: DataFrame, sr: int) -> DataFrame:
    """sr and max_freq of each clip: its own, else the fallback of its dataset, else the default."""
    c = config.select("ds_name", F.col("fallback_sr").alias("_s"), F.col("fallback_max_freq").alias("_f"))
    out = clips.join(c, "ds_name", "left").withColumn("sr", F.coalesce("sr", "_s", F.lit(sr)))
    return out.withColumn("max_freq", F.coalesce("max_freq", "_f", (F.col("sr") / 2).cast("int"))).drop("_s", "_f")


def pair_max_freq(freqs, sr) -> tuple[Column, Column]:
    """The least max_freq of the speech parts and sr / 2, and whether the noise is to be low-passed to it."""
    half = (F.col(sr) if isinstance(sr, str) else F.lit(sr)) / 2
    low = F.least(F.array_min(freqs), half)
    return low, low < half


def missing_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    return listed.join(files, "file", "left_anti")


def expected_lengths(keys: DataFrame) -> DataFrame:
    """ds_type, n: the sum over datasets of max(1, round(keys * factor))."""
    each = keys.groupBy("ds_type", "ds_name", "factor").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("ds_type").agg(F.sum(epoch_size("n", "factor")).alias("n"))


def epoch_size(n, factor) -> Column:
    n, factor = (F.col(x) if isinstance(x, str) else x for x in (n, factor))
    return F.greatest(F.lit(1), F.round(n * factor)).cast("long")


def split_dataset(clips: DataFrame, group: str, seed: int, fractions: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """clips with a split: within each group a random order, int(.7 n) to train, int(.15 n) to valid, the rest to test."""
    rows = random_ranks(clips, group, draws.bits(seed, F.col("key"), "split"), "key")
    a = F.floor(F.col("_n") * fractions[0])
    b = a + F.floor(F.col("_n") * fractions[1])
    return rows.withColumn("split", F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "valid").otherwise("test")).select(*clips.columns, "split")


def epoch_keys(keys: DataFrame, seed: int, shuffle: bool = True) -> DataFrame:
    """The keys of one epoch: each dataset in a random (or key) order, repeated and cut to max(1, round(factor * n)). Adds pos."""
    each = random_ranks(keys, "ds_name", draws.bits(seed, F.col("key"), "epoch"), "key") if shuffle else sorted_ranks(keys, "ds_name", ["key"])
    each = each.withColumn("_m", epoch_size("_n", "factor"))
    each = each.withColumn("_rep", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_m") / F.col("_n")).cast("long") - 1)))
    return each.withColumn("pos", F.col("_rep") * F.col("_n") + F.col("_r")).where("pos < _m").select(*keys.columns, "pos")


def needs_redraw(config: DataFrame, split: str = "train", overfit: bool = False) -> DataFrame:
    """One row, redraw: whether the epoch's keys must be drawn again after the first epoch."""
    if overfit or split != "train":
        return config.agg(F.lit(False).alias("redraw"))
    return config.agg(F.coalesce(F.bool_or(F.col("factor") != F.floor("factor")), F.lit(False)).alias("redraw"))


def sample_keys(clips: DataFrame, n: int, seed: int, group: str = "ds_type") -> DataFrame:
    """n keys of each group, drawn at random: ranks inside counted hash ranges, so neither a large group nor a large n meets in one task."""
    return random_ranks(clips, group, draws.bits(seed, F.col("key"), "sample"), "key").where(F.col("_r") < n).select(*clips.columns)


def make_batches(samples: DataFrame, size: int, seed: int, drop_last: bool = True, shuffle: bool = True, shard: str = "split", overfit: bool = False) -> DataFrame:
    """samples with batch_no and pos within each split; the last batch of a split goes if it is not full and drop_last.

    overfit: every batch of a split is made of its first `size` samples in the order of idx, so one batch is met again and again.
    Positions come from ranks inside counted ranges, so no split has to be sorted in one task.
    """
    if overfit:
        rows = sorted_ranks(samples, shard, ["idx"])
        rows = rows.where(F.col("_r") < size).withColumn("batch_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / size) - 1, F.lit(0)).cast("long"))))
        rows = rows.withColumn("pos", F.col("batch_no") * size + F.col("_r"))
    else:
        rows = random_ranks(samples, shard, draws.bits(seed, F.col("idx"), "batch"), "idx") if shuffle else sorted_ranks(samples, shard, ["idx"])
        rows = rows.withColumn("pos", F.col("_r")).withColumn("batch_no", F.floor(F.col("pos") / size))
    if drop_last:
        rows = rows.where((F.col("batch_no") + 1) * size <= F.col("_n"))
    return rows.select(*samples.columns, "pos", "batch_no")


def collate(rows: DataFrame, samples: str = "x", key: str = "batch_no", order: str = "pos", n: int | None = None) -> DataFrame:
    """One row per batch: the arrays in order, padded with zeros to the longest (or n), and their lengths."""
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, samples))).alias("_z"))
    lengths = F.transform("_z", lambda z: F.size(z[samples]))
    to = F.lit(n) if n else F.array_max(lengths)
    pad = lambda z: F.concat(z[samples], F.array_repeat(F.lit(0.0), F.greatest(to - F.size(z[samples]), F.lit(0))))
    return g.select(key, F.transform("_z", pad).alias(samples), lengths.alias("lengths"))


def union_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both dataset lists; they must be of one split."""
    both = a.unionByName(b)
    if both.select("split").distinct().limit(2).count() > 1:
        raise ValueError("lists of different splits")
    return both


def dedupe_by_split(config: DataFrame) -> DataFrame:
    """Each file once, in the first of the splits train, valid, test that names it."""
    rank = F.array_position(F.array(*map(F.lit, ("train", "valid", "test"))), F.col("split"))
    return config.withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy(rank))).where("_n = 1").drop("_n")


def split_leaks(clips: DataFrame) -> DataFrame:
    """Keys in more than one split."""
    return clips.groupBy("key").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def config_vs_files(config: DataFrame, files: DataFrame) -> DataFrame:
    """file, side: 'missing' where listed and not found, 'unlisted' where found and not listed."""
    a = config.select("file").exceptAll(files.select("file")).distinct().withColumn("side", F.lit("missing"))
    b = files.select("file").exceptAll(config.select("file")).distinct().withColumn("side", F.lit("unlisted"))
    return a.unionByName(b)


def inventory(clips: DataFrame) -> DataFrame:
    """Clips and hours by type and dataset, by type, and in all."""
    hours = F.sum(F.col("n_samples") / F.col("sr") / 3600)
    return clips.rollup("ds_type", "ds_name").agg(F.count(F.lit(1)).alias("n_clips"), hours.alias("hours"))


def audit_lengths(clips: DataFrame) -> DataFrame:
    """Clips whose stored n_samples or n_channels are not those of their channel-first data."""
    n, c = F.size(F.get("samples", F.lit(0))), F.size("samples")
    return clips.withColumn("true_samples", n).withColumn("true_channels", c).where(~(F.col("n_samples").eqNullSafe(F.col("true_samples")) & F.col("n_channels").eqNullSafe(F.col("true_channels"))))


def pair_by_name(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """name, clean, noisy, sides, n_clean, n_noisy: one row for each base name of clean and noisy files. sides is 'both' for a pair, 'clean' or
    'noisy' where the other is missing, and 'repeated' where a side has several files of that name, of which the first is shown: such
    names are reported and make no pairs. Files without a name are left out."""
    def side(files: DataFrame, kind: str) -> DataFrame:
        return files.where("file is not null").groupBy(base_name("file").alias("name")).agg(F.min("file").alias(kind), F.count(F.lit(1)).alias(f"n_{kind}"))

    both = side(clean, "clean").join(side(noisy, "noisy"), "name", "full_outer").fillna(0, ["n_clean", "n_noisy"])
    sides = F.when(F.greatest("n_clean", "n_noisy") > 1, "repeated").when(F.col("n_noisy") == 0, "clean").when(F.col("n_clean") == 0, "noisy").otherwise("both")
    return both.select("name", "clean", "noisy", sides.alias("sides"), "n_clean", "n_noisy")


def pair_by_pattern(noisy: DataFrame, clean: DataFrame, rules: list[tuple[str, str]], expected: int | None = None) -> DataFrame:
    """Noisy files joined to the clean file their name becomes under the rules (regex, replacement), applied in order."""
    key = F.col("noisy")
    for pattern, to in rules:
        key = F.regexp_replace(key, pattern, to)
    out = noisy.withColumn("clean", key).join(clean, "clean")
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} pairs, not {expected}")
    return out


def with_transcripts(clips: DataFrame, transcripts: DataFrame) -> DataFrame:
    return clips.join(transcripts, "filename")


def attach_draws(plan: DataFrame, pool: DataFrame, slot: str, count, seed: int, crop: tuple[str, int] | None = None) -> DataFrame:
    """For each plan row `count` (a column or number) clips drawn uniformly with replacement from the pool.

    plan: idx, ...; pool: key, .... The pool's keys get dense indexes inside counted hash ranges; plan and pool meet by an equi-join on the
    index. How often each clip is drawn is counted on keys alone; a clip that is drawn more often than a fair share of the draws is
    repeated in the join, and its draws are dealt over the copies, so a small pool loads all tasks alike. crop: a column of samples and a
    length, to which a drawn piece of each is cut where the two meet, so whole clips travel once for each copy and never with the draws.
    """
    indexed, n = dense_index(pool)
    count = F.col(count) if isinstance(count, str) else F.lit(count)
    slots = plan.where(count > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    at = draws.bits(seed, F.col("idx"), F.concat(F.lit(slot), F.col("slot").cast("string"))) % n
    slots = slots.withColumn("pool_idx", at)
    demand = save(slots.groupBy("pool_idx").agg(F.count(F.lit(1)).alias("_d")), "demand")
    total = demand.agg(F.sum("_d")).first()[0] or 0
    fair = max(1, total // (DRAW_SHARES * int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    copies = demand.select("pool_idx", F.ceil(F.col("_d") / fair).cast("int").alias("_copies"))
    dealt = slots.join(copies, "pool_idx").withColumn("_copy", F.pmod(F.xxhash64("idx", "slot"), F.col("_copies")).cast("int")).drop("_copies")
    clips = indexed.join(copies, "pool_idx").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    out = dealt.join(clips, ["pool_idx", "_copy"]).drop("_copy")
    if crop is not None:
        column, length = crop
        out = out.withColumn(column, S.random_crop(column, F.lit(length), seed, F.concat_ws("-", "idx", F.lit(slot), "slot")))
    return out


def dense_index(pool: DataFrame) -> tuple[DataFrame, int]:
    """pool with pool_idx 0 to n - 1 in the order of the keys' hashes, and n (1 for an empty pool, so that draws modulo n are defined)."""
    rows = random_ranks(pool.withColumn("_all", F.lit(0)), "_all", draws.bits(0, F.col("key"), "pool"), "key")
    return rows.withColumnRenamed("_r", "pool_idx").drop("_all", "_n"), max(pool.count(), 1)
