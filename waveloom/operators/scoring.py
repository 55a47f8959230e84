"""Tables of scores, transcripts and training runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom._np.edits import counts as word_counts
from waveloom._np.edits import distance as word_distance

from . import scans
from .ranks import sorted_ranks

_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def wide_scores(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per file with a column per metric, in the given order."""
    return scores.groupBy("filename").pivot("metric", metrics).agg(F.first("value"))


def check_targets(scores: DataFrame, targets: DataFrame, atol: float = 1e-4, rtol: float = 1e-4) -> DataFrame:
    """scores joined to targets (filename, metric, target), with ok where |value - target| <= atol + rtol * |target|."""
    both = scores.join(targets, ["filename", "metric"])
    return both.withColumn("ok", F.abs(F.col("value") - F.col("target")) <= atol + rtol * F.abs("target"))


def compare_variants(scores: DataFrame) -> DataFrame:
    """filename, metric, noisy, enhanced, gain; only files that have both."""
    pick = lambda v: F.max(F.when(F.col("variant") == v, F.col("value"))).alias(v)
    both = scores.groupBy("filename", "metric").agg(pick("noisy"), pick("enhanced"))
    return both.where("noisy is not null and enhanced is not null").withColumn("gain", F.col("enhanced") - F.col("noisy"))


def metric_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("variant", "metric").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def metric_by_snr(scores: DataFrame) -> DataFrame:
    """Mean per metric and input SNR, and per metric over all (snr null): one pass over grouping sets. Scores without an
    SNR count for the latter alone."""
    sets = scores.rollup("metric", "snr").agg(F.avg("value").alias("mean"), F.grouping_id().alias("_g"))
    return sets.where("_g = 1 or (_g = 0 and snr is not null)").select("metric", "snr", "mean")


def describe_scores(scores: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of each metric. Quartiles are exact, between neighbouring ranks; the values are
    ranked over sorted parts, so a metric may have any number of them."""
    full = scores.select("metric", "value").where("value is not null")
    ranked = sorted_ranks(full, "metric", ["value"])

    def q(p: float) -> Column:
        at = (F.col("_n") - 1) * p
        share = at - F.floor(at)
        low, high = (F.max(F.when(F.col("_r") == f(at), F.col("value"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(share)

    some = ranked.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("value").alias("high"))
    none = scores.groupBy("metric").agg(F.count("value").alias("n")).where("n = 0")
    return some.unionByName(none, allowMissingColumns=True)


def normalized_words(text) -> Column:
    """Without ASCII punctuation, in lower case, split at single spaces."""
    return F.split(F.lower(F.translate(text, _PUNCTUATION, "")), " ")


def word_edits(reference, hypothesis) -> Column:
    """Word edit distance of whole texts; null if either is."""
    @F.pandas_udf("int")
    def edits(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else word_distance(x.tolist(), y.tolist()) for x, y in zip(a, b)], dtype="Int32")

    return edits(normalized_words(reference), normalized_words(hypothesis))


def word_edit_counts(reference, hypothesis) -> Column:
    """insertions, deletions and substitutions of one shortest way from the reference to the hypothesis (see edits.counts for which); they
    sum to word_edits. Nulls if either text is null."""
    @F.pandas_udf("insertions int, deletions int, substitutions int")
    def each(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None or y is None else word_counts(x.tolist(), y.tolist()) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["insertions", "deletions", "substitutions"], dtype="Int32")

    return each(normalized_words(reference), normalized_words(hypothesis))


def wer(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Corpus error rate sum(edits) / sum(words), and mean accuracy 1 - edits / words. pairs: edits, words.

    A reference without words has no accuracy of its own: it is left out of the mean and counted in n_wordless, and its edits count in the error
    rate. Both results are null where there is nothing to divide by.
    """
    each = 1 - F.try_divide("edits", "words")
    return pairs.groupBy(*by).agg(F.try_divide(F.sum("edits"), F.sum("words")).alias("wer"), F.avg(each).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("words") == 0).alias("n_wordless"))


#: Coefficients of the published score maps, lowest power last: fixed values.
MOS_MAPS = {
    "sig": (-0.08397278, 1.22083953, 0.0052439),
    "bak": (-0.13166888, 1.60915514, -0.39604546),
    "ovr": (-0.06766283, 1.11546468, 0.04602535),
    "sig_personal": (-0.01019296, 0.02751166, 1.19576786, -0.24348726),
    "bak_personal": (-0.04976499, 0.44276479, -0.1644611, 0.96883132),
    "ovr_personal": (-0.00533021, 0.005101, 1.18058466, -0.11236046),
    "sig_older": (7.572372955623894730e-02, 6.592637550310214145e-01, 9.651228012789436761e-01),
    "bak_older": (-1.721332907340922813e-01, 2.700114234092929166, -3.733460011101781717),
    "ovr_older": (7.600269530243179694e-02, 6.609981731940616223e-01, 8.924546794696789354e-01),
}


def mos_polynomial(raw, kind: str) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    out = F.lit(0.0)
    for c in MOS_MAPS[kind]:
        out = out * raw + c
    return out


def aggregate_segments(segments: DataFrame, personal: bool = False) -> DataFrame:
    """Per clip the mean of the raw segment scores and of the mapped ones."""
    end = "_personal" if personal else ""
    cols = [F.avg(f"{k}_raw").alias(f"{k}_raw") for k in ("sig", "bak", "ovr")] + [F.avg(mos_polynomial(f"{k}_raw", k + end)).alias(k) for k in ("sig", "bak", "ovr")]
    return segments.groupBy("clip_id").agg(*cols, F.count(F.lit(1)).alias("num_hops"))


def composite(pesq, llr, wss, ssnr) -> dict[str, Column]:
    """CSIG, CBAK and COVL from their parts, limited to 1 to 5."""
    limit = lambda c: F.least(F.greatest(c, F.lit(1.0)), F.lit(5.0))
    return {"csig": limit(3.093 - 1.029 * llr + 0.603 * pesq - 0.009 * wss), "cbak": limit(1.634 + 0.478 * pesq - 0.007 * wss + 0.063 * ssnr), "covl": limit(1.594 + 0.805 * pesq - 0.512 * llr - 0.007 * wss)}


def rtf_stats(timings: DataFrame, by: list[str]) -> DataFrame:
    """Real-time factors (processing / audio time): mean, largest, and how many are 1 or more. Clips of no length have no factor and are
    counted in n_empty."""
    t = timings.withColumn("rtf", F.try_divide("processing", "audio"))
    return t.groupBy(*by).agg(F.avg("rtf").alias("mean_rtf"), F.max("rtf").alias("max_rtf"), F.sum(F.coalesce(F.col("rtf") >= 1, F.lit(False)).cast("int")).alias("underruns"), F.count_if(F.col("audio") == 0).alias("n_empty"))


def recent_loss(log: DataFrame, n: int = 100, every: int = 10) -> DataFrame:
    """The mean of the last n losses of a run, at every `every`-th step."""
    means = scans.trailing_mean(scans.in_ranges(log, "run", ["epoch"]), "run", ["epoch"], "value", n, "recent")
    return means.where(F.col("epoch") % every == 0).select(*log.columns, "recent")


def _with_best(runs: DataFrame, rule: str) -> DataFrame:
    rows = scans.running(scans.in_ranges(runs, "run", ["epoch"]), "run", ["epoch"], F.col("value"), rule, "_before", before=True)
    better = F.col("value") < F.col("_before") if rule == "min" else F.col("value") > F.col("_before")
    return rows.withColumn("is_best", F.col("_before").isNull() | better).withColumn("best", (F.least if rule == "min" else F.greatest)("value", "_before"))


def running_best(runs: DataFrame, rule: str = "min") -> DataFrame:
    """runs with best (value of all epochs so far) and is_best (strictly better than all before)."""
    return _with_best(runs, rule).select(*runs.columns, "is_best", "best")


def early_stop(runs: DataFrame, patience: int, rule: str = "min") -> DataFrame:
    """Per run the first epoch that is `patience` epochs past the last new best; null if there is none."""
    b = scans.running(_with_best(runs, rule), "run", ["epoch"], F.when(F.col("is_best"), F.col("epoch")), "max", "_last")
    return b.groupBy("run").agg(F.min(F.when(F.col("epoch") - F.col("_last") >= patience, F.col("epoch"))).alias("stop_epoch"))


def retention(artifacts: DataFrame, keep: int = 3) -> DataFrame:
    """artifacts with kept: the newest `keep` of each run."""
    ranked = sorted_ranks(artifacts, "run", ["epoch"])
    return ranked.withColumn("kept", F.col("_n") - F.col("_r") <= keep).select(*artifacts.columns, "kept")


def schedule_asof(epochs: DataFrame, schedule: list[tuple[int, int]], cap: int) -> DataFrame:
    """epochs with batch_size: the last schedule entry (epoch, size) at or before the epoch, at most cap."""
    size = F.lit(None).cast("int")
    for at, n in sorted(schedule):
        size = F.when(F.col("epoch") >= at, F.lit(n)).otherwise(size)
    return epochs.withColumn("batch_size", F.least(F.coalesce(size, F.lit(cap)), F.lit(cap)))


def worst_files(scores: DataFrame, k: int, ascending: bool = True) -> DataFrame:
    order = F.asc("value") if ascending else F.desc("value")
    return scores.orderBy(order, "filename", "variant", "metric").limit(k)


def example_per_snr(samples: DataFrame) -> DataFrame:
    """The latest sample of each split and SNR."""
    return samples.withColumn("_n", F.row_number().over(W.partitionBy("split", "snr").orderBy(F.desc("step")))).where("_n = 1").drop("_n")


def stage_decision(lsnr, low: float = -10.0, max_erb: float = 30.0, max_df: float = 20.0) -> Column:
    """'zero' under low, 'pass' over max_erb, 'mask' over max_df, else 'filter' (mask and multi-frame filter)."""
    lsnr = F.col(lsnr) if isinstance(lsnr, str) else lsnr
    return F.when(lsnr < low, "zero").when(lsnr > max_erb, "pass").when(lsnr > max_df, "mask").otherwise("filter")


def asof_controls(frames: DataFrame, controls: DataFrame, stream: str = "stream_id", ts: str = "ts") -> DataFrame:
    """frames with the value last set at or before them (null before the first); a control at the same time counts, and of several at one
    time the greatest value. A stream may be of any length: the last setting of a range of its rows is carried on to the next."""
    both = frames.withColumn("_k", F.lit(1)).withColumn("_v", F.lit(None).cast("double")).unionByName(
        controls.select(stream, ts, F.col("value").cast("double").alias("_v")).withColumn("_k", F.lit(0)), allowMissingColumns=True)
    rows = scans.in_ranges(both, stream, [ts, "_k", "_v"])
    last = scans.running(rows, stream, [ts, "_k", "_v"], F.when(F.col("_v").isNotNull(), F.struct(ts, "_v")), "max", "_last")
    return last.where("_k = 1").select(*frames.columns, F.col("_last._v").alias("setting"))
