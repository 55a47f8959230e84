"""Audio files and tables of scores, transcripts and dataset lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom._np import audio
from waveloom.functions import draws
from waveloom.operators import catalog, scoring

from .wav_source import write_wavs

CLIP = "file string, sr int, n_channels int, n_samples long, samples array<array<float>>"


def read_wav_clips(spark: SparkSession, path: str) -> DataFrame:
    """file, sr, n_channels, n_samples, samples (channel-first, floats) of WAV files under a path or glob."""
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                sr, x = audio.decode_wav(bytes(data))
                yield pd.DataFrame({"file": [name], "sr": [sr], "n_channels": [x.shape[0]], "n_samples": [x.shape[1]], "samples": [list(x)]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(decode, CLIP)


def write_wav_clips(clips: DataFrame, path: str, suffix: str = "") -> DataFrame:
    """Writes clips (file, sr, samples channel-first) as 16-bit WAV files under `path`, with "_suffix" before the extension; returns the
    manifest (file, uri, bytes, n_samples, sr). Files appear when all tasks have succeeded, and none if one fails."""
    named = clips.select(catalog.suffixed(catalog.base_name("file"), suffix).alias("file"), "sr", "samples")
    return write_wavs(named, path)


def read_ds_config(spark: SparkSession, path: str, factor: float | None = None) -> DataFrame:
    """split, pos, file, factor, fallback_sr, fallback_max_freq of a dataset list: JSON of split to lists
    [file, factor = 1.0, fallback_sr, fallback_max_freq, ...]; factors are multiplied by `factor`."""
    text = spark.read.text(path, wholetext=True).select("value")
    lists = F.from_json("value", "map<string,array<string>>")
    rows = text.select(F.explode(lists).alias("split", "rows")).select("split", F.posexplode("rows").alias("pos", "row"))
    row = F.from_json("row", "array<string>")
    rows = rows.select("split", "pos", row.alias("r"))
    at = lambda i: F.get("r", F.lit(i))
    return rows.select("split", "pos", at(0).alias("file"), (F.coalesce(at(1).cast("double"), F.lit(1.0)) * (1.0 if factor is None else factor)).alias("factor"), at(2).cast("int").alias("fallback_sr"), at(3).cast("int").alias("fallback_max_freq"))


def write_scores_csv(scores: DataFrame, path: str, metrics: list[str]) -> None:
    """One row per file, a column per metric."""
    scoring.wide_scores(scores, metrics).write.csv(path, header=True)


def read_scores(spark: SparkSession, paths: list[str], metrics: list[str]) -> DataFrame:
    return spark.read.csv(paths, header=True, schema="filename string, " + ", ".join(f"`{m}` double" for m in metrics))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """filename, text from a file with a tab between them and no header."""
    return spark.read.csv(path, sep="\t", schema="filename string, text string", quote="")


def export_mixtures(mixtures: DataFrame, n: int | None = None, indices: list[int] | None = None, seed: int | None = None) -> DataFrame:
    """file, x: '<idx>_speech.wav' and '<idx>_noisy.wav' of the given, the first n or n drawn mixtures (idx, speech, noisy)."""
    if indices is not None:
        chosen = mixtures.where(F.col("idx").isin(indices))
    elif n is not None:
        chosen = mixtures.orderBy(*([draws.bits(seed, F.col("idx"), "export")] if seed is not None else []), "idx").limit(n)
    else:
        chosen = mixtures
    return chosen.select(F.expr("stack(2, concat(idx, '_speech.wav'), speech, concat(idx, '_noisy.wav'), noisy) as (file, x)"))
