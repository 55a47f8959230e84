"""Signals and frames of any length in chunk rows, so that no row, group or window holds a whole clip.

A signal is rows (clip_id, ch, start, x) of `size` samples each but for the last. What a chunk needs of its neighbours, they hand over: `with_halo`
for samples, `overlapping` for frames. Running means are scanned chunk by chunk from zero; what each chunk hands on, (decay, partial), is
combined over chunks and added with its decay: s[t] = local[t] + decay^(k + 1) * carry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom._np import spectra as N
from waveloom.functions import signal as S
from waveloom.sources.paths import save

from .ranks import sorted_ranks

OF_CLIP = ("clip_id", "ch")
#: Samples and frames of a chunk, and chunks whose sums are combined in one group.
SAMPLES, FRAMES, FAN = 1 << 16, 512, 4096


def cut(clips: DataFrame, size: int = SAMPLES, column: str = "x") -> DataFrame:
    """clip_id, ch, start, x: clips (clip_id, a column of samples of one channel) in chunks. Empty and null clips have none."""
    starts = F.sequence(F.lit(0).cast("long"), (F.size(column) - 1).cast("long"), F.lit(size).cast("long"))
    some = clips.where(F.size(column) > 0).select("clip_id", F.lit(0).alias("ch"), F.explode(starts).alias("start"), F.col(column).alias("_x"))
    return some.select(*OF_CLIP, "start", F.slice("_x", (F.col("start") + 1).cast("int"), F.lit(size)).alias("x"))


def gather(samples: DataFrame, order: list[str], size: int = SAMPLES) -> DataFrame:
    """The same from rows of single samples (clip_id, v and the columns that order them): ranks come from counted ranges, and only the
    samples of a chunk meet."""
    ranked = sorted_ranks(samples, "clip_id", order).withColumn("start", F.floor(F.col("_r") / size) * size)
    return ranked.groupBy("clip_id", F.lit(0).alias("ch"), "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "v"))), lambda s: s["v"]).alias("x"))


def with_halo(chunks: DataFrame, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """chunks with left and right: the `before` samples before and `after` samples behind each, fewer at the ends of a clip. Chunks but the
    last of a clip have `size` samples. One shuffle; a chunk sends the samples asked for and nothing else."""
    parts = [F.struct(F.col("start").alias("to"), F.lit(0).alias("k"), F.col("x").alias("x"))]
    for k in range(1, -(-before // size) + 1):  # the last samples, for chunks behind
        n = min(size, before - (k - 1) * size)
        parts.append(F.struct((F.col("start") + k * size).alias("to"), F.lit(-k).alias("k"), F.slice("x", F.greatest(F.size("x") - n, F.lit(0)) + 1, F.lit(n)).alias("x")))
    for k in range(1, -(-after // size) + 1):  # the first ones, for chunks before
        n = min(size, after - (k - 1) * size)
        parts.append(F.struct((F.col("start") - k * size).alias("to"), F.lit(k).alias("k"), F.slice("x", F.lit(1), F.lit(n)).alias("x")))
    sent = chunks.select(*OF_CLIP, F.explode(F.array(*parts)).alias("p")).where("p.to >= 0")
    met = sent.groupBy(*OF_CLIP, F.col("p.to").alias("start")).agg(F.array_sort(F.collect_list(F.struct("p.k", "p.x"))).alias("_p"))
    side = lambda keep: F.flatten(F.transform(F.filter("_p", lambda s: keep(s["k"])), lambda s: s["x"]))
    own = met.where(F.exists("_p", lambda s: s["k"] == 0))  # none at a place past the end
    return own.select(*OF_CLIP, "start", side(lambda k: k == 0).alias("x"), side(lambda k: k < 0).alias("left"), side(lambda k: k > 0).alias("right"))


def frame_signal(chunks: DataFrame, window: int, hop: int, size: int = SAMPLES) -> DataFrame:
    """clip_id, ch, t, w: full windows, floor((n - window + hop) / hop) of them for a clip of n samples."""
    rows = with_halo(chunks, size, after=window - 1).withColumn("_y", F.concat("x", "right"))
    first = F.ceil(F.col("start") / hop)
    last = F.floor((F.col("start") + F.least(F.size("x") - 1, F.size("_y") - window)) / hop)  # starts here and ends within what is there
    rows = rows.withColumns({"_a": first, "_z": last}).where("_a <= _z and size(_y) >= " + str(window))
    at = rows.select(*OF_CLIP, F.explode(F.transform(F.sequence("_a", "_z"), lambda t: F.struct(t.alias("t"), F.slice(F.col("_y"), (t * hop - F.col("start") + 1).cast("int"), F.lit(window)).alias("w")))).alias("f"))
    return at.select(*OF_CLIP, F.col("f.t").alias("t"), F.col("f.w").alias("w"))


#: Numbers that are worked on at once.
PIECE = 1 << 21


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of arrays of numbers; null numbers are NaN, null arrays empty."""
    sizes = np.array([0, *lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
    return np.cumsum(sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(float)


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * width), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Arrays of equally many numbers as rows."""
    return _numbers(lists)[1].reshape(-1, width)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _pieces(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with PIECE numbers each, about, and one row at least."""
    group = np.cumsum(sizes) // PIECE
    ends = [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)] if len(sizes) else []
    return list(zip([0, *ends[:-1]], ends))


def _groups(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where rows with other keys than the row before begin, in sorted rows; 0 is first."""
    new = np.arange(batch.num_rows) == 0
    for k in keys:
        codes = pd.factorize(batch.column(k).to_pandas(), use_na_sentinel=False)[0]
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _scan(x: np.ndarray, factor: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """s[i] = x[i] + factor[i] * s[i - 1] inside of groups that begin at starts, all of them side by side; `first` stands before the first
    row, zeros before the other groups."""
    sizes = np.diff([*starts, len(x)])
    order = np.argsort(-sizes, kind="stable")
    counts = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), side="right") if len(sizes) else []
    out, s = np.empty_like(x), np.zeros((len(starts), x.shape[1]))
    s[0] = first
    s = s[order]
    for k, n in enumerate(counts):  # the groups of more than k rows
        at = starts[order[:n]] + k
        s = x[at] + s[:n] * factor[at, None]
        out[at] = s
    return out


def stft(chunks: DataFrame, fft: int, hop: int, size: int = SAMPLES) -> DataFrame:
    """clip_id, ch, t, re, im: frames of spectral.stft; size is a multiple of hop, and each chunk takes fft - hop samples from before."""
    if size % hop:
        raise ValueError("the size of a chunk must be a multiple of the hop")
    keys = "clip_id " + chunks.schema["clip_id"].dataType.simpleString()

    before = fft - hop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(_numbers(batch.column("x"))[0]) // hop
            for a, b in _pieces(sizes * fft):  # chunks of many clips at once
                part = batch.slice(a, b - a)
                n, (at, x), (lent, left) = sizes[a:b], _numbers(part.column("x")), _numbers(part.column("left"))
                base = np.cumsum(before + n * hop) - n * hop  # of the first own sample of each chunk, behind zeros and the samples before
                y = np.zeros(int((before + n * hop).sum()))
                y[np.repeat(base - np.diff(lent), np.diff(lent)) + _within(np.diff(lent))] = left
                k = _within(np.diff(at))
                whole = k < np.repeat(n * hop, np.diff(at))
                y[(np.repeat(base, np.diff(at)) + k)[whole]] = x[whole]
                t = _within(n)
                if len(t):
                    s = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, fft)[np.repeat(base - before, n) + t * hop] * N.window(fft), axis=1) / (fft**2 / (2 * hop))
                    rows = pa.array(np.repeat(np.arange(b - a), n))
                    first = part.column("start").to_numpy() // hop
                    yield pa.RecordBatch.from_arrays([part.column("clip_id").take(rows), part.column("ch").take(rows), pa.array(np.repeat(first, n) + t), _lists(s.real), _lists(s.imag)], ["clip_id", "ch", "t", "re", "im"])

    return with_halo(chunks, size, before=before).select(*OF_CLIP, "start", "x", "left").mapInArrow(run, f"{keys}, ch int, t long, re array<double>, im array<double>")


def istft(frames: DataFrame, fft: int, hop: int, size: int = SAMPLES) -> DataFrame:
    """clip_id, ch, start, x: the chunks of spectral.istft. Overlap-add is a sum by block of hop samples, of fft / hop frames each."""
    if size % hop:
        raise ValueError("the size of a chunk must be a multiple of the hop")
    keys, over = "clip_id " + frames.schema["clip_id"].dataType.simpleString(), fft // hop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                f = np.fft.irfft(np.stack(pdf["re"].to_list()) + 1j * np.stack(pdf["im"].to_list()), fft, axis=1) * fft * N.window(fft)
                k = np.tile(np.arange(over), len(pdf))
                rep = lambda c: np.repeat(pdf[c].to_numpy(), over)  # noqa: B023, E731
                yield pd.DataFrame({"clip_id": rep("clip_id"), "ch": rep("ch"), "b": rep("t") + k, "k": k, "y": list(f.reshape(-1, hop))})

    blocks = frames.select(*OF_CLIP, "t", "re", "im").mapInPandas(run, f"{keys}, ch int, b long, k int, y array<double>")
    whole = blocks.groupBy(*OF_CLIP, "b").agg(F.array_sort(F.collect_list(F.struct("k", "y"))).alias("p"))
    zero = F.array_repeat(F.lit(0.0), hop)
    # a block behind the last frame holds only tails (k > 0), and is not part of the signal
    whole = whole.where(F.get("p", F.lit(0))["k"] == 0).select(*OF_CLIP, "b", F.aggregate("p", zero, lambda a, s: F.zip_with(a, s["y"], lambda u, v: u + v)).alias("y"))
    rows = whole.groupBy(*OF_CLIP, (F.floor(F.col("b") * hop / size) * size).alias("start")).agg(F.array_sort(F.collect_list(F.struct("b", "y"))).alias("p"))
    return rows.select(*OF_CLIP, "start", F.flatten(F.transform("p", lambda s: s["y"])).alias("x"))


def overlapping(frames: DataFrame, before: int, after: int, size: int | None = None) -> tuple[DataFrame, W]:
    """frames with _c, a chunk, and _lent: frames near the edge of a chunk are also lent to its neighbour, so that windows over (clip_id, ch,
    _c), which is the second thing returned, see `before` frames back and `after` ahead. Frames of a clip are numbered without gaps."""
    size = max(size or FRAMES, before, after, 1)
    own, at = F.floor(F.col("t") / size), F.col("t") % size
    lent = F.filter(F.array(own, F.when(at >= size - before, own + 1) if before else F.lit(None).cast("long"), F.when(at < after, own - 1) if after else F.lit(None).cast("long")), lambda c: c.isNotNull())
    rows = frames.withColumn("_c", F.explode(lent)).withColumn("_lent", F.col("_c") != own)
    return rows, W.partitionBy(*OF_CLIP, "_c").orderBy("t")


def own(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("_lent")).drop("_c", "_lent")


def carried(sums: DataFrame, start: list[float], alpha: float) -> DataFrame:
    """clip_id, ch, c, carry: the running value before each chunk. sums: clip_id, ch, c, n (frames), part (the value the chunk alone ends
    with, from zero). Chunks are combined in groups of FAN, groups of groups above them: the operation is associative."""
    width = len(start)
    groups = sums.withColumn("g", F.floor(F.col("c") / FAN))
    lone = sums.agg(F.max("c")).first()[0]
    schema = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in OF_CLIP)
    keys = [*OF_CLIP, "g"]

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the chunks of a group, in order: what those up to each hand on, as (frames, value from zero)."""
        last, n, s = None, 0, np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                starts = _groups(batch, keys)
                ends = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, -1)]
                going = last == ends[0]
                k = batch.column("n").to_numpy().astype("int64")
                total = np.cumsum(k)
                group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(k)]))
                total = total - (total - k)[starts][group] + np.where(group == 0, n if going else 0, 0)
                done = _scan(_matrix(batch.column("part"), width), alpha ** k.astype(float), starts, s if going else np.zeros(width))
                last, n, s = ends[1], int(total[-1]), done[-1]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "c")], pa.array(total), _lists(done)], [*keys, "c", "n", "part"])

    dealt = groups.select(*keys, "c", "n", "part").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "c")
    upto = save(dealt.mapInArrow(prefix, f"{schema}, g long, c long, n long, part array<double>"), "carries")
    # what stands before a chunk is what the one before it in the group hands on; nothing before the first
    before = W.partitionBy(*keys).orderBy("c")
    zero = F.array(*[F.lit(0.0)] * width)
    within = upto.select(*keys, "c", F.coalesce(F.lag("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.lag("part").over(before), zero).alias("part"))
    first = F.array(*[F.lit(float(v)) for v in start])
    base = None
    if lone is not None and lone >= FAN:
        ends = upto.groupBy(*keys).agg(F.max_by(F.struct("n", "part"), "c").alias("e"))
        base = carried(ends.select(*OF_CLIP, F.col("g").alias("c"), "e.n", "e.part"), start, alpha).withColumnRenamed("c", "g")
    rows = within.withColumn("carry", first) if base is None else within.join(base, keys)
    decay = F.pow(F.lit(alpha), F.col("n").cast("double"))
    return rows.select(*OF_CLIP, "c", F.zip_with("part", "carry", lambda p, s: p + decay * s).alias("carry"))


def ema(frames: DataFrame, columns: dict[str, tuple[str, list[float]]], alpha: float, size: int | None = None) -> DataFrame:
    """frames with running means s[t] = x[t] * (1 - alpha) + s[t - 1] * alpha of array columns: {column: (name of the mean, s before the
    first frame)}. Frames are taken in the order of t inside chunks of `size` numbers; a clip may span any number of tasks."""
    names = list(columns)
    rows = frames.withColumn("_c", F.floor(F.col("t") / (size or FRAMES)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _k long, " + ", ".join(f"_s{i} array<double>" for i in range(len(names)))
    keys, widths = [*OF_CLIP, "_c"], [len(columns[c][1]) for c in names]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of chunks and frames; a chunk may go on in the next batch."""
        last, n, s = None, 0, [np.zeros(w) for w in widths]
        for batch in batches:
            if batch.num_rows:
                starts = _groups(batch, keys)
                ends = [tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, -1)]
                going = last == ends[0]
                k = _within(np.diff([*starts, batch.num_rows])) + 1
                if going:
                    k[: [*starts, len(k)][1]] += n
                done = [_scan(_matrix(batch.column(c), w) * (1 - alpha), np.full(len(k), alpha), starts, v if going else np.zeros(w)) for c, w, v in zip(names, widths, s)]
                last, n, s = ends[1], int(k[-1]), [d[-1] for d in done]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k), *map(_lists, done)], [*batch.schema.names, "_k", *(f"_s{i}" for i in range(len(names)))])

    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "t")
    done = save(dealt.mapInArrow(local, schema), "scanned")
    ends = done.groupBy(*OF_CLIP, F.col("_c").alias("c")).agg(F.max("_k").alias("n"), F.max_by(F.concat(*[F.col(f"_s{i}") for i in range(len(names))]), "_k").alias("part"))
    carry = carried(ends, [float(v) for c in names for v in columns[c][1]], alpha).withColumnsRenamed({"c": "_c", "carry": "_carry"})
    out = done.join(carry, [*OF_CLIP, "_c"])
    decay, at = F.pow(F.lit(alpha), F.col("_k").cast("double")), 1
    for i, c in enumerate(names):
        name, start = columns[c]
        out = out.withColumn(name, F.zip_with(f"_s{i}", F.slice("_carry", at, len(start)), lambda s, v: s + decay * v))
        at += len(start)
    return out.drop("_c", "_k", "_carry", *[f"_s{i}" for i in range(len(names))])


def features(chunks: DataFrame, fft: int, hop: int, widths: list[int], nb_df: int, alpha: float, size: int = SAMPLES) -> DataFrame:
    """clip_id, ch, t, feat_erb (normalised band levels), re and im (normalised first bins) of chunk rows."""
    bands, at = [], 1
    for w in widths:
        bands.append(S.power_db(S.total(F.zip_with(F.slice("re", at, w), F.slice("im", at, w), lambda a, b: a * a + b * b)) / w))
        at += w
    cut_off = {c: F.slice(c, 1, nb_df) for c in ("re", "im")}
    rows = stft(chunks, fft, hop, size).withColumn("_e", F.array(*bands)).withColumns(cut_off).withColumn("_m", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)))
    n = min(nb_df, fft // 2 + 1)
    done = ema(rows, {"_e": ("_mean", N.mean_norm_start(len(widths)).tolist()), "_m": ("_unit", N.unit_norm_start(n).tolist())}, alpha)
    unit = lambda c: F.zip_with(c, "_unit", lambda v, s: v / F.sqrt(s))
    return done.select(*OF_CLIP, "t", F.zip_with("_e", "_mean", lambda v, s: (v - s) / 40).alias("feat_erb"), unit("re").alias("re"), unit("im").alias("im"))
