"""Table functions for SQL with a lateral join: a clip in, its frames out.

    tables.register(spark)
    spark.sql("select clip_id, t, w from clips, lateral clip_frames(x, 512, 256)")
    spark.sql("select clip_id, t, re, im from clips, lateral clip_spectrum(x, 960, 480)")
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, NumericType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from waveloom._np import spectra as N

_NUMBERS = ArrayType(DoubleType())


def _checked(x: AnalyzeArgument, size: AnalyzeArgument, hop: AnalyzeArgument) -> None:
    if not isinstance(x.dataType, ArrayType) or not isinstance(x.dataType.elementType, NumericType):
        raise ValueError(f"the first argument is an array of samples, not {x.dataType.simpleString()}")
    for name, a in (("size", size), ("hop", hop)):
        if not a.isConstantExpression or a.value is None or a.value < 1:
            raise ValueError(f"the {name} is a constant of at least 1")


@udtf
class ClipFrames:
    """t, w: full windows of `size` samples every `hop`. A null or short clip has none."""

    @staticmethod
    def analyze(x: AnalyzeArgument, size: AnalyzeArgument, hop: AnalyzeArgument) -> AnalyzeResult:
        _checked(x, size, hop)
        return AnalyzeResult(StructType().add("t", LongType()).add("w", _NUMBERS))

    def eval(self, x, size: int, hop: int) -> Iterator[tuple]:
        for t, start in enumerate(range(0, len(x or ()) - size + 1, hop)):
            yield t, [float(v) for v in x[start : start + size]]


@udtf
class ClipSpectrum:
    """t, re, im: the frames of spectral.stft. A null clip, or one shorter than a hop, has none."""

    @staticmethod
    def analyze(x: AnalyzeArgument, fft: AnalyzeArgument, hop: AnalyzeArgument) -> AnalyzeResult:
        _checked(x, fft, hop)
        if fft.value % hop.value:
            raise ValueError("the size of the transform is a multiple of the hop")
        return AnalyzeResult(StructType().add("t", LongType()).add("re", _NUMBERS).add("im", _NUMBERS))

    def eval(self, x, fft: int, hop: int) -> Iterator[tuple]:
        for t, s in enumerate(N.stft(np.asarray(x if x is not None else [], float), fft, hop)):
            yield t, s.real.tolist(), s.imag.tolist()


def register(spark: SparkSession) -> None:
    spark.udtf.register("clip_frames", ClipFrames)
    spark.udtf.register("clip_spectrum", ClipSpectrum)
