"""Time-domain quality measures made of column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waveloom.functions import signal as S


def segmental_si_sdr(clean, estimate, windows: list[int], overlap: float = 0.0) -> Column:
    """Sum over window sizes of the mean SI-SDR of the windows; a window longer than the signal is the signal."""
    out = F.lit(0.0)
    for w in windows:
        hop = int((1 - overlap) * w)
        c, e = S.frames(clean, w, hop), S.frames(estimate, w, hop)
        out = out + S.mean(F.zip_with(c, e, lambda a, b: S.si_sdr(a, b)))
    return out
