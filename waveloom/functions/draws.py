"""Reproducible draws: hashes of (seed, index, slot), the same in every partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bits(seed, idx, slot) -> Column:
    """48 bits of the md5 of 'seed:idx:slot', as a long."""
    text = F.concat_ws(":", *[_c(x).cast("string") for x in (seed, idx, slot)])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def uniform(seed, idx, slot) -> Column:
    """A number in [0, 1)."""
    return bits(seed, idx, slot) / F.lit(float(1 << 48))


def below(n, seed, idx, slot) -> Column:
    """An integer in [0, n)."""
    return bits(seed, idx, slot) % _c(n)


def choice(values: list, seed, idx, slot) -> Column:
    """One of the values, all with the same chance."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (below(len(values), seed, idx, slot) + 1).cast("int"))
