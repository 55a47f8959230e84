"""All queries over the given tables, gathered from the modules of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, score_queries, signal_queries, spectral_queries, stream_queries, synthesis_queries  # noqa: F401
from .adapters import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["sdr_by_snr"](spark, sf_dir)
