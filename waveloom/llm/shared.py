"""Tables that a job writes and reads again, in the folder all executors share."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import delete_folder

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, as in tests, one of our own, but only with a
    local master: on a cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.conf.get("spark.master", "").partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: lineage ends there, and a lost
    executor costs a rerun of the readers alone."""
    return _saved(df, new_path(df.sparkSession, name))


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one job alone reads: saved in one folder, deleted together when its result is written. In a store that
    only Spark reaches they are left to the cluster's cleanup."""

    def __init__(self, spark: SparkSession, name: str):
        self.path, self.n = new_path(spark, name), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _saved(df, f"{self.path}/{self.n}-{name}")

    def drop(self) -> None:
        if self.n:
            with contextlib.suppress(OSError, ValueError, NotImplementedError):
                delete_folder(self.path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """For mapInArrow: when a task has ended, memory it has freed goes back to the system. Python workers are
    reused, and would otherwise hold what their largest task needed for as long as the application runs."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)
