"""Places that all executors share, and files there."""

from __future__ import annotations

import tempfile
import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, as in tests, one of our own, but only with a local master: on
    a cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.conf.get("spark.master", "").partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found and "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return (found or _OWN["dir"]).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_write(uri: str) -> BinaryIO:
    """A new file in any file system that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)
