"""WAV files as a Spark data source: read in byte ranges, written with a commit.

    spark.dataSource.register(WavSource)
    spark.read.format("wav_chunks").option("path", p).load()               chunk rows of all files
    spark.read.format("wav_chunks").option("header", "true").load(p)       headers alone, with file time and length
    df.write.format("wav_chunks").mode("append").save(p)                   files that appear all together or not at all

Reading never holds a file: a partition is a list of byte ranges, a task reads the header of each file and then the bytes of its own chunks.
Writing puts files under `_staging`; the driver moves them to their places when all tasks have succeeded and writes a manifest last. Files of
failed attempts are in no message of a task that counts, and go with the staging folder.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from waveloom._np import audio

HEADER = "file string, length long, modified timestamp, sr int, n_channels int, n_samples long"
CHUNK = HEADER + ", start long, samples array<array<float>>"
#: Bytes of a partition and samples of a chunk row, unless options say otherwise; files of a partition that reads headers.
PARTITION_BYTES, CHUNK_SAMPLES, HEADERS = 64 << 20, 1 << 16, 256


@dataclass
class Header:
    sr: int
    channels: int
    dtype: str  # of a sample in the file
    at: int  # of the first sample
    n: int  # samples of each channel

    @property
    def step(self) -> int:
        return self.channels * np.dtype(self.dtype).itemsize


def read_header(f: BinaryIO, size: int) -> Header:
    """From the chunks of a RIFF file up to its data, whose samples are not read. Data cut short ends with the file."""
    if (head := f.read(12))[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, channels, sr, bits = 12, None, 0, 0, 0
    while at + 8 <= size:
        f.seek(at)
        name, n = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            body = f.read(min(n, 40))
            kind, channels, sr, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            kind = struct.unpack("<H", body[24:26])[0] if kind == 0xFFFE else kind
        elif name == b"data":
            dtype = {(1, 16): "<i2", (3, 32): "<f4"}.get((kind, bits))
            if dtype is None:
                raise ValueError(f"WAV format {kind} with {bits} bits is not read")
            out = Header(sr, channels, dtype, at + 8, 0)
            out.n = min(n, size - at - 8) // out.step
            return out
        at += 8 + n + n % 2
    raise ValueError("WAV file without data")


def read_samples(f: BinaryIO, h: Header, start: int, stop: int) -> np.ndarray:
    """Samples [start, stop) of all channels, channel-first; no other bytes are read."""
    f.seek(h.at + start * h.step)
    x = np.frombuffer(f.read((stop - start) * h.step), h.dtype).reshape(-1, h.channels).T
    return x.astype(np.float32) / np.float32(32767) if h.dtype == "<i2" else x.astype(np.float32)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:]) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_wavs(path: str) -> list[tuple[str, int, datetime.datetime]]:
    """Files *.wav under a folder (or one file) with length and time; names that start with _ or . are not looked into."""
    store, root = store_of(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inside = lambda p: p[len(root) :].lstrip("/").split("/")
    keep = [x for x in found if x.is_file and x.path.lower().endswith(".wav") and (x is info or not any(p[:1] in "_." for p in inside(x.path)))]
    return sorted((x.path, x.size, x.mtime) for x in keep)


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, length, time, from, to) of files; a chunk belongs to the range its first byte is in."""

    parts: list = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class WavReader(DataSourceReader):
    def __init__(self, options: dict, header_only: bool):
        get = lambda k, d: int(options.get(k.lower(), d))  # noqa: E731  Spark gives them in lower case
        self.path, self.header_only = options["path"], header_only
        self.chunk, self.partition = get("chunk", CHUNK_SAMPLES), get("partitionBytes", PARTITION_BYTES)
        self.start, self.stop = get("start", 0), get("stop", -1)
        self.files, self.low, self.high = None, 0, None  # pushed filters: names, and least and greatest start of a chunk

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file",):
                self.files = {f.value} if self.files is None else self.files & {f.value}
            elif isinstance(f, In) and f.attribute == ("file",):
                self.files = set(f.value) if self.files is None else self.files & set(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("start",):
                self.low, self.high = max(self.low, f.value), min(f.value, f.value if self.high is None else self.high)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("start",):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = [x for x in list_wavs(self.path) if self.files is None or x[0] in self.files]
        if self.header_only:
            return [Ranges([(*x, 0, x[1]) for x in files[i : i + HEADERS]]) for i in range(0, len(files), HEADERS)]
        out, held, room = [], [], self.partition
        for path, size, time in files:
            at = 0
            while at < size:
                take = min(size - at, room)
                held.append((path, size, time, at, at + take))
                at, room = at + take, room - take
                if room <= 0:
                    out.append(Ranges(held))
                    held, room = [], self.partition
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, size, time, lo, hi in partition.parts:
            with store_of(self.path)[0].open_input_file(path) as f:
                h = read_header(f, size)
                base = [pa.array([path]), pa.array([size], pa.int64()), pa.array([time], pa.timestamp("us", "UTC")), pa.array([h.sr], pa.int32()), pa.array([h.channels], pa.int32()), pa.array([h.n], pa.int64())]
                names = [c.strip().split(" ")[0] for c in HEADER.split(",")]
                if self.header_only:
                    yield pa.RecordBatch.from_arrays(base, names=names)
                    continue
                if self.stop > h.n:
                    raise ValueError(f"{path} has {h.n} samples, not {self.stop}")
                end = self.stop if self.stop >= 0 else h.n
                # chunks start at multiples of `chunk` behind the first asked sample, wherever partitions are cut
                first = max(0, -(-(lo - h.at - self.start * h.step) // (self.chunk * h.step)))
                at = self.start + first * self.chunk
                while at < end and h.at + at * h.step < hi:
                    if at >= self.low and (self.high is None or at <= self.high):
                        x = read_samples(f, h, at, min(end, at + self.chunk))
                        samples = pa.array([[c for c in x]], pa.list_(pa.list_(pa.float32())))
                        yield pa.RecordBatch.from_arrays([*base, pa.array([at], pa.int64()), samples], names=[*names, "start", "samples"])
                    at += self.chunk


@dataclass
class Written(WriterCommitMessage):
    files: list  # (staged, name, bytes, samples, rate)


class WavWriter(DataSourceArrowWriter):
    """Rows file, sr, samples (channel-first) as 16-bit files named as the last part of `file`."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{store_of(self.path)[1]}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, out = store_of(self.path)[0], []
        store.create_dir(self.staging, recursive=True)
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("file", "sr", "samples")}
                name = row["file"].as_py().rstrip("/").rsplit("/", 1)[-1]
                x = [np.asarray(c.values, float) for c in row["samples"]] if row["samples"].is_valid else []
                data = audio.encode_wav(np.stack(x) if x else np.zeros((1, 0)), int(row["sr"].as_py()))
                staged = f"{self.staging}/{uuid.uuid4().hex}"
                with store.open_output_stream(staged, compression=None) as f:
                    f.write(data)
                out.append((staged, name, len(data), len(x[0]) if x else 0, int(row["sr"].as_py())))
        return Written(out)

    def commit(self, messages: list) -> None:
        store, root = store_of(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [f[1] for f in files]
        if len(set(names)) < len(names):
            self._drop()
            raise ValueError(f"several clips are named {next(n for n in names if names.count(n) > 1)}")
        if self.overwrite:
            for old, _, _ in list_wavs(self.path):
                store.delete_file(old)
        for staged, name, *_ in files:
            store.move(staged, f"{root}/{name}")
        store.create_dir(f"{root}/_manifest", recursive=True)
        with store.open_output_stream(f"{root}/_manifest/{self.job}.json", compression=None) as f:
            f.write("".join(json.dumps({"file": n, "uri": f"{self.path}/{n}", "bytes": b, "n_samples": k, "sr": sr}) + "\n" for _, n, b, k, sr in files).encode())
        self._drop()

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        store = store_of(self.path)[0]
        if store.get_file_info(self.staging).type == fs.FileType.Directory:
            store.delete_dir(self.staging)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    @property
    def _header(self) -> bool:
        return self.options.get("header", "false").lower() == "true"

    def schema(self) -> str:
        return HEADER if self._header else CHUNK

    def reader(self, schema: StructType) -> DataSourceReader:
        return WavReader(dict(self.options), self._header)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WavWriter(self.options["path"], overwrite)


def _source(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader with pushFilters needs it


def read_wav_chunks(spark: SparkSession, path: str, chunk: int = CHUNK_SAMPLES, start: int = 0, stop: int | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """file, length, modified, sr, n_channels, n_samples, start, samples: rows of at most `chunk` samples of each channel, from sample
    `start` up to `stop` (None: the end; past the end of a file it is an error). Conditions on file and start skip files and bytes."""
    _source(spark)
    options = {"chunk": chunk, "start": start, "partitionBytes": partition_bytes} | ({} if stop is None else {"stop": stop})
    return spark.read.format("wav_chunks").options(**options).load(path)


def read_wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, length in bytes, modified, sr, n_channels, n_samples: for inventories, audits and manifests; no sample is read."""
    _source(spark)
    return spark.read.format("wav_chunks").option("header", "true").load(path)


def write_wavs(clips: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes clips (file, sr, samples channel-first; one row a file) as 16-bit WAV files right under `path`, all of them or none, and returns
    the manifest: file, uri, bytes, n_samples, sr. A null or empty clip is a file without samples; two clips of one name are an error."""
    spark = clips.sparkSession
    _source(spark)
    before = {x.path for x in _manifests(path)}
    clips.select("file", "sr", "samples").write.format("wav_chunks").mode("overwrite" if overwrite else "append").save(path)
    new = [x.path for x in _manifests(path) if x.path not in before]
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else "file://" if "://" in path else ""
    return spark.read.schema("file string, uri string, bytes long, n_samples long, sr int").json([scheme + p for p in new])


def _manifests(path: str) -> list:
    store, root = store_of(path)
    return [x for x in store.get_file_info(fs.FileSelector(f"{root}/_manifest", allow_not_found=True)) if x.is_file]
