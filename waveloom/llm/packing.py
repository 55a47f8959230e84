"""Token-id files with fixed-width bit packing.

Layout of a file (numbers little-endian): 8 bytes of magic, then blocks. A block holds up to BLOCK ids of
`bits` bits each, the lowest bit first and without gaps, filled up to a whole byte. Then, as arrays
of 64-bit numbers: the byte offset of each block, the number of ids before each document (and after
the last), the document ids, and one byte for each document id that is null. A tail of 40 bytes
gives ids, documents, blocks, bits and the place of the arrays, so any id or document can be read
with two seeks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoder
from .files import open_read, open_write
from .shared import new_path, save, table, worker
from .textbytes import slices

MAGIC = b"FWIDS\x01\0\0"
BLOCK = 1 << 16
#: Text bytes of a shard, about: SHARD_BYTES, or in tables of more than MANY such shards up to MOST_BYTES. A table of few
#: bytes is still dealt to all cores, down to LEAST_BYTES for each.
SHARD_BYTES, MOST_BYTES, LEAST_BYTES, MANY = 16 << 20, 256 << 20, 1 << 20, 10_000


def bits_for(n_vocabulary: int) -> int:
    """The least width that holds ids 0 to n_vocabulary - 1."""
    return max(1, int(n_vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8]).tobytes()
    each = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed block."""
    at = np.arange(start, stop, dtype=np.int64) * bits
    buf = np.frombuffer(data + b"\0" * 8, np.uint8)
    first, shift = at >> 3, (at & 7).astype(np.uint64)
    out = np.zeros(len(at), np.uint64)
    for k in range((bits + 14) // 8):
        out |= buf[first + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Holds one block and the document index of its file; ids go out block by block."""

    def __init__(self, uri: str, bits: int):
        self.uri, self.bits, self.out = uri, bits, open_write(uri)
        self.out.write(MAGIC)
        self.place, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.blocks: list[int] = []
        self.starts, self.docs = [np.zeros(1, np.int64)], []
        self.n_ids = 0

    def add(self, ids: np.ndarray, counts: np.ndarray, docs: pa.Array) -> None:
        self.starts.append(self.n_ids + np.cumsum(counts))
        self.docs.append(docs)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            data = pack(ids[i : min(i + BLOCK, full)], self.bits)
            self.blocks.append(self.place)
            self.out.write(data)
            self.place += len(data)
        self.waiting, self.n_waiting = [ids[full:]], len(ids) - full

    def close(self) -> tuple[str, int, int]:
        self._flush(True)
        docs = pa.chunked_array(self.docs, pa.int64()).combine_chunks() if self.docs else pa.array([], pa.int64())
        for x in (np.array(self.blocks, "<i8"), np.concatenate(self.starts).astype("<i8"), docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), docs.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)):
            self.out.write(x.tobytes())
        self.out.write(np.array([self.n_ids, len(docs), len(self.blocks), self.bits, self.place], "<i8").tobytes())
        self.out.close()
        return self.uri, self.n_ids, len(docs)


class Reader:
    """Random access to a file: ids(start, stop), or runs of documents with their ids."""

    def __init__(self, uri: str):
        self.f = open_read(uri)
        self.f.seek(self.f.size() - 40)
        self.n_ids, self.n_docs, n_blocks, self.bits, at = np.frombuffer(self.f.read(40), "<i8").tolist()
        self.f.seek(0)
        if self.f.read(8) != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        self.f.seek(at)
        self.blocks = np.append(np.frombuffer(self.f.read(8 * n_blocks), "<i8"), at)
        self.starts = np.frombuffer(self.f.read(8 * (self.n_docs + 1)), "<i8")
        docs = np.frombuffer(self.f.read(8 * self.n_docs), "<i8")
        self.docs = pa.array(docs, mask=np.frombuffer(self.f.read(self.n_docs), np.uint8).astype(bool))

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts = []
        for b in range(start // BLOCK, -(-stop // BLOCK)):
            self.f.seek(int(self.blocks[b]))
            data = self.f.read(int(self.blocks[b + 1] - self.blocks[b]))
            parts.append(unpack(data, self.bits, max(start - b * BLOCK, 0), min(stop - b * BLOCK, BLOCK)))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def runs(self, limit: int = 8 * BLOCK) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of documents of about `limit` ids: first document, one past the last, their ids."""
        at = 0
        while at < self.n_docs:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + limit, side="right")) - 1)
            yield at, to, self.ids(int(self.starts[at]), int(self.starts[to]))
            at = to

    def close(self) -> None:
        self.f.close()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode whole texts, append end_id to each and write the ids to files under `path` in ascending doc_id order.

    Returns the manifest: shard, part, uri, n_ids, n_docs, one row per file; files in the order of (shard, part)
    hold the documents in order, null ids first, equal ids in any order. A null or empty text gives
    end_id alone; an empty table no files. Only doc_id, a number, and text are read. Shards are ranges of (doc_id, hash
    of the text, row number), as many as the bytes of all texts ask for (or `shards`), so one id may fill
    several of them. A shard too large for one file of 2^28 ids goes on in further parts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = shards
    if n is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, min(-(-size // SHARD_BYTES), MANY), -(-size // MOST_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    turn = docs.withColumn("h", F.xxhash64("text")).withColumn("turn", F.monotonically_increasing_id())
    dealt = turn.repartitionByRange(n, F.asc_nulls_first("doc_id"), "h", "turn").withColumn("shard", F.spark_partition_id()).sortWithinPartitions("doc_id").select("doc_id", "text", "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits = bits_for(max(enc.n_vocabulary, end_id + 1))
        now, part, out, done = None, 0, None, []
        for b in batches:
            for run in slices(b, "text"):
                shard = run.column("shard").to_numpy()
                for s in np.unique(shard):
                    lo, hi = np.searchsorted(shard, s), np.searchsorted(shard, s, side="right")
                    rows = run.slice(int(lo), int(hi - lo))
                    if out is not None and (s != now or out.n_ids >= 1 << 28):
                        done.append((now, part, *out.close()))
                        part, out = (part + 1, None) if s == now else (0, None)
                    if out is None:
                        now, out = int(s), Writer(f"{path}/{uuid.uuid4().hex}.ids", bits)
                    ids, counts = enc.encode(rows.column("text"))
                    ends = np.cumsum(counts + 1) - 1
                    full = np.full(len(ids) + len(counts), end_id, np.int64)
                    is_text = np.ones(len(full), bool)
                    is_text[ends] = False
                    full[is_text] = ids
                    out.add(full, counts + 1, rows.column("doc_id"))
        if out is not None:
            done.append((now, part, *out.close()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "part", "uri", "n_ids", "n_docs"])

    return save(dealt.mapInArrow(worker(write), "shard int, part int, uri string, n_ids long, n_docs long"), "id-manifest")


def read_ids(manifest: DataFrame, digest: bool = True) -> DataFrame:
    """One row per document from the files of a manifest: doc_id, start (ids of all documents before
    it), n_tokens (its end id included), and ids_crc32 of its ids as little-endian unsigned 32-bit
    numbers, or with digest=False the ids themselves."""
    before = F.coalesce(F.sum("n_ids").over(W.partitionBy(F.lit(0)).orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)  # one row for each file: 400,000 of them for 100 TB
    files = files.select("uri", "before").repartition(max(1, manifest.count()), "uri")
    last = "ids_crc32 long" if digest else "ids array<int>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(b.column("uri").to_pylist(), b.column("before").to_pylist()):
                f = Reader(uri)
                for lo, hi, ids in f.runs():
                    cut = f.starts[lo : hi + 1] - f.starts[lo]
                    if digest:
                        raw = memoryview(ids.astype("<u4").tobytes())
                        end = pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.int64())
                    else:
                        end = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([f.docs.slice(lo, hi - lo), pa.array(f.starts[lo:hi] + before), pa.array(np.diff(cut)), end], names=["doc_id", "start", "n_tokens", last.split()[0]])
                f.close()

    return files.mapInArrow(worker(read), f"doc_id long, start long, n_tokens long, {last}")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_ids(write_ids(docs, new_path(spark, "token-ids"), default_tokenizer()))
