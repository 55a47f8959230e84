"""WARC archives through a chunked record table.

A payload is a run of rows (record, chunk_no, last, data) with at most CHUNK bytes each, in order. Spark cuts the
rows, so no Python worker ever holds a whole payload; each row carries how many bytes there are up to its end and their
SHA-1, and the row with `last` so has the length and digest of the whole. The table is written; roles are
found from its last rows, and archives are written from it chunk by chunk. Reading gives such rows again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_read, open_write
from .shared import Scratch, new_path, save, table, worker

CHUNK = 1 << 20
#: Payloads below this are always written in full.
REVISIT_BYTES = 1000
#: An archive file is closed after so many payload bytes.
FILE_BYTES = 256 << 20
#: Payload bytes of a task that writes payloads of several chunks, about.
SHARD_BYTES = 64 << 20
#: Up to this many groups of equal payloads (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_CRLF = b"\r\n"


def chunk_rows(record: int, payload: Iterator[bytes], size: int = CHUNK) -> Iterator[tuple[int, int, bool, bytes, str]]:
    """Rows (record, chunk_no, last, data, sha1 so far) of a payload given in pieces of any sizes. One empty row for an empty payload."""
    sha, n, held = hashlib.sha1(), 0, b""
    for piece in payload:
        view = memoryview(held + bytes(piece)) if held else memoryview(piece)
        while len(view) > size:
            data = bytes(view[:size])
            sha.update(data)
            yield record, n, False, data, sha.hexdigest()
            n, view = n + 1, view[size:]
        held = bytes(view)
    sha.update(held)
    yield record, n, True, held, sha.hexdigest()


def record_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """record (a number for each row of pages), page_id, url, chunk_no, last, data, length and sha1 (of all bytes up to
    this chunk's end) of the html of pages in UTF-8.

    A null or empty html is one empty chunk; repeated rows are records of their own; other columns are not read.
    The numbers are those of one run: save the table before it is read twice.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("record", F.monotonically_increasing_id())
    most = F.greatest(F.ceil(F.octet_length("html") / size), F.lit(1)).cast("int")
    rows = rows.select("record", "page_id", "url", "html", F.explode(F.sequence(F.lit(0), most - 1)).alias("chunk_no"))
    rows = rows.select("record", "page_id", "url", "chunk_no", (F.col("chunk_no") == most - 1).alias("last"), F.substring("html", F.col("chunk_no") * size + 1, F.lit(size)).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, length = hashlib.sha1(), 0
        for b in batches:
            data, sums, lengths = b.column("data"), [], []
            for i, no in enumerate(b.column("chunk_no").to_pylist()):
                if not no:
                    sha, length = hashlib.sha1(), 0
                chunk = data[i].as_buffer()
                sha.update(chunk)
                length += chunk.size
                sums.append(sha.hexdigest())
                lengths.append(length)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths, pa.int64()), pa.array(sums, pa.string())], names=[*b.schema.names, "length", "sha1"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(worker(run), ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", length long, sha1 string")


class RecordWriter:
    """A .warc.gz file, one gzip member for each record; payloads are given chunk by chunk."""

    def __init__(self, uri: str):
        self.uri, self.out, self.payload_bytes, self.n = uri, open_write(uri), 0, 0

    def begin(self, headers: dict[str, str], length: int) -> None:
        self.z = zlib.compressobj(4, zlib.DEFLATED, 31)
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {length}\r\n\r\n"
        self.out.write(self.z.compress(head.encode()))

    def feed(self, chunk: memoryview | bytes) -> None:
        self.out.write(self.z.compress(chunk))
        self.payload_bytes += len(chunk)

    def end(self) -> None:
        self.out.write(self.z.compress(_CRLF + _CRLF) + self.z.flush())
        self.n += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.uri, self.n


class RecordReader:
    """Streams the records of a .warc.gz file: headers, then chunks of the content."""

    def __init__(self, uri: str, piece: int = 1 << 18):
        self.f, self.piece = open_read(uri), piece
        self.z = zlib.decompressobj(31)
        self.buf = bytearray()

    def _more(self) -> bool:
        while True:
            raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            raw = raw or self.f.read(self.piece)
            got = self.z.decompress(raw, self.piece)  # without input, what the last call held back
            if not raw and not got:
                return False
            if got:
                self.buf += got
                return True

    def records(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while True:
            while (end := self.buf.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if bytes(self.buf).strip():
                        raise ValueError("archive ends inside a header")
                    self.f.close()
                    return
            lines = bytes(self.buf[:end]).decode().split("\r\n")
            del self.buf[: end + 4]
            headers = dict(x.split(": ", 1) for x in lines[1:])
            left = [int(headers["Content-Length"])]

            def content(left=left) -> Iterator[bytes]:
                while left[0]:
                    if not self.buf and not self._more():
                        raise ValueError("archive ends inside a record")
                    take = min(left[0], len(self.buf), CHUNK)
                    data = bytes(self.buf[:take])
                    del self.buf[:take]
                    left[0] -= take
                    yield data

            body = content()
            yield headers, body
            for _ in body:  # what the caller has not read
                pass
            while len(self.buf) < 4:
                if not self._more():
                    raise ValueError("archive ends inside a record")
            del self.buf[:4]


def _identity(page, record: int) -> str:
    """A record id made of the page's id and its number in the record table."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{record}')}>"


def _plain(page):
    """A page id as JSON can hold it: numbers and strings as they are, others as strings."""
    return page if isinstance(page, (int, str)) else str(page)


def roles(records: DataFrame, scratch: Scratch, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The rows of a record table in an order to write them in, with total and digest of the whole payload, and
    refers_to and refers_record of the response that a revisit repeats (null: it is a response).

    Payloads of one chunk stay where they are; only those of several are dealt out by record and sorted.
    """
    ends = records.where("last").select("record", "page_id", "length", "sha1")
    # a struct with a null id is less than all others
    same = ends.where(F.col("length") >= revisit_bytes).groupBy(F.col("sha1").alias("digest"), F.col("length").alias("total")).agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("page_id", "record")).alias("best")).where("c > 1 and best.page_id is not null")
    same = scratch.save(same.select("digest", "total", F.col("best.page_id").alias("largest"), F.col("best.record").alias("of")), "equal-payloads")
    few = same.count() <= BROADCAST_ROWS
    one = records.where("chunk_no = 0 and last").withColumn("total", F.col("length")).withColumn("digest", F.col("sha1"))
    long_ends = records.where("chunk_no > 0 and last").select("record", F.col("length").alias("total"), F.col("sha1").alias("digest"))
    long_ends = long_ends.join(F.broadcast(same) if few else same, ["digest", "total"], "left")
    one = one.join(F.broadcast(same) if few else same, ["digest", "total"], "left")
    size = long_ends.agg(F.sum("total")).first()[0] or 0
    long = records.where("not (chunk_no = 0 and last)").join(long_ends, "record").repartition(max(1, -(-size // SHARD_BYTES)), "record").sortWithinPartitions("record", "chunk_no")
    repeats = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    out = [rows.select("record", "page_id", "url", "chunk_no", "last", "data", "total", "digest", F.when(repeats, F.col("largest")).alias("refers_to"), F.when(repeats, F.col("of")).alias("refers_record")) for rows in (one, long)]
    return out[0].unionByName(out[1])


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, chunk: int = CHUNK) -> DataFrame:
    """One WARC record for each row of pages (page_id, url, html), in files under `path`; returns the manifest (uri, n_records).

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least revisit_bytes that with the
    largest page_id is a response, the others are revisits of it without content; smaller payloads
    are all responses. If a repeated page_id is the largest, each of its rows is a response. A null page_id is
    never largest: its row is a revisit if a row with an id has the payload, else a response. Each row of pages has a
    record id of its own. A null url is left out; an empty table gives no files.
    """
    scratch = Scratch(pages.sparkSession, "records")
    records = scratch.save(record_table(pages, chunk), "record-table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        for b in batches:
            data = b.column("data")
            for i, row in enumerate(b.drop_columns(["data"]).to_pylist()):
                page, url, refers = row["page_id"], row["url"], row["refers_to"]
                if out is None:
                    out = RecordWriter(f"{path}/{uuid.uuid4().hex}.warc.gz")
                if not row["chunk_no"]:
                    headers = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": _identity(page, row["record"]), "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "text/html; charset=utf-8"}
                    if page is not None:
                        headers["X-Page-ID"] = json.dumps(_plain(page))
                    if url is not None:
                        headers["WARC-Target-URI"] = quote(url, safe="%/:?#[]@!$&'()*+,;=~")
                        if headers["WARC-Target-URI"] != url:
                            headers["X-Page-URL"] = json.dumps(url)
                    headers |= {"WARC-Payload-Digest": "sha1:" + row["digest"], "X-Payload-Length": str(row["total"])}
                    if refers is not None:
                        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _identity(refers, row["refers_record"]), "X-Refers-To-Page-ID": json.dumps(_plain(refers))}
                    out.begin(headers, row["total"] if refers is None else 0)
                if refers is None:
                    out.feed(memoryview(data[i].as_buffer()))
                if row["last"]:
                    out.end()
                    if out.payload_bytes >= FILE_BYTES:
                        done.append(out.close())
                        out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["uri", "n_records"])

    manifest = save(roles(records, scratch, revisit_bytes).mapInArrow(worker(run), "uri string, n_records long"), "warc-manifest")
    scratch.drop()
    return manifest


def read_archives(manifest: DataFrame, payloads: bool = False, page_type: str = "long", chunk: int = CHUNK) -> DataFrame:
    """The records of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Content is read as chunk rows; length and SHA-1 of a response are those of its last row, and an archive whose
    header says otherwise is an error. A revisit has no content and carries those of its response. With
    payloads=True the chunk rows themselves: page_id, chunk_no, last, data, length and sha1 (up to this chunk).
    """
    files = manifest.select("uri").repartition(max(1, manifest.count()), "uri")  # a task for each file of up to FILE_BYTES
    whole = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
    parts = pa.schema([("page_id", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("length", pa.int64()), ("sha1", pa.string())])
    schema = parts if payloads else whole

    def page_of(x: str | None) -> str | None:
        return None if x is None else str(json.loads(x))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                rows, held = [], 0
                for headers, content in RecordReader(uri).records():
                    page, kind = page_of(headers.get("X-Page-ID")), headers["WARC-Type"]
                    said, length = headers["WARC-Payload-Digest"].partition(":")[2], int(headers["X-Payload-Length"])
                    if kind == "response" or payloads:
                        length = 0
                        for _, no, last, data, sha in chunk_rows(0, content, chunk):
                            length += len(data)
                            if payloads:
                                rows.append((page, no, last, data, length, sha))
                                held += len(data)
                            if held >= 4 * CHUNK:
                                yield batch(rows)
                                rows, held = [], 0
                        if kind == "response" and sha != said:
                            raise ValueError(f"{uri}: payload of page {page} does not have the digest in its header")
                    if not payloads:
                        url = json.loads(headers["X-Page-URL"]) if "X-Page-URL" in headers else headers.get("WARC-Target-URI")
                        rows.append((page, url, length, said, kind, page_of(headers.get("X-Refers-To-Page-ID"))))
                    if len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    out = files.mapInArrow(worker(run), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))
    return out.select(*[F.col(n).cast(page_type).alias(n) if n in ("page_id", "refers_to") else n for n in schema.names])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_archives(write_archives(pages, new_path(spark, "warc")), page_type=pages.schema["page_id"].dataType.simpleString())


ORACLE_SQL = f"""
with p as (select page_id, url, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as largest from p)
select page_id, url, payload_bytes, payload_digest,
       case when payload_bytes >= {REVISIT_BYTES} and largest is not null and page_id is distinct from largest then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {REVISIT_BYTES} and page_id is distinct from largest then largest end as refers_to
from g
"""
