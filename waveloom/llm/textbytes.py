"""Vectorised numpy work on the UTF-8 bytes of Arrow string columns.

Whole batches of texts are handled as one byte array plus offsets, so words are found and hashed
without a Python object per word.  Hashes are 64-bit: two different words or shingles share one
with a chance of about n*n/2^65 among n of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_C = 0xD6E8FEB86659FD93
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_C))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, at least n of each."""
    if "r" not in _POW or len(_POW["r"]) < n:
        m = max(1 << 20, 1 << int(n - 1).bit_length())
        for name, base in (("r", _R), ("i", _R_INV)):
            f = np.full(m, base, dtype=np.uint64)
            f[0] = 1
            _POW[name] = np.multiply.accumulate(f)
    return _POW["r"], _POW["i"]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case; other bytes as they are."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(len(col) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data and off[-1] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text has about `limit` bytes; a longer text makes a run of its own."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of bytes for which the 256-entry table is true."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off[:-1]] = True
    first = first[:-1]
    starts = m.copy()
    starts[1:] &= ~m[:-1] | first[1:]
    ends = np.empty_like(m)
    ends[:-1] = m[:-1] & (~m[1:] | first[1:])
    ends[-1] = m[-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, by differences of one running sum."""
    r, inv = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * r[: len(buf)], out=sums[1:])
    return mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(_C))


def windows(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` neighbouring words of one row, and the index of its first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(_R) + h[j : j + n]
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    return mix(out[at]), at


def counts_by_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def table(chars_excluded: bytes) -> np.ndarray:
    """256 entries, false at the given bytes: for classes of the form [^...] over ASCII."""
    t = np.ones(256, bool)
    t[list(chars_excluded)] = False
    return t


#: Words of the forms [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lowering).
NOT_SPACE = table(b"\x20\x09\x0a\x0b\x0c\x0d")
ALNUM = table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
