"""Fill-in-the-middle: a text's prefix, middle and suffix put in another order behind sentinels, and back again.

Each text is one bytearray. Sentinels are inserted at two cuts, which leaves <P>prefix<M>middle<S>suffix; neighbouring blocks are then
exchanged in place by three reversals. Inverting the same rotation and deleting the sentinels gives the text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, worker
from .textbytes import NOT_SPACE, slices, text_bytes

P, S, M = b"<P>", b"<S>", b"<M>"
SEED = 42
#: Of 100 texts, so many are rearranged; of these, so many of 100 start with the suffix.
SHARE, SPM_SHARE = 50, 80


def _flip(a: np.ndarray) -> None:
    """Reverses a view in place, half by half."""
    h = len(a) // 2
    if h:
        left = a[:h].copy()
        a[:h] = a[: len(a) - h - 1 : -1]
        a[len(a) - h :] = left[::-1]


def rotate(buf: bytearray, start: int, cut: int, stop: int) -> None:
    """Exchanges the blocks [start, cut) and [cut, stop) by three reversals."""
    a = np.frombuffer(buf, np.uint8)[start:stop]
    _flip(a[: cut - start])
    _flip(a[cut - start :])
    _flip(a)


def arrange(text: bytes, first: int, last: int, spm: bool) -> bytes:
    """text cut at the bytes first and last, with sentinels: <S>suffix<P>prefix<M>middle, or <P>prefix<S>suffix<M>middle."""
    buf = bytearray(text)
    buf[last:last] = S
    buf[first:first] = M
    buf[0:0] = P
    middle, suffix = len(P) + first, len(P) + len(M) + last
    rotate(buf, 0 if spm else middle, suffix, len(buf))
    return bytes(buf)


def restore(output: bytes, form: str) -> bytes:
    """The text that arrange() was given. It had no sentinel, and none can arise across its cuts, so each is found once."""
    if form == "plain":
        return output
    buf = bytearray(output)
    start, stop = (0, buf.index(P)) if form == "spm" else (buf.index(S), buf.index(M))
    rotate(buf, start, stop, len(buf))
    for mark in (S, M, P):
        at = buf.index(mark)
        del buf[at : at + len(mark)]
    return bytes(buf)


def units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units of all rows as offsets into buf, and one more than rows offsets into these: a unit is white space with the
    word behind it, or white space at the end of a text."""
    word = NOT_SPACE[buf]
    last = np.zeros(len(buf), bool)
    last[off[1:][off[1:] > off[:-1]] - 1] = True
    after = np.append(word[1:], False)
    ends = np.flatnonzero(last | (word & ~after))
    return ends + 1, np.searchsorted(ends, off)


def _draws(seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hexadecimal digits of a hash of the seed and the id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """docs (doc_id, text, any others) with fim_text, form ('plain', 'psm' or 'spm'), n_units, prefix_chars and middle_chars.

    Cuts fall between units (white space with the word behind it; white space at the end). Both cuts and the form are hashed from
    (seed, doc_id), so they depend on nothing else. `share` of 100 texts are rearranged, `spm_share` of 100 of these start with the
    suffix. A text that is empty or contains a sentinel stays plain, with null lengths. Whole texts of any length; one is held at a
    time beside its batch. A null text counts as empty and gives an empty fim_text; rows with equal or null ids draw alike (null as
    the word null); columns of docs with one of the five names keep it, and the added one gets "_" behind; an empty table stays
    empty. Only doc_id and text are read.
    """
    names = {}
    for n in ("fim_text", "form", "n_units", "prefix_chars", "middle_chars"):
        names[n] = n
        while names[n] in docs.columns:
            names[n] += "_"
    keys = [f"_h{k}" for k in range(4)]
    while set(keys) & set(docs.columns):
        keys = [f"_{k}" for k in keys]
    kept = docs.columns
    types = [pa.large_string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 4 << 20):
                buf, off = text_bytes(b.column("text"))
                ends, at = units(buf, off)
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                h = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
                n = np.diff(at)
                low, high = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
                places = np.concatenate([ends, [0]]).astype(np.int64)
                first, last = (np.where(c == 0, off[:-1], places[at[:-1] + c - 1]) for c in (low, high))
                out, form, prefix, middle = [], [], [], []
                for i in range(len(n)):
                    text = buf[off[i] : off[i + 1]].tobytes()
                    if not text or h[2][i] % 100 >= share or P in text or S in text or M in text:
                        out.append(text)
                        form.append("plain")
                        prefix.append(None)
                        middle.append(None)
                        continue
                    spm = h[3][i] % 100 < spm_share
                    out.append(arrange(text, first[i] - off[i], last[i] - off[i], spm))
                    form.append("spm" if spm else "psm")
                    prefix.append(chars[first[i]] - chars[off[i]])
                    middle.append(chars[last[i]] - chars[first[i]])
                made = [pa.array(out, pa.large_binary()).cast(pa.large_string()), form, n, prefix, middle]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(x, t) if not isinstance(x, pa.Array) else x for x, t in zip(made, types))], names=[*kept, *names.values()])

    added = ", ".join(f"`{n}` {t}" for n, t in zip(names.values(), ("string", "string", "long", "long", "long")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), added])
    return docs.withColumns(dict(zip(keys, _draws(seed)))).mapInArrow(worker(run), schema)


def restore_text(rows: DataFrame, text: str = "fim_text", form: str = "form", to: str = "restored") -> DataFrame:
    """rows with the texts rebuilt from the rearranged ones and their forms alone. A null output or form gives null."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text, 4 << 20):
                back = [None if t is None or f is None else restore(t, f) for t, f in zip(b.column(text).cast(pa.large_binary()).to_pylist(), b.column(form).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.large_binary()).cast(pa.large_string())], names=[*kept, to])

    return rows.mapInArrow(worker(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{to}` string"]))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore_text(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest("fim_text").alias("output_sha256"), digest("restored").alias("restored_sha256"))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') as u, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')) as h from documents),
x as (select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as b,
  ('0x' || substr(h, 17, 8))::bigint % 100 as c, ('0x' || substr(h, 25, 8))::bigint % 100 as e from d),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= {SHARE} then 'plain' when e < {SPM_SHARE} then 'spm' else 'psm' end as form,
  coalesce(array_to_string(u[1:least(a, b)], ''), '') as p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') as m, coalesce(array_to_string(u[greatest(a, b) + 1:], ''), '') as s from x)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(p) end as bigint) as prefix_chars, cast(case when form <> 'plain' then length(m) end as bigint) as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from f
"""
