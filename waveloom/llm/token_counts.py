"""Token counts by section: whole documents are encoded once and token spans attributed to sections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import default_tokenizer, encoder
from .shared import table, worker
from .textbytes import slices, text_bytes

RULES = ("majority", "first", "last")


def token_spans(lengths: np.ndarray, counts: np.ndarray, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, and first and one past the last character of each token, as offsets into all characters of
    the batch; and the offset of each row's first character. A token that holds part of a
    character spans the whole of it."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    chars = np.cumsum((buf & 0xC0) != 0x80)  # characters begun up to and with a byte
    before = np.concatenate([[0], chars])[off]
    return np.repeat(np.arange(len(counts)), counts), chars[starts] - 1, chars[ends - 1], before


def attribute(first: np.ndarray, last: np.ndarray, s: np.ndarray, e: np.ndarray, rule: str) -> np.ndarray:
    """For each token the index of the section (sorted, not overlapping) it is counted in, or -1.

    A token in one section alone is counted there. One that lies over several, or over an edge, goes to
    the section with most of its characters, the earlier one if equal ('majority'), or to the
    'first' or 'last' section it touches. A token that touches none gets -1.
    """
    if not len(s):
        return np.full(len(first), -1)
    lo = np.searchsorted(e, first, side="right")
    hi = np.searchsorted(s, last, side="left") - 1
    touches = lo <= hi
    if rule == "last":
        return np.where(touches, hi, -1)
    out = np.where(touches, lo, -1)
    if rule == "first":
        return out
    many = np.flatnonzero(touches & (hi > lo))
    best = np.zeros(len(many), np.int64)
    at = lo[many].copy()
    left = np.arange(len(many))
    while len(left):  # as many turns as sections that one token touches at most
        k, i = at[left], many[left]
        share = np.minimum(e[k], last[i]) - np.maximum(s[k], first[i])
        better = share > best[left]
        out[i[better]], best[left[better]] = k[better], share[better]
        at[left] += 1
        left = left[at[left] <= hi[many[left]]]
    return out


def count_by_section(docs: DataFrame, tokenizer: str, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """Tokens of each section. docs: doc_id, text; `sections` names a column with an array of structs (start, stop) of
    character offsets, sorted and without overlap; without it the lines of the text are sections.

    Whole texts are encoded once. Spans in characters come from the byte lengths of the tokens, which add up to the
    bytes of the text, so they are the offsets of the tokenizer, and a token that holds a part of a
    character spans the whole of it.

    Returns doc_id, section (0-based; -1 holds tokens that touch no section), start, stop, n_tokens, and
    n_crossing, how many of them also touch characters outside the section. The sections of a
    document sum to its whole count; what a section claims past the end of the text is cut off. Empty sections have
    no tokens. A null or empty text gives one section of nothing when lines are used, and none if its given sections
    are null or empty; repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = sections is not None
    docs = docs.select("doc_id", "text", *([F.col(sections)["start"].alias("s"), F.col(sections)["stop"].alias("e")] if given else []))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                buf, off = text_bytes(part.column("text"))
                ids, counts = enc.encode(part.column("text"))
                if given:
                    row, first, last, before = token_spans(enc.token_bytes[ids], counts, buf, off)
                    lists = [part.column(c).fill_null([]) if part.column(c).null_count else part.column(c) for c in ("s", "e")]
                    n_sections = np.asarray(lists[0].value_lengths())
                    srow = np.repeat(np.arange(len(counts)), n_sections)
                    s, e = (np.minimum(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + before[srow], before[srow + 1]) for x in lists)
                else:
                    # lines tile the text, so byte offsets of line feeds are all that is needed to find them
                    feed = np.flatnonzero(buf == 10) + 1
                    frow = np.searchsorted(off, feed - 1, side="right") - 1
                    n_sections = np.bincount(frow, minlength=len(counts)) + 1
                    srow = np.repeat(np.arange(len(counts)), n_sections)
                    head = np.cumsum(n_sections) - n_sections
                    row, first, last, before = token_spans(enc.token_bytes[ids], counts, buf, off)
                    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                    s = np.empty(len(srow), np.int64)
                    is_head = np.zeros(len(srow), bool)
                    is_head[head] = True
                    s[is_head], s[~is_head] = before[:-1], chars[feed]
                    e = np.append(s[1:], before[-1])
                    e[np.append(head[1:] - 1, len(e) - 1)] = before[1:]
                to = attribute(first, last, s, e, rule)
                crossing = (to >= 0) & ((first < s[np.maximum(to, 0)]) | (last > e[np.maximum(to, 0)])) if len(s) else np.zeros(len(to), bool)
                n = np.bincount(to[to >= 0], minlength=len(s))
                c = np.bincount(to[crossing], minlength=len(s))
                base = before[srow]
                number = np.arange(len(s)) - np.repeat(np.cumsum(n_sections) - n_sections, n_sections)
                cols = [part.column("doc_id").take(pa.array(srow)), number, s - base, e - base, n, c]
                lone = np.bincount(row[to < 0], minlength=len(counts))
                out = np.flatnonzero(lone)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([cols[0], *(pa.array(x, t) for x, t in zip(cols[1:], types))], names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])
                if len(out):
                    none = pa.nulls(len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(out)), pa.array(np.full(len(out), -1), pa.int32()), none, none, pa.array(lone[out], pa.int64()), pa.array(np.zeros(len(out), np.int64))], names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return docs.mapInArrow(worker(count), f"doc_id {kind}, section int, start long, stop long, n_tokens long, n_crossing long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_section(table(spark, sf_dir, "documents"), default_tokenizer())
