"""Quality rules: fixed base rules, then boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt
from .shared import table, worker
from .textbytes import NOT_SPACE, counts_by_row, slices, span_hashes, spans, text_bytes, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further counts that only the trees read.
EXTRA = ("n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct_words", "n_twin_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "upper", "digits", "punct", "distinct", "twins")
#: More symbols, repeated lines, repeated passages or doubled words never raise a document's score.
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, 0, -1)
#: Labelled rows used to fit the trees, at most (those with the smallest hash of the id).
FIT_ROWS = 20_000
#: A document is kept when the trees give it this probability of being good, or more.
KEEP_AT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"'()-")] = True
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _ragged_sum(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return sums[off[1:]] - sums[off[:-1]]


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS and EXTRA for each text; a null counts as an empty text."""
    buf, off = text_bytes(texts)
    n = len(off) - 1
    s, e, row = spans(buf, off, NOT_SPACE)
    h = span_hashes(buf, s, e)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(s) else np.zeros(len(buf), bool)
    # neighbouring words of two rows may touch, which leaves the sum at 1
    out = {"n_words": counts_by_row(row, n), "word_chars": _ragged_sum(_LEAD[buf] & inside, off), "n_symbols": _ragged_sum(_SYMBOL[buf], off)}
    not_break = np.ones(256, bool)
    not_break[10] = False
    ls, le, lrow = spans(buf, off, not_break)
    if len(ls):
        words_before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        full = words_before[le] > words_before[ls]
        ls, le, lrow = ls[full], le[full], lrow[full]
    lh = span_hashes(buf, ls, le)
    out["n_dup_lines"] = counts_by_row(lrow[_seen_before(lh, lrow)], n)
    w, at = windows(h, row, 5)
    again = _found_twice(w, row[at])
    cover = np.zeros(len(h) + 6, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 5, -1)
    out["n_repeat_words"] = counts_by_row(row[np.cumsum(cover)[: len(h)] > 0], n)
    out["n_chars"] = _ragged_sum(_LEAD[buf], off)
    out["n_lines"] = counts_by_row(lrow, n)
    for k, t in (("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT)):
        out[k] = _ragged_sum(t[buf], off)
    out["n_distinct_words"] = counts_by_row(row[~_seen_before(h, row)], n)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out["n_twin_words"] = counts_by_row(row[twin], n)
    return out


def _runs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal hashes of a row together, first ones first, and where it repeats the one before."""
    o = np.lexsort((h, row))
    same = np.zeros(len(h), bool)
    same[1:] = (h[o][1:] == h[o][:-1]) & (row[o][1:] == row[o][:-1])
    return o, same


def _seen_before(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    o, same = _runs(h, row)
    out[o] = same
    return out


def _found_twice(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    o, same = _runs(h, row)
    both = same.copy()
    both[:-1] |= same[1:]
    out[o] = both
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["n_chars"], 1)
    return np.stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, words / lines,
                     c["n_upper"] / chars, c["n_digits"] / chars, c["n_punct"] / words, c["n_distinct_words"] / words, c["n_twin_words"] / words], axis=1)


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    """Under ten words, or more than a fifth of the words in passages that the text repeats."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> gbdt.Trees:
    """Trees fitted to `labels` (doc_id, quality 0 or 1) over at most `rows` labelled documents.

    Rows of labels without a quality or a document are not used; of repeated ids in labels the least quality counts,
    of repeated ids in docs any one row. The bound is applied to the labels of documents that are there. With
    one class alone, fewer than 40 such rows, or classes that no statistic tells apart, the model is constant and only the base rules decide.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    wanted = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                x = features(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *map(pa.array, x.T)], names=["doc_id", "quality", *FEATURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = some.select("doc_id", "text", "quality").mapInArrow(worker(count), f"doc_id {kind}, quality int, " + ", ".join(f"{f} double" for f in FEATURES)).dropDuplicates(["doc_id"]).toPandas()
    got = got.sort_values("doc_id")
    return gbdt.fit(got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), got["quality"].to_numpy(), MONOTONE)


def _scored(part: pa.RecordBatch, model: gbdt.Trees, keep_at: float) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    c = statistics(part.column("text"))
    failed = base_failed(c)
    p = model.probability(features(c))
    return c, failed, p, ~failed if model.constant else ~failed & (p >= keep_at)


def score_quality(docs: DataFrame, model: gbdt.Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, the counts of COUNTS, base_failed, score (the trees' probability), kept: not
    base_failed and a score of keep_at or more; a constant model decides nothing.

    A null or empty text has no words and so fails the base rules. Repeated rows give repeated results;
    other columns of docs are not read. Whole texts are counted, in slices of a few MB.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by rounds and depth

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                c, failed, p, kept = _scored(part, shared.value, keep_at)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c[k]) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "score", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(worker(score), f"doc_id {kind}, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: gbdt.Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that score_quality keeps, with all their columns, whatever their names. Null and empty texts go,
    as they fail the base rules; repeated rows stay or go together; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                yield part.filter(pa.array(_scored(part, shared.value, keep_at)[3]))

    return docs.mapInArrow(worker(keep), docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
