"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

An item is a set of windows of `window` consecutive words (one window of all its words if it has fewer), and a
window a sequence of short shingles. A window occurs in a document only if all of its shingles do, so
containment is 1 and the necessary prefix under any order is one shingle: its rarest. Shingles are
ordered by how often they occur in all documents; only the rarest shingle of each window is joined,
its position in the window says where the window would have to begin (positional bound), the document's
words where it would have to end (length bound), and the words of the whole window are then compared.

Windows, shingle counts and candidates are tables; the driver sees nothing but two filters of fixed largest size,
which let tasks pass over shingles that no window has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, save, table, worker
from .textbytes import ALNUM, counts_by_row, lower_ascii, mix, slices, span_hashes, spans, text_bytes, windows

WINDOW, SHINGLE = 10, 3
#: Up to this many windows (some 200 bytes each), and ids of documents with hits, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A filter is a bitmap of 2^20 to 2^29 bits (64 MB), 32 or more for each shingle as long as that suffices, and up to so many shingles (8
#: bytes each) their sorted list too. What passes without being one of them goes to the join, which tells them apart.
LEAST_BITS, MOST_BITS, LISTED = 20, 29, 1_000_000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts, ends, hashes and rows of all words."""
    buf, off = text_bytes(texts)
    low = lower_ascii(buf)
    s, e, row = spans(low, off, ALNUM)
    return low, s, e, span_hashes(low, s, e), row


def _shingles(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit number for each shingle of `width` words, different for different widths, and its first word."""
    g, at = windows(h, row, width)
    return mix(g + np.uint64(width)), at


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item (a string), words (of one window, joined by spaces), size (how many), shingles (in order): each window of an item once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", 100_000):
                low, s, e, h, row = _words(part.column("text"))
                raw = low.tobytes()
                words = [raw[x:y].decode(errors="replace") for x, y in zip(s.tolist(), e.tolist())]
                n = counts_by_row(row, part.num_rows)
                first = np.cumsum(n) - n
                item, text, size, lists = [], [], [], []
                for i in np.flatnonzero(n):
                    of, w = min(window, int(n[i])), min(shingle, int(n[i]))
                    a, z = int(first[i]), int(first[i] + n[i])
                    g = _shingles(h[a:z], np.zeros(z - a, np.int64), w)[0].view(np.int64)
                    for k in range(a, z - of + 1):
                        item.append(i)
                        text.append(" ".join(words[k : k + of]))
                        size.append(of)
                        lists.append(g[k - a : k - a + of - w + 1])
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(item, pa.int64())), pa.array(text, pa.string()), pa.array(size, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["item", "words", "size", "shingles"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null").distinct()
    return rows.mapInArrow(worker(run), "item string, words string, size int, shingles array<long>").dropDuplicates(["item", "words"])


def _filter(tokens: DataFrame) -> tuple[int, np.ndarray, np.ndarray | None]:
    """How many high bits of a token say where it is in the bitmap; the bitmap of distinct tokens, 32 in each number; and the tokens in order
    if they are few."""
    n = tokens.count()
    bits = min(MOST_BITS, max(LEAST_BITS, n.bit_length() + 5))
    out = np.zeros(1 << (bits - 5), np.uint32)
    if n <= LISTED:
        keys = np.sort(tokens.toArrow().column("token").to_numpy().view(np.uint64))
        p = (keys >> np.uint64(64 - bits)).astype(np.int64)
        np.bitwise_or.at(out, p >> 5, (1 << (p & 31)).astype(np.uint32))
        return bits, out, keys
    parts = tokens.select(F.shiftrightunsigned("token", 64 - bits).alias("p")).selectExpr("p div 32 as at", "shiftleft(1L, cast(p % 32 as int)) as bit")
    got = parts.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()  # 2^(MOST_BITS - 5) rows at most
    out[got.column("at").to_numpy()] = got.column("bit").to_numpy().astype(np.uint32)
    return bits, out, None


def _marked(filter_: tuple[int, np.ndarray, np.ndarray | None], tokens: np.ndarray) -> np.ndarray:
    """Indexes of the tokens that pass."""
    bits, bitmap, keys = filter_
    p = tokens >> np.uint64(64 - bits)
    at = np.flatnonzero((bitmap[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
    if keys is None or not len(keys):
        return at
    return at[keys[np.minimum(np.searchsorted(keys, tokens[at]), len(keys) - 1)] == tokens[at]]


def frequencies(docs: DataFrame, tokens: DataFrame, widths: list[int]) -> DataFrame:
    """token, often: how often shingles of the given widths occur in all documents; all given tokens that occur, and
    perhaps others. Counted in each slice, summed by Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                _, _, _, h, row = _words(part.column("text"))
                got = [np.zeros(0, np.uint64)] + [g[_marked(shared.value, g)] for w in widths for g in (_shingles(h, row, w)[0],)]
                u, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["token", "n"])

    return docs.select("text").mapInArrow(worker(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("often"))


def rarest(found: DataFrame, often: DataFrame) -> DataFrame:
    """c, words, size, token, skip: each window with its rarest shingle (ties by number, then place) and how many of the window's words
    stand before that."""
    each = found.select("c", "words", "size", F.posexplode("shingles").alias("skip", "token"))
    best = each.join(often, "token", "left").groupBy("c", "words", "size").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token", "skip")).alias("x"))
    return best.select("c", "words", "size", F.col("x.token").alias("token"), F.col("x.skip").alias("skip"))


def classes(of_items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (c, words, size, shingles), and the items of each class c: windows that the same items share are one class, so
    text that many items share is looked for once and its items are joined once for each document.

    A set of items is told by its size and two 64-bit sums of hashes: two sets are taken for one with a chance of 2^-128 a pair.
    """
    two = [F.bit_xor(F.xxhash64(F.lit(k), F.col("item"))).alias(f"h{k}") for k in range(2)]
    windows_ = scratch.save(of_items.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"), F.count(F.lit(1)).alias("n"), *two).withColumn("w", F.monotonically_increasing_id()), "distinct")
    of = scratch.save(windows_.groupBy("n", "h0", "h1").agg(F.min("w").alias("c")), "classes")
    first = windows_.join(of.select(F.col("c").alias("w")), "w").select("words", F.col("w").alias("c"))
    return windows_.join(of, ["n", "h0", "h1"]).select("c", "words", "size", "shingles"), of_items.join(first, "words").select("c", "item")


def candidates(docs: DataFrame, prefixes: DataFrame, widths: list[int], window: int) -> DataFrame:
    """For each document a row (doc_id, k, h, n_words), k and h the hashes of its id and text; and for each of its
    shingles that pass the filter of the prefixes, a row (k, h, at, token, place, near): the number of its first word, and the
    words around it, of which `place` stand before. A window that holds the shingle lies among them."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(prefixes.select("token").distinct()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                low, s, e, h, row = _words(part.column("text"))
                n = counts_by_row(row, part.num_rows)
                found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)] + [(g[m], at[m], w) for w in widths for g, at in (_shingles(h, row, w),) for m in (_marked(shared.value, g),)]
                token, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                width = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
                first = (np.cumsum(n) - n)[row[at]]
                lo, hi = np.maximum(first, at + width - window), np.minimum(first + n[row[at]], at + window)
                size = hi - lo
                words = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                own, back = np.unique(words, return_inverse=True)
                raw = low.tobytes()
                texts = pa.array([raw[x:y].decode(errors="replace") for x, y in zip(s[own].tolist(), e[own].tolist())], pa.string())
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), texts.take(pa.array(back)))
                of, docs_n = pa.array(row[at]), part.num_rows
                none = lambda t, k: pa.nulls(k, t)
                names = ["doc_id", "k", "h", "n_words", "at", "token", "place", "near"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("k"), part.column("h"), pa.array(n), none(pa.int64(), docs_n), none(pa.int64(), docs_n), none(pa.int32(), docs_n), none(pa.list_(pa.string()), docs_n)], names=names)
                if len(at):
                    yield pa.RecordBatch.from_arrays([none(part.column("doc_id").type, len(at)), part.column("k").take(of), part.column("h").take(of), none(pa.int64(), len(at)), pa.array(at - first), pa.array(token.view(np.int64)), pa.array(at - lo, pa.int32()), near], names=names)

    rows = docs.select("doc_id", F.xxhash64("doc_id").alias("k"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(worker(run), f"doc_id {kind}, k long, h long, n_words long, at long, token long, place int, near array<string>")


def find_hits(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int, shingle: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents (doc_id, k, h, n_words); the occurrences of windows in them (k, h, first, size, c), each once; and the items of the
    classes c."""
    found, owners = classes(scratch.save(item_windows(items, window, shingle), "windows"), scratch)
    found, owners = scratch.save(found, "found"), save(owners, "owners")
    widths = sorted(r.w for r in found.select(F.least("size", F.lit(shingle)).alias("w")).distinct().collect())  # at most `shingle` numbers
    often = frequencies(docs, found.select(F.explode("shingles").alias("token")).distinct(), widths)
    prefixes = scratch.save(rarest(found, often), "prefixes")
    both = save(candidates(docs, prefixes, widths, window), "candidates")
    few = prefixes.count() <= broadcast_rows
    near = both.where("token is not null").select("k", "h", "at", "token", "place", "near").join(F.broadcast(prefixes) if few else prefixes, "token")
    start = F.col("place") - F.col("skip")
    whole = F.when((start >= 0) & (start + F.col("size") <= F.size("near")), F.array_join(F.slice("near", F.greatest(start, F.lit(0)) + 1, F.col("size")), " "))
    hits = near.where(whole == F.col("words")).select("k", "h", (F.col("at") - F.col("skip")).alias("first"), "size", "c")
    return both.where("n_words is not null").select("doc_id", "k", "h", "n_words"), save(hits, "hits"), owners


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS, keep: str = "report") -> DataFrame:
    """Which documents hold windows of which benchmark items.

    items: item_id, text. keep='report' gives one row per document: doc_id, n_words, n_hit (words inside any
    occurrence), n_items, items_sha256 (of the sorted ids joined by commas), items (the ids, sorted),
    contaminated. keep='clean' gives the documents without any hit, with all their columns, whatever their names.

    A null or empty text has no words and no hits; an item without words none either; a null item id is
    the string 'null'. Repeated rows give repeated results; ids may be of any type. An empty table on either side
    gives no hits. A passage that very many documents hold is joined by a broadcast, or beyond broadcast_rows windows by
    a shuffle whose skewed parts Spark splits.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    every, hits, owners = find_hits(docs, items, scratch, window, shingle, broadcast_rows)
    scratch.drop()
    if keep == "clean":
        k, h = "_k", "_h"
        while {k, h} & set(docs.columns):
            k, h = k + "_", h + "_"
        hit = save(hits.select(F.col("k").alias(k), F.col("h").alias(h)).distinct(), "contaminated")
        few = hit.count() <= broadcast_rows
        own = docs.withColumn(k, F.xxhash64("doc_id")).withColumn(h, F.xxhash64("text"))
        return own.join(F.broadcast(hit) if few else hit, [k, h], "left_anti").select(*docs.columns)
    words = hits.select("k", "h", "first", "size").distinct().select("k", "h", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("word"))
    n_hit = words.distinct().groupBy("k", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    names = hits.select("k", "h", "c").distinct().join(owners, "c").select("k", "h", "item").distinct().groupBy("k", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = every.join(n_hit.join(names, ["k", "h"]), ["k", "h"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "items", F.col("n_hit").isNotNull().alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
with d0 as (select row_number() over () as r, doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_W}') as w from documents),
i0 as (select item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_W}') as w from benchmark),
iw as (select distinct item_id, len(w) as size0, least(10, len(w)) as size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win
       from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i0 where len(w) > 0)),
sizes as (select distinct size from iw),
dw as (select r, size, p, array_to_string(w[p:p + size - 1], ' ') as win
       from (select r, w, size, unnest(range(1, len(w) - size + 2)) as p from d0, sizes where len(w) >= size)),
hits as (select r, p, dw.size as size, item_id from dw join iw on dw.win = iw.win and dw.size = iw.size),
words as (select r, count(distinct x) as n_hit from (select r, unnest(range(p, p + size)) as x from hits) group by r),
ids as (select r, count(*) as n_items, string_agg(i, ',' order by i) as names from (select distinct r, cast(item_id as varchar) as i from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d0 left join words using (r) left join ids using (r)
"""
