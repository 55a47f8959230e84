"""Stretches of a text that repeat with a period of some words, found in one walk over its words.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(SHORTEST, PERIODS * q) words long, that neither
neighbour extends. Each word meets earlier occurrences of itself; each occurrence at distance q adds one to the length of the match on the
diagonal q, if that was active at the word before. A diagonal that ends long enough is a run and is emitted at once.

The diagonals are sparse without losing a run. An occurrence counts only if the G - 1 words before it agree too, and for each G = 5, 10,
20, ... only the nearest one counts: a match that starts so starts at length G. In a run of period q <= G, windows of G words reappear
first exactly q words on (a nearer one would make the period smaller), so its diagonal is active from the word where the first window
reappears until the run's end, with the right length. Each word meets at most log2(n) occurrences, whatever its text repeats: a text of
one word n times costs n log n. Windows that occur once cannot be in a run, so most words of most texts meet none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, worker
from .textbytes import slices

PERIODS, SHORTEST = 4, 6
#: Words of the shortest window: in a run of at least SHORTEST = 6 words and PERIODS = 4 periods, 5 words match at the least.
WINDOW = 5


def _again(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of positions `at` (ascending) with equal-or-not keys: those whose key occurs more than once, a number for their key, and how far
    back it occurred last (0: not before)."""
    if not len(keys):
        return at, keys, at
    order = np.argsort(keys, kind="stable")
    k, p = keys[order], at[order]
    same = k[1:] == k[:-1]
    many = np.append(False, same) | np.append(same, False)
    group = np.cumsum(np.append(True, ~same))
    back = np.append(0, np.where(same, p[1:] - p[:-1], 0))
    p, group, back = p[many], group[many], back[many]
    order = np.argsort(p, kind="stable")
    return p[order], group[order], back[order]


def occurrences(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The occurrences to be met, by position: last word of a window, how far back the window occurred last, and its size. words: a number
    for each word; row: its text, ascending; size: of the longest text."""
    n = len(words)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    # windows of five words of one text, numbered: pairs of pairs and one word, each renumbered so that keys stay below n * n
    pair = np.unique(words[:-1] * n + words[1:], return_inverse=True)[1].astype(np.int64)
    four = np.unique(pair[:-2] * n + pair[2:], return_inverse=True)[1].astype(np.int64)
    at = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    five = np.unique(four[at] * n + words[at + WINDOW - 1], return_inverse=True)[1].astype(np.int64)
    starts = np.unique(row[at])
    g, key = WINDOW, five * (len(starts) + 1) + np.searchsorted(starts, row[at])
    at, key, back = _again(key, at + WINDOW - 1)
    while len(at):
        new = back > 0
        found.append((at[new], back[new], np.full(int(new.sum()), g, np.int64)))
        if 2 * g > size:
            break
        # a window of 2g words: the one that ends here and the one that ends g words before
        left = np.searchsorted(at, at - g)
        both = np.flatnonzero((left < len(at)) & (at[np.minimum(left, len(at) - 1)] == at - g) & (row[np.maximum(at - g, 0)] == row[at]))
        pairs = key[left[both]] * (key.max() + 1) + key[both]
        at, key, back = _again(pairs, at[both])
        g *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    p, b, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-s, p))
    return p[order], b[order], s[order]


def walk(at: list[int], back: list[int], size: list[int], periods: int = PERIODS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) from the occurrences by position, the larger windows of a position first. `active` holds, for each
    diagonal that the word before was on, how many words have matched on it."""
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}
    before, i, n = -2, 0, len(at)

    def end(ended: dict[int, int], stop: int) -> None:
        for q, m in ended.items():
            if m + q >= max(shortest, periods * q):
                runs.append((stop - m - q, m + q, q))

    while i < n:
        here, new = at[i], {}
        if here != before + 1 and active:
            end(active, before + 1)
            active = {}
        while i < n and at[i] == here:
            q = back[i]
            if q not in new:
                held = active.pop(q, 0)
                new[q] = held + 1 if held + 1 > size[i] else size[i]
            i += 1
        if active:
            end(active, here)
        active, before = new, here
    end(active, before + 1)
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def text_runs(rows: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words; by start, then period."""
    numbers: dict[bytes, int] = {}
    count = np.array([len(r) for r in rows], np.int64)
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for r in rows for w in r), np.int64, int(count.sum()))
    row = np.repeat(np.arange(len(rows)), count)
    p, b, s = occurrences(words, row, int(count.max(initial=0)))
    first = np.cumsum(count) - count
    cut = np.searchsorted(p, np.append(first, count.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows]
    for r in np.flatnonzero(np.diff(cut)):
        a, z = cut[r], cut[r + 1]
        out[r] = walk((p[a:z] - first[r]).tolist(), b[a:z].tolist(), s[a:z].tolist())
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those behind the first period of any run."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g] if runs else words


def find_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) with n_words, runs (array of start, length, period, by start and then period; start is a word number
    from 0) and collapsed_text (the words left when each run keeps its first period, joined by one space).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Time is n log n in the words of a text, and memory is that of some texts of
    together 2 MB, or of one longer text. A null or empty text, or one of white space, has no words, no run and an empty
    collapsed_text; ids are not looked at, so null and repeated rows are rows like others; two runs may overlap and start at the same
    word; columns of docs with one of the three names keep it, and the added one gets "_" behind; an empty table stays empty.
    """
    names = []
    for n in ("n_words", "runs", "collapsed_text"):
        while n in docs.columns:
            n += "_"
        names.append(n)
    kept = docs.columns
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                rows = [t.split() if t else [] for t in b.column("text").cast(pa.large_binary()).to_pylist()]
                found = text_runs(rows)
                left = [b" ".join(collapse(w, r)) for w, r in zip(rows, found)]
                flat = np.array([x for r in found for x in r], np.int64).reshape(-1, 3)
                offsets = np.cumsum([0, *(len(r) for r in found)]).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(w) for w in rows], pa.int64()), runs, pa.array(left, pa.large_binary()).cast(pa.large_string())], names=[*kept, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{names[0]}` long, `{names[1]}` array<struct<start:long,length:long,period:long>>, `{names[2]}` string"])
    return docs.mapInArrow(worker(run), schema)


def repeat_tails(docs: DataFrame) -> DataFrame:
    """docs with periodic tails in a tenth of the texts. With h the crc32 of the decimal doc_id and g = h div 10: if h mod 10 is 0, the n
    words from number a = g mod n on repeat those at a with period 1 + (n - a) div (3 + g mod 8). Texts that are not changed stay as
    they are, and so do those of a null id; a changed one has its words joined by one space."""
    kept = docs.columns
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 8 << 20):
                h = [None if i is None else zlib.crc32(str(i).encode()) for i in b.column("doc_id").to_pylist()]
                texts = b.column("text").cast(pa.large_binary()).to_pylist()
                for k, (x, t) in enumerate(zip(h, texts)):
                    w = t.split() if t and x is not None and x % 10 == 0 else []
                    if w:
                        g = x // 10
                        a = g % len(w)
                        p = 1 + (len(w) - a) // (3 + g % 8)
                        texts[k] = b" ".join(w[:a] + [w[a + j % p] for j in range(len(w) - a)])
                cols = list(b.columns)
                cols[at] = pa.array(texts, pa.large_binary()).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays(cols, names=kept)

    return docs.mapInArrow(worker(run), docs.schema)


def _digests(rows: DataFrame) -> DataFrame:
    """The longest run of each text (ties: least start, then period) and digests of all runs and of the words left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(find_runs(repeat_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text"))


#: All pairs of equal words of a text, then islands on the diagonals: right for small tables, quadratic in the repeats of a text.
ORACLE_SQL = r"""
with t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) as t),
o as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
  xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(t.t[(xor(c, b) & 255) + 1], c >> 8))) as h from documents, t),
g as (select *, len(w) as n, h // 10 as g from o),
a as (select *, case when h % 10 = 0 and n > 0 then g % n end as a from g),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
d as (select r, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end]) end as w from p),
x as (select r, n, unnest(w) as v, unnest(range(n)) as i from d),
m as (select y.r, y.i, y.i - z.i as q from x y join x z on y.r = z.r and y.v = z.v and z.i < y.i and 4 * (y.i - z.i) <= y.n),
k as (select *, i - row_number() over (partition by r, q order by i) as k from m),
s as (select r, q, min(i) - q as s, max(i) + 1 - min(i) + q as l from k group by r, q, k having max(i) + 1 - min(i) + q >= greatest(6, 4 * q)),
u as (select * from s where not exists (select 1 from s b where b.r = s.r and b.q < s.q and s.q % b.q = 0 and b.s <= s.s and b.s + b.l >= s.s + s.l)),
b as (select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as lines, max(struct_pack(l := l, s := -s, q := -q)) as best from u group by r),
gone as (select distinct r, unnest(range(s + q, s + l)) as i from u),
c as (select x.r, string_agg(v, ' ' order by x.i) as kept from x left join gone on x.r = gone.r and x.i = gone.i where gone.i is null group by x.r)
select doc_id, coalesce(n_runs, 0) as n_runs, cast(-best.s as bigint) as start, cast(best.l as bigint) as length, cast(-best.q as bigint) as period, cast(1000 * best.l // -best.q as bigint) as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256 from d left join b using (r) left join c using (r)
"""
