"""Exact top-k inner products over a pivot-distance index.

With one more component sqrt(M - |v|^2) for every vector (M: the largest |v|^2) and 0 for a query, |q - v|^2 = |q|^2 + M - 2 q.v: the
largest inner products are the nearest vectors. Each vector is keyed by its nearest pivot and its distance to it; vectors sorted by that
key are cut into blocks, thin annuli around a pivot. From the k-th best score found so far a query knows its radius R, and by the triangle
inequality only annuli with some |d(q, p) - r| <= R, around pivots with d(q, p) - d(q, nearest pivot) <= 2 R, can hold anything better. The
search starts in the query's own annulus, expands to half of its radius and then to all of it, the radius shrinking with every step, and
stops there: what lies outside is worse by these bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, save, table, worker

#: Pivots are the means, after a few rounds, of a sample by hash of about so many vectors (twice as many at most). Any pivots give right
#: results; good ones leave less to search.
PIVOT_SAMPLE, PIVOT_ROUNDS, MOST_PIVOTS = 8192, 6, 512
#: Vectors of a block and queries of a query block, at most.
BLOCK, QUERY_BLOCK = 1024, 128
#: Shares of its radius that a query expands to, one search after another.
EXPANSIONS = (0.5, 1.0)


def quantise(x: Column, scale: int) -> Column:
    """floor(scale * x) as a double that holds a whole number."""
    y = x.cast("double") * float(scale)
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


class Space:
    """What tasks need of all vectors: dimension, largest squared norm, number types that keep whole numbers exact, and the pivots."""

    def __init__(self, dim: int, square: float, largest: float):
        self.dim, self.square = dim, square
        self.store = np.dtype(np.int16 if largest < 1 << 15 else np.float64)
        bound = max(dim, 1) * largest * largest
        self.exact = np.dtype(np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object)
        self.pivots = np.zeros((1, dim + 1))

    def rows(self, col: pa.Array) -> np.ndarray:
        """A column of lists as a matrix; shorter vectors end in zeros."""
        n = np.asarray(col.value_lengths()).astype(np.int64)
        flat = np.asarray(col.flatten(), np.float64)
        if len(n) and (n == self.dim).all():
            return flat.reshape(len(n), self.dim)
        out = np.zeros((len(n), self.dim))
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
        return out

    def lift(self, v: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.square - (v * v).sum(axis=1), 0)
        return np.column_stack([v, np.sqrt(rest)])

    def distances(self, v: np.ndarray) -> np.ndarray:
        """From each row (dim + 1 components) to each pivot; differences of large squares are kept from going below 0."""
        d = (v * v).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * (v @ self.pivots.T)
        return np.sqrt(np.maximum(d, 0))

    def slack(self) -> float:
        """More than rounding can change in a distance: a difference of squares up to 8 * square, off by some 1e-15 of it, under a root."""
        return 1e-6 * np.sqrt(self.square) + 1e-9

    def pack(self, v: np.ndarray) -> bytes:
        return np.ascontiguousarray(v.astype(self.store)).tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        v = np.frombuffer(data, self.store).reshape(-1, self.dim) if self.dim else np.zeros((0, 0))
        return v.astype(np.int64).astype(object) if self.exact == object and self.store != np.float64 else np.array([[int(x) for x in r] for r in v], object).reshape(v.shape) if self.exact == object else v.astype(self.exact)


def fit_pivots(space: Space, sample: np.ndarray, k: int) -> None:
    """Means of the sample after a few rounds, started from vectors drawn far from those before."""
    x = space.lift(sample)
    rng = np.random.default_rng(0)
    chosen = x[[int(rng.integers(len(x)))]]
    far = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k and far.sum() > 0:
        new = x[int(rng.choice(len(x), p=far / far.sum()))]
        chosen, far = np.vstack([chosen, new]), np.minimum(far, ((x - new) ** 2).sum(axis=1))
    space.pivots = chosen
    for _ in range(PIVOT_ROUNDS):
        near = space.distances(x).argmin(axis=1)
        n = np.bincount(near, minlength=len(chosen))
        sums = np.zeros_like(space.pivots)
        np.add.at(sums, near, x)
        space.pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], space.pivots)


def _best(scores: np.ndarray, first: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row (greatest score, then least first) that reach the row's floor."""
    row, col = np.nonzero(scores >= floor[:, None])
    if not len(row):
        return row, col
    s = scores[row, col]
    order = np.lexsort((first[col], -s, row)) if s.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -s[i], first[col[i]])))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(len(scores)))
    take = np.arange(len(row)) - start[row] < k
    return row[take], col[take]


def _floors(values: list) -> np.ndarray:
    """Floors as doubles, a little lower where a double may not hold the whole number; none is the lowest of all."""
    f = np.array([-np.inf if x is None else x for x in values], np.float64)
    return np.where(np.isfinite(f) & (np.abs(f) > 1 << 52), f - np.abs(f) * 1e-12, f)


_FOUND = "q long, u long, score long, n int, first long"


def _found(q, u, s, n, first) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(q, np.int64)), pa.array(np.asarray(u, np.int64)), pa.array(s.astype(np.int64)), pa.array(np.asarray(n, np.int32)), pa.array(np.asarray(first, np.int64))], names=["q", "u", "score", "n", "first"])


class Index:
    """The index over vec_id and embedding of a table, and searches in it.

    Equal vectors are one entry with their k + 1 least ids (no query can use more of them), so a vector that a third of all rows
    share costs as much as any other. Only the sums over all vectors, the sample and the pivots (bounded numbers of rows) meet at the driver.
    """

    def __init__(self, vectors: DataFrame, k: int = 5, scale: int = 256, is_query: Column | None = None, scratch: Scratch | None = None):
        self.k, self.spark = k, vectors.sparkSession
        self.scratch = scratch or Scratch(self.spark, "nearest")
        whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        asked = F.col("vec_id") % 50 == 0 if is_query is None else F.coalesce(is_query, F.lit(False))
        rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: quantise(x, scale)).alias("v"), asked.alias("asked")).distinct()
        self.rows = self.scratch.save(rows, "rows")
        least = Window.partitionBy("v", "asked").orderBy("vec_id")
        each = self.rows.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
        self.entries = self.scratch.save(each.withColumn("u", F.monotonically_increasing_id()), "entries")
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        n, self.asked, dim, most, largest = self.entries.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("v")), F.max(square), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
        self.n, self.space = n, Space(dim or 0, most or 0.0, largest or 0.0)
        if n:
            some = self.entries.where(F.pmod(F.xxhash64("v"), F.lit(n)) < PIVOT_SAMPLE) if n > PIVOT_SAMPLE else self.entries
            sample = some.select("v").limit(2 * PIVOT_SAMPLE).toArrow()
            fit_pivots(self.space, self.space.rows(sample["v"].combine_chunks()), int(min(MOST_PIVOTS, max(1, round(n**0.5 / 8)))))
        self.blocks = self.scratch.save(self._blocks(), "blocks")

    def _parts(self, n: int, size: int) -> int:
        """Partitions of some blocks each, and enough of them for all cores."""
        return max(1, min(-(-n // size), max(-(-n // (16 * size)), int(self.spark.conf.get("spark.sql.shuffle.partitions")))))

    def _keyed(self, df: DataFrame, extra: str) -> DataFrame:
        """df (v and more) with cell and dist."""
        space = self.space

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                d = space.distances(space.lift(space.rows(b.column("v"))))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], names=[*b.schema.names, "cell", "dist"])

        return df.mapInArrow(worker(key), f"{extra}, cell int, dist double")

    def _blocks(self) -> DataFrame:
        """block, cell, lo, hi, asked, and for its vectors u, first (least id), n (ids), q (whether it is asked), data."""
        keyed = self._keyed(self.entries.select("u", "v", F.element_at("ids", 1).alias("first"), F.size("ids").alias("n"), F.col("asked").alias("q")), "u long, v array<double>, first long, n int, q boolean")
        space = self.space

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            made, held, rows, cell = TaskContext.get().partitionId() << 32, [], 0, None

            def block() -> pa.RecordBatch:
                nonlocal made
                t = pa.Table.from_batches(held).combine_chunks()
                col = lambda c: t[c].combine_chunks()
                out = [[made], [cell], [t["dist"][0].as_py()], [t["dist"][-1].as_py()], [any(t["q"].to_pylist())], *(pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), col(c)) for c in ("u", "first", "n", "q")), [space.pack(space.rows(col("v")))]]
                made += 1
                types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), None, None, None, None, pa.binary()]
                return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(out, types)], names=["block", "cell", "lo", "hi", "asked", "u", "first", "n", "q", "data"])

            for b in batches:
                cells = b.column("cell").to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
                for a, z in zip(edges[:-1], edges[1:]):
                    while a < z:
                        if held and (cells[a] != cell or rows == BLOCK):
                            yield block()
                            held, rows = [], 0
                        take = min(z - a, BLOCK - rows)
                        cell = int(cells[a])
                        held.append(b.slice(a, take))
                        rows, a = rows + take, a + take
            if held:
                yield block()

        dealt = keyed.repartitionByRange(self._parts(self.n, BLOCK), "cell", "dist", "u").sortWithinPartitions("cell", "dist", "u")
        return dealt.mapInArrow(worker(pack), "block long, cell int, lo double, hi double, asked boolean, u array<long>, first array<long>, n array<int>, q array<boolean>, data binary")

    def _seeds(self) -> DataFrame:
        """What each asked vector finds in its own block."""
        space, k = self.space, self.k + 1

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    v, u, first, n = space.unpack(r["data"]), np.array(r["u"]), np.array(r["first"]), np.array(r["n"])
                    mine = np.flatnonzero(r["q"])
                    v = v if len(v) else np.zeros((len(u), 0), space.exact)
                    for at in range(0, len(mine), QUERY_BLOCK):
                        own = mine[at : at + QUERY_BLOCK]
                        s = _times(v[own], v)
                        row, col = _best(s, first, np.full(len(own), -np.inf), k)
                        yield _found(u[own[row]], u[col], s[row, col], n[col], first[col])

        return self.blocks.where("asked").select("u", "first", "n", "q", "data").mapInArrow(worker(search), _FOUND)

    def _floors(self, found: DataFrame) -> DataFrame:
        """q, floor: a score that k + 1 rows reach, the query's own among them perhaps; null if so many are not found."""
        at = Window.partitionBy("q").orderBy(F.desc("score"), "first").rowsBetween(Window.unboundedPreceding, 0)
        return found.withColumn("rows", F.sum("n").over(at)).where(F.col("rows") > self.k).groupBy("q").agg(F.max("score").alias("floor"))

    def _top(self, found: DataFrame) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
        return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= self.k + 1).drop("_r")

    def _query_blocks(self) -> DataFrame:
        """qb, and for its queries q, home (block), data. Made once: later rounds must meet the same blocks."""
        space = self.space
        mine = self.blocks.where("asked").select("block", F.explode(F.arrays_zip("u", "q")).alias("x")).where("x.q").select(F.col("x.u").alias("q"), "block")
        asked = self.entries.where("asked").select(F.col("u").alias("q"), "v").join(mine, "q")
        keyed = self._keyed(asked.select("q", "v", F.col("block").alias("home")), "q long, v array<double>, home long")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            made, held, rows = TaskContext.get().partitionId() << 32, [], 0

            def block() -> pa.RecordBatch:
                nonlocal made
                t = pa.Table.from_batches(held).combine_chunks()
                lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks()) for c in ("q", "home")]
                made += 1
                return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), *lists, pa.array([space.pack(space.rows(t["v"].combine_chunks()))], pa.binary())], names=["qb", "q", "home", "data"])

            for b in batches:
                a = 0
                while a < b.num_rows:
                    take = min(b.num_rows - a, QUERY_BLOCK - rows)
                    held.append(b.slice(a, take))
                    rows, a = rows + take, a + take
                    if rows == QUERY_BLOCK:
                        yield block()
                        held, rows = [], 0
            if held:
                yield block()

        dealt = keyed.repartitionByRange(self._parts(max(1, self.asked), QUERY_BLOCK), "cell", "dist", "q").sortWithinPartitions("cell", "dist", "q")
        return dealt.mapInArrow(worker(pack), "qb long, q array<long>, home array<long>, data binary")

    def _with_floors(self, blocks: DataFrame, found: DataFrame) -> DataFrame:
        """blocks with floor, one for each of q."""
        floors = blocks.select("qb", F.posexplode("q").alias("pos", "q")).join(self._floors(found), "q", "left")
        lists = floors.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("floor").cast("double").alias("floor")))).alias("x"))
        return blocks.join(lists.select("qb", F.col("x.floor").alias("floor")), "qb")

    def _reach(self, asked: DataFrame, share: float) -> DataFrame:
        """qb, block: the annuli that some query of the block reaches with that share of its radius."""
        space = self.space

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for qb, floor, data in zip(b.column("qb").to_pylist(), b.column("floor").to_pylist(), b.column("data").to_pylist()):
                    v = np.frombuffer(data, space.store).reshape(len(floor), space.dim).astype(np.float64)
                    d = space.distances(np.column_stack([v, np.zeros(len(v))]))
                    floors = _floors(floor)
                    r = np.sqrt(np.maximum((v * v).sum(axis=1) + space.square - 2 * floors, 0)) * share + space.slack()
                    in_reach = d - d.min(axis=1, keepdims=True) <= 2 * r[:, None]
                    near, far = np.where(in_reach, d - r[:, None], np.inf).min(axis=0), np.where(in_reach, d + r[:, None], -np.inf).max(axis=0)
                    c = np.flatnonzero(in_reach.any(axis=0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), qb)), pa.array(c.astype(np.int32)), pa.array(near[c]), pa.array(far[c])], names=["qb", "cell", "a", "z"])

        rings = asked.select("qb", "floor", "data").mapInArrow(worker(cells), "qb long, cell int, a double, z double")
        return rings.join(self.blocks.select("block", "cell", "lo", "hi"), "cell").where("hi >= a and lo <= z").select("qb", "block")

    def _search(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """What the queries of each pair find in its block, if it reaches their floor."""
        space, k = self.space, self.k + 1

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {c: batch.column(c)[i] for c in ("block", "q", "home", "floor", "asked_data", "u", "first", "n", "data")}
                    q, u = (np.asarray(r[c].values) for c in ("q", "u"))
                    floor = np.where(np.asarray(r["home"].values) == r["block"].as_py(), np.inf, _floors(r["floor"].values.to_pylist()))
                    v, w = space.unpack(r["data"].as_py()), space.unpack(r["asked_data"].as_py())
                    s = _times(w if len(w) else np.zeros((len(q), 0), space.exact), v if len(v) else np.zeros((len(u), 0), space.exact))
                    first, n = np.asarray(r["first"].values), np.asarray(r["n"].values)
                    row, col = _best(s, first, floor, k)
                    if len(row):
                        yield _found(q[row], u[col], s[row, col], n[col], first[col])

        both = pairs.join(asked.withColumnRenamed("data", "asked_data"), "qb").join(self.blocks.select("block", "u", "first", "n", "data"), "block")
        return both.select("block", F.col("q"), "home", "floor", "asked_data", "u", "first", "n", "data").mapInArrow(worker(search), _FOUND)

    def search(self) -> DataFrame:
        """q, top: for each asked entry its k + 1 best rows (score, vec_id), best first."""
        found, seen = self.scratch.save(self._seeds(), "found"), None
        blocks = self.scratch.save(self._query_blocks(), "queries")
        for share in EXPANSIONS if self.asked else ():
            asked = self.scratch.save(self._with_floors(blocks, found), "asked")
            rounds = self._reach(asked, share)
            if seen is not None:
                rounds = rounds.join(seen, ["qb", "block"], "left_anti")
            pairs = self.scratch.save(rounds, "pairs")
            seen = pairs if seen is None else seen.unionByName(pairs)
            found = self.scratch.save(self._top(found.unionByName(self._search(pairs, asked))), "found")
        each = found.join(self.entries.select("u", "ids"), "u").select("q", "score", F.explode("ids").alias("vec_id"))
        return each.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "vec_id"))), 1, self.k + 1).alias("top"))


def _times(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products; those of Python's numbers end at the ends of a long."""
    if q.dtype != object:
        return q @ v.T
    ends = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    return np.array([[ends(sum((a * b for a, b in zip(x, y)), 0)) for y in v] for x in q], object).reshape(len(q), len(v))


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, is_query: Column | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k rows with the greatest inner product of the vectors
    floor(scale * x), ties to the smaller vec_id; all of them, if there are fewer.

    vectors: vec_id (whole numbers), embedding (array of numbers); other columns are not read, whatever their names. is_query: a
    condition on a row (None: vec_id divisible by 50). All rows of other ids are candidates. Rows whose vector or id is null, or whose vector
    holds a null, NaN or infinite component, take no part. Rows equal in id and vector count once. An id with several vectors is
    a candidate with each of them, and as a query it is its least one. Shorter vectors end in zeros; an empty one has score 0 with all.
    Scores are exact at any size of component, and one beyond a long is given as the end of its range. An empty table, or one without
    queries, gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    index = Index(vectors, k, scale, is_query, scratch)
    asked = index.rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v"))
    found = index.search().join(index.entries.select(F.col("u").alias("q"), "v"), "q").select("v", "top")
    own = asked.withColumnRenamed("vec_id", "query_id").join(found, "v")
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = save(own.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.score")).alias("score")), "nearest-result")
    scratch.drop()
    return out


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score from e q join e c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""
