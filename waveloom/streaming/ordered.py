"""Streams whose packets arrive late, twice, or never: each stream's rows are put in order before a step sees them.

One step function per operator, `step(state, rows in order) -> rows`, serves three ways of running:

* a batch: streams dealt by key and sorted inside partitions, rows passed on in pieces, so no stream is held whole;
* a stream in order of seq (`in_order`): a state processor keeps the next number, the step's state and, in a list, the packets that came before
  their turn, until those before them are there or a timer gives them up;
* a stream in order of event time (`by_event_time`): rows wait until the watermark of all inputs has passed them.

State is typed: each step names its fields (`Array` for arrays), which are Arrow columns with one row for each stream. A call of a
state processor and of its state costs milliseconds however little it does, so streams are dealt to a fixed number of buckets by a hash,
and a bucket, not a stream, is the key of a call: a micro-batch costs its rows and the streams of the buckets it touches. Rows of state go to
Spark packed in parts of many rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict, pd.DataFrame], pd.DataFrame]
#: Keys of state calls: a bucket holds the state of its share of the streams in memory during a call. Bytes of a part of packed state, about.
BUCKETS, PART_BYTES = 256, 1 << 22
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Array:
    """A state field that is an array with `tail` as its shape but for the first axis."""

    tail: tuple[int, ...] = ()
    numbers: str = "double"  # or complex

    def flat(self, x) -> np.ndarray:
        """The numbers of an array one after another, real and imaginary parts of complex ones."""
        return np.ascontiguousarray(x, complex if self.numbers == "complex" else float).reshape(-1).view(float)

    def shaped(self, flat: np.ndarray) -> np.ndarray:
        return (flat.view(complex) if self.numbers == "complex" else flat).reshape(-1, *self.tail)


Fields = dict[str, "str | Array"]


def of_columns(fn: Callable[[dict, dict], dict]) -> Step:
    """A step made from fn(state, columns as arrays) -> columns; state processors call fn itself, as a frame for each of many short streams costs
    more than what is done with it."""
    def step(state: dict, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fn(state, {c: pdf[c].to_numpy() for c in pdf}))

    step.of_columns = fn
    return step


def _on_columns(step: Step) -> Callable[[dict, dict], dict]:
    if hasattr(step, "of_columns"):
        return step.of_columns

    def fn(state: dict, columns: dict) -> dict:
        out = step(state, pd.DataFrame({c: v if v.dtype != object else list(v) for c, v in columns.items()}))
        return {c: out[c].to_numpy() for c in out}

    return fn


class Packed:
    """A list state of rows in parts, each an Arrow stream of many rows with typed columns: Spark's state passes its rows on one by one, for a
    tenth of a millisecond each or more, so it gets a few parts instead."""

    schema = "part binary"

    def __init__(self, state):
        self.state = state

    def tables(self) -> list[pa.Table]:
        return [pa.ipc.open_stream(pa.py_buffer(row[0])).read_all() for row in self.state.get()] if self.state.exists() else []

    def put(self, table: pa.Table) -> None:
        if table.num_rows:
            self.state.put(self._parts(table))
        else:
            self.state.clear()

    def append(self, table: pa.Table) -> None:
        if table.num_rows:
            self.state.appendList(self._parts(table))

    @staticmethod
    def _parts(table: pa.Table) -> list[tuple[bytes]]:
        size, parts = max(1, table.num_rows * PART_BYTES // max(table.nbytes, 1)), []
        for at in range(0, table.num_rows, size):
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, table.schema) as stream:
                    stream.write_table(table.slice(at, size))
                parts.append((sink.getvalue().to_pybytes(),))
        return parts

    @property
    def rows(self) -> list[tuple]:
        return [row for t in self.tables() for row in zip(*(c.to_pylist() for c in t.columns))]


def _field(kind: str | Array, values: list) -> pa.Array:
    """A field of many states as a column."""
    if not isinstance(kind, Array):
        return pa.array([v.item() if isinstance(v, np.generic) else v for v in values])
    parts = [None if v is None else kind.flat(v) for v in values]
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in parts)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0), *(v for v in parts if v is not None)])), mask=pa.array([v is None for v in parts], pa.bool_()))


def _values(kind: str | Array, column: pa.ChunkedArray) -> list:
    """The field of each state from its column."""
    if not isinstance(kind, Array):
        return column.to_pylist()
    out = []
    for c in column.chunks:
        flat, ends = np.array(c.values), c.offsets.to_numpy()  # a copy, which steps may change
        out += [kind.shaped(flat[a:b]) if there else None for a, b, there in zip(ends[:-1].tolist(), ends[1:].tolist(), c.is_valid().to_numpy(zero_copy_only=False))]
    return out


def _nested(kind: str) -> bool:
    """Columns of which Arrow would not give the same values back."""
    return any(k in kind for k in ("struct<", "map<", "variant"))


def _packed(rows: pd.DataFrame, kinds: dict[str, str]) -> pa.Table:
    """Rows that wait as a table. A null in a column of whole numbers, which pandas makes NaN, is null."""
    return pa.table({c: pa.array([pickle.dumps(v) for v in rows[c]], pa.binary()) if _nested(k) else pa.array(rows[c], from_pandas=True) for c, k in kinds.items()})


def _unpacked(table: pa.Table, kinds: dict[str, str]) -> pd.DataFrame:
    rows = table.to_pandas()
    for c in (c for c, k in kinds.items() if _nested(k)):
        rows[c] = [pickle.loads(v) for v in rows[c]]
    return rows


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need this store; a provider that the session has set itself stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, PROVIDER)


def as_batch(rows: DataFrame, order: list[str], schema: str, step: Step, key: str, once: bool = False, piece: int = 4096) -> DataFrame:
    """The steps over a table: each stream in order of `order` (once: the first row of each value of it), in pieces of at most `piece` rows
    with the state between them. A stream is worked on by one task, in memory that does not grow with it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, started, last = None, {}, False, None
        for batch in batches:
            for at in range(0, len(batch), piece):
                part = batch.iloc[at : at + piece]
                for k, some in part.groupby((part[key] != part[key].shift()).cumsum(), sort=False):
                    k = some[key].iloc[0]
                    if not started or not (k == current or (pd.isna(k) and pd.isna(current))):
                        current, state, started, last = k, {}, True, None
                    if once:
                        numbers = some[order[0]]
                        some = some[(numbers != numbers.shift()) & (numbers != last)]
                        if not len(some):
                            continue
                        last = some[order[0]].iloc[-1]
                    out = step(state, some.reset_index(drop=True))
                    out.insert(0, key, pd.Series([k] * len(out), dtype=batch[key].dtype))
                    yield out

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Bucket(StatefulProcessor):
    """The streams of a bucket. streams: a row for each, its key, the `marks` and the step's state; held: rows that wait."""

    marks: tuple[str, ...] = ()

    def __init__(self, step: Step, fields: Fields, key: str, kinds: dict[str, str]):
        self.run, self.fields, self.key, self.kinds, self.columns = _on_columns(step), fields, key, kinds, list(kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streams, self.held = (Packed(handle.getListState(name, Packed.schema)) for name in ("streams", "held"))

    def _read(self) -> dict:
        """For each stream, by key, its marks and the dict of its step; a null key is None. Fields that are null are left out, as the steps leave
        out what they have not set."""
        streams, names = {}, list(self.fields)
        for t in self.streams.tables():
            keys, *marks = (c.to_pylist() for c in t.columns[: 1 + len(self.marks)])
            columns = [_values(k, t.column(1 + len(self.marks) + i)) for i, k in enumerate(self.fields.values())]
            for i, k in enumerate(keys):
                streams[k] = [*(m[i] for m in marks), {n: c[i] for n, c in zip(names, columns) if c[i] is not None}]
        return streams

    def _write(self, streams: dict) -> None:
        rows, n = list(streams.values()), len(self.marks)
        marks = [pa.array([row[i] for row in rows], pa.int64()) for i in range(n)]
        fields = [_field(k, [row[n].get(name) for row in rows]) for name, k in self.fields.items()]
        self.streams.put(pa.Table.from_arrays([pa.array(list(streams)), *marks, *fields], [self.key, *(f"_{m}" for m in self.marks), *(f"_state_{f}" for f in self.fields)]))

    def _waiting(self) -> list[pd.DataFrame]:
        """The rows that wait as one frame, if there are any."""
        parts = [_unpacked(t, self.kinds) for t in self.held.tables()]
        return [pd.concat(parts, ignore_index=True)] if parts else []

    def _wait(self, rows: pd.DataFrame) -> None:
        self.held.put(_packed(rows, self.kinds))

    def _timer(self, at: int | None) -> None:
        """The bucket's only timer."""
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None and at not in timers:
            self.handle.registerTimer(at)

    def _numbered(self, rows: pd.DataFrame) -> tuple[np.ndarray, list]:
        """For each row the number of its stream, and the keys of the streams."""
        codes, keys = pd.factorize(rows[self.key], use_na_sentinel=False)
        whole = self.kinds[self.key] in ("bigint", "int", "smallint", "tinyint")
        return codes, [None if pd.isna(k) else int(k) if whole else k for k in keys]

    def _steps(self, codes: np.ndarray, keys: list, rows: pd.DataFrame, streams: dict) -> Iterator[pd.DataFrame]:
        """The step over rows that are sorted by codes; its state is the last entry of a stream."""
        if not len(rows):
            return
        columns = {c: rows[c].to_numpy() for c in self.columns if c != self.key}
        ends = np.append(np.flatnonzero(np.diff(codes)) + 1, len(codes)).tolist()
        outs, names, sizes, start = [], [], [], 0
        for end in ends:
            k = keys[codes[start]]
            out = self.run(streams[k][-1], {c: v[start:end] for c, v in columns.items()})
            n = len(next(iter(out.values())))
            if n:
                outs.append(out)
                names.append(k)
                sizes.append(n)
            start = end
        if outs:
            whole = {c: [o[c] for o in outs] for c in outs[0]}
            arrays = {c: all(isinstance(v, np.ndarray) and v.ndim == 1 for v in parts) for c, parts in whole.items()}
            yield pd.DataFrame({self.key: np.repeat(np.array(names, object), sizes)} | {c: np.concatenate(parts) if arrays[c] else [v for part in parts for v in part] for c, parts in whole.items()})


class InOrder(Bucket):
    """Rows of a stream to the step in order of seq, a whole number that goes up by one from packet to packet.

    Marks of a stream: the next number, how many packets were given up, how many rows came too late or twice, when the gap before its held
    packets is given up, and when a packet last changed it. held: rows before their turn.
    """

    marks = ("next", "lost", "dropped", "due", "changed")

    def __init__(self, step: Step, fields: Fields, key: str, kinds: dict[str, str], seq: str, first: int, wait_ms: int | None, idle_ms: int | None):
        super().__init__(step, fields, key, kinds)
        self.seq, self.first, self.wait_ms, self.idle_ms = seq, first, wait_ms, idle_ms

    def _now(self, timerValues) -> int:  # noqa: N803
        return 0 if self.wait_ms is None and self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()

    def _live(self, now: int) -> dict:
        """The streams without those that are idle."""
        streams = self._read()
        return streams if self.idle_ms is None else {k: row for k, row in streams.items() if row[4] + self.idle_ms > now}

    def _go_on(self, streams: dict, waiting: list[pd.DataFrame], new: list[pd.DataFrame], now: int) -> Iterator[pd.DataFrame]:
        """Packets whose turn it is to the step; the others wait."""
        kept, held = sum(len(r) for r in waiting), len(waiting) > 0
        every = pd.concat([*waiting, *new], ignore_index=True)
        codes, keys = self._numbered(every)
        live = np.array([k in streams for k in keys])
        if kept and not live.all():  # what idle streams held goes with them
            stay = live[codes] | (np.arange(len(every)) >= kept)
            every, codes, kept = every[stay], codes[stay], int(stay[:kept].sum())
        for k in np.unique(codes[kept:]).tolist():
            streams.setdefault(keys[k], [self.first, 0, 0, None, now, {}])[4] = now
        next_ = np.array([streams[k][0] if k in streams else 0 for k in keys])
        seq = every[self.seq].to_numpy()
        order = np.lexsort((np.arange(len(seq)), seq, codes))  # the first of equal numbers counts
        codes, seq = codes[order], seq[order]
        use = seq >= next_[codes]
        use[1:] &= ~((seq[1:] == seq[:-1]) & (codes[1:] == codes[:-1]))
        dropped = np.bincount(codes[~use], minlength=len(keys))
        codes, seq, every = codes[use], seq[use].astype("int64"), every.iloc[order[use]]
        place = np.arange(len(codes)) - np.searchsorted(codes, codes)
        ready = seq == next_[codes] + place  # numbers ascend without repetition, so this ends at the first gap
        done, rest = np.bincount(codes[ready], minlength=len(keys)), np.bincount(codes[~ready], minlength=len(keys))
        for k, name in enumerate(keys):
            row = streams.get(name)
            if row is not None:
                row[0], row[2] = row[0] + int(done[k]), row[2] + int(dropped[k])
                if not rest[k] or self.wait_ms is None:
                    row[3] = None
                elif row[3] is None or done[k]:  # a new gap
                    row[3] = now + self.wait_ms
        yield from self._steps(codes[ready], keys, every[ready], streams)
        if held or not ready.all():
            self._wait(every[~ready])
        self._write(streams)
        if self.wait_ms is not None or self.idle_ms is not None:
            ends = [t for row in streams.values() for t in (row[3], None if self.idle_ms is None else row[4] + self.idle_ms) if t is not None]
            self._timer(min(ends, default=None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = self._now(timerValues)
        yield from self._go_on(self._live(now), self._waiting(), [r[self.columns] for r in rows], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = self._now(timerValues)
        streams, waiting = self._live(now), self._waiting()
        if waiting:
            codes, keys = self._numbered(waiting[0])
            least = waiting[0][self.seq].groupby(codes).min()
            for k, name in enumerate(keys):
                row = streams.get(name)
                if row is not None and row[3] is not None and row[3] <= now:
                    row[1], row[0], row[3], row[4] = row[1] + int(least[k]) - row[0], int(least[k]), None, now
            yield from self._go_on(streams, waiting, [], now)
        else:
            self._write(streams)
            self._timer(min((row[4] + self.idle_ms for row in streams.values()), default=None) if self.idle_ms is not None else None)


def _in_buckets(rows: DataFrame, key: str, buckets: int):
    """Rows by bucket; a null key has one of its own, as it would make floats of the whole numbers beside it."""
    return rows.withColumn("_bucket", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(buckets))).otherwise(-1)).groupBy("_bucket")


def in_order(rows: DataFrame, seq: str, schema: str, step: Step, fields: Fields, key: str = "stream_id", first: int = 0, wait_ms: int | None = None, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """step(state, rows in order of seq) per stream; step changes the dict, whose entries are `fields`.

    On a stream, seq counts packets from `first` on without gaps, in whatever order and micro-batch they arrive. A packet waits for those
    before it; without a wait_ms, for as long as it takes. wait_ms after a gap has first held one up, the missing packets count as lost: the step goes on with the next packet there
    is, right behind the last one, and the next gap gets a new wait. A packet that comes after it was given up, or a second time, is dropped. Both are
    counted in the state. State of a stream that no packet has changed for idle_ms is dropped (so idle_ms should exceed wait_ms, and wait_ms the time of some micro-batches): its next packet
    starts anew. With wait_ms or idle_ms, a query that runs to the end of a bounded source needs
    spark.sql.streaming.noDataMicroBatches.enabled=false when it starts, or it waits for timers for ever. In a batch seq need not be without gaps: rows are taken in its order, and one of equal numbers counts.
    """
    kind = rows.schema[key].dataType.simpleString()
    full = f"{key} {kind}, {schema}"
    if not rows.isStreaming:
        return as_batch(rows, [seq], full, step, key, once=True)
    use_rocksdb(rows.sparkSession)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    processor = InOrder(step, fields, key, kinds, seq, first, wait_ms, idle_ms)
    return _in_buckets(rows, key, buckets).transformWithStateInPandas(processor, full, "append", "None" if wait_ms is None and idle_ms is None else "ProcessingTime")


class ByEventTime(Bucket):
    """Rows of a stream to the step in order, once the watermark has passed them."""

    def __init__(self, step: Step, fields: Fields, key: str, kinds: dict[str, str], order: list[str], time: str):
        super().__init__(step, fields, key, kinds)
        self.order, self.time = order, time

    def _ms(self, rows: pd.DataFrame) -> pd.Series:
        """The first whole millisecond after each row's time."""
        return rows[self.time].astype("int64") // 1_000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat([r[self.columns] for r in rows], ignore_index=True)
        self.held.append(_packed(new, self.kinds))
        self._timer(min([int(self._ms(new).min()), *self.handle.listTimers()]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        every = self._waiting()[0]
        ms = self._ms(every)
        ready = ms <= timerValues.getCurrentWatermarkInMs()
        if ready.any():
            now = every[ready]
            codes, keys = self._numbered(now)
            now = now.assign(_code=codes).sort_values(["_code", *self.order], kind="stable", ignore_index=True)
            streams = self._read()
            for k in keys:
                streams.setdefault(k, [{}])
            yield from self._steps(now["_code"].to_numpy(), keys, now, streams)
            self._write(streams)
            self._wait(every[~ready])
        if not ready.all():
            self.handle.registerTimer(int(ms[~ready].min()))


def by_event_time(rows: DataFrame, order: list[str], schema: str, step: Step, fields: Fields, key: str = "stream_id", time: str = "us", buckets: int = BUCKETS) -> DataFrame:
    """As in_order, by event time: rows has a watermark (of several inputs, the least holds), and `time` in microseconds as a long, the
    first of `order`. Rows wait for the watermark, so what arrives within its delay is in order; what is later, Spark drops."""
    full = f"{key} {rows.schema[key].dataType.simpleString()}, {schema}"
    if not rows.isStreaming:
        return as_batch(rows, order, full, step, key)
    use_rocksdb(rows.sparkSession)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns if rows.schema[c].dataType.typeName() != "timestamp"}
    return _in_buckets(rows, key, buckets).transformWithStateInPandas(ByEventTime(step, fields, key, kinds, order, time), full, "append", "EventTime")


def microseconds(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp column."""
    return F.unix_micros(F.col(ts).cast("timestamp"))
