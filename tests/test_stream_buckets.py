"""State calls of streams do not grow with the number of streams; slices of many files lose no rows."""

import datetime

import numpy as np
import pandas as pd

from waveloom.plans import registry
from waveloom.streaming import ordered


class Listed:
    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def exists(self):
        self.calls.append("exists")
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Handle:
    """Stands for Spark's, and notes the calls."""

    def __init__(self):
        self.calls = []

    def getListState(self, name, schema, ttl=None):  # noqa: N802
        return Listed(self.calls)


def test_one_call_for_many_streams():
    def step(state, pdf):
        state["sum"] = state.get("sum", 0.0) + pdf["v"].sum()
        return pd.DataFrame({"last": [pdf["seq"].iloc[-1]], "sum": [state["sum"]]})

    n = 500
    p = ordered.InOrder(step, {"sum": "double"}, "stream_id", {"stream_id": "bigint", "seq": "bigint", "v": "double"}, "seq", 0, None, None)
    p.init(handle := Handle())
    rows = pd.DataFrame([(s, k, float(s + k)) for k in (0, 1, 3, 1) for s in range(n)], columns=["stream_id", "seq", "v"])  # 3 before 2, 1 twice
    late = pd.DataFrame([(s, 2, 0.5) for s in range(0, n, 2)], columns=rows.columns)
    first = pd.concat(p.handleInputRows((0,), iter([rows[:700], rows[700:]]), None))
    second = pd.concat(p.handleInputRows((0,), iter([late]), None))
    assert first["stream_id"].tolist() == list(range(n)) and set(first["last"]) == {1} and first["sum"].tolist() == [2.0 * s + 1 for s in range(n)]
    assert second["stream_id"].tolist() == list(range(0, n, 2)) and set(second["last"]) == {3} and second["sum"].tolist() == [3.0 * s + 4.5 for s in range(0, n, 2)]
    assert sorted(row[0] for row in p.held.rows) == list(range(1, n, 2)) and len(p.streams.rows) == n
    assert {row[0]: row[1:4] for row in p.streams.rows} == {s: (2 if s % 2 else 4, 0, 1) for s in range(n)}
    assert len(handle.calls) < 20


def test_slices_of_many_files(spark, tmp_path):
    r, start = np.random.default_rng(5), datetime.datetime(2024, 1, 1)
    rows = [(i, i % 9, start + datetime.timedelta(seconds=float(t)), "signup" if r.random() < 0.3 else "click", float(i % 31)) for i, t in enumerate(r.uniform(0, 60 * 86_400, 1500))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").repartition(9).write.parquet(f"{tmp_path}/events.parquet")
    q = registry.queries()
    name, small = "spark.sql.files.maxPartitionBytes", "1m"  # nine files in each slice
    before = spark.conf.get(name)
    spark.conf.set(name, small)
    try:
        got, want = (sorted(map(str, q[name](spark, str(tmp_path)).collect())) for name in ("w5_live_controls", "j7_asof_controls"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and len(want) > 900
