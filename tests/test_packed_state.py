"""State goes to Spark in a few parts however many streams there are, and comes back as it was; its partitions do not grow with the tables."""

import numpy as np
import pandas as pd

from waveloom.plans.stream_queries import state_partitions
from waveloom.streaming import ordered


class Listed:
    def __init__(self):
        self.got, self.passed = [], 0

    def exists(self):
        return bool(self.got)

    def get(self):
        self.passed += len(self.got)
        return iter(self.got)

    def put(self, rows):
        self.got = list(rows)
        self.passed += len(self.got)

    def appendList(self, rows):  # noqa: N802
        rows = list(rows)
        self.got, self.passed = self.got + rows, self.passed + len(rows)

    def clear(self):
        self.got = []


class Handle:
    def __init__(self):
        self.lists = []

    def getListState(self, name, schema, ttl=None):  # noqa: N802
        self.lists.append(Listed())
        return self.lists[-1]


def test_few_parts_for_many_streams():
    """Each row of a list state costs Spark a message of its own: there were 4,000 of them here."""
    def step(state, columns):
        state["last"] = np.concatenate([state.get("last", np.zeros((0, 2), complex)), [[s[0] + 1j, s[-1]] for s in columns["samples"]]])[-3:]
        if columns["seq"][0] % 2:
            state["odd"] = int(columns["seq"][0])
        state["n"] = state.get("n", 0) + len(columns["seq"])
        return {"seq": columns["seq"], "n": np.full(len(columns["seq"]), state["n"])}

    step.of_columns = step
    fields = {"last": ordered.Array((2,), "complex"), "n": "long", "odd": "long"}
    kinds = {"stream_id": "bigint", "seq": "bigint", "samples": "array<double>", "more": "struct<a:bigint,b:string>", "none": "string"}
    p = ordered.InOrder(step, fields, "stream_id", kinds, "seq", 0, None, None)
    p.init(handle := Handle())
    n = 1000
    rows = lambda seqs: pd.DataFrame({"stream_id": [s for s in range(n) for _ in seqs], "seq": [k for _ in range(n) for k in seqs], "samples": [np.array([s, k, 0.5 * k]) for s in range(n) for k in seqs], "more": [(s, "x") for s in range(n) for _ in seqs], "none": None})
    first = pd.concat(p.handleInputRows((0,), iter([rows([0, 2, 3])]), None))
    held = p._waiting()[0]
    assert held["more"].tolist() == [(s, "x") for s in range(n) for _ in range(2)] and held["none"].isna().all() and held["samples"].iloc[-1].tolist() == [n - 1, 3, 1.5]
    second = pd.concat(p.handleInputRows((0,), iter([rows([1])]), None))
    assert first["seq"].tolist() == [0] * n and second["seq"].tolist() == [1, 2, 3] * n and set(second["n"]) == {4}
    state = p._read()
    assert list(state) == list(range(n)) and all(row[0] == 4 and row[-1]["n"] == 4 and row[-1]["odd"] == 1 for row in state.values())
    assert state[7][-1]["last"].tolist() == [[7 + 1j, 0.5], [7 + 1j, 1], [7 + 1j, 1.5]]
    assert sum(x.passed for x in handle.lists) < 20


def test_parts_are_cut_by_size(monkeypatch):
    monkeypatch.setattr(ordered, "PART_BYTES", 10_000)
    kinds = {"stream_id": "bigint", "v": "array<double>"}
    p = ordered.ByEventTime(lambda state, columns: columns, {}, "stream_id", kinds, [], "stream_id")
    p.init(handle := Handle())
    rows = pd.DataFrame({"stream_id": pd.Series([None, *range(999)], dtype=float), "v": [np.full(5, float(i)) for i in range(1000)]})
    p.held.append(ordered._packed(rows[:500], kinds))
    p.held.append(ordered._packed(rows[500:], kinds))
    back = p._waiting()[0]
    assert back["stream_id"].equals(rows["stream_id"]) and all(np.array_equal(a, b) for a, b in zip(back["v"], rows["v"]))
    assert 4 <= len(handle.lists[1].got) < 20 and max(len(x[0]) for x in handle.lists[1].got) < 20_000


def test_partitions_of_state(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, "600")
    try:
        with state_partitions(spark):
            assert int(spark.conf.get(name)) <= 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get(name) == "600"
    finally:
        spark.conf.set(name, before)
