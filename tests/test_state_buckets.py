"""Stateful streams over buckets of keys: calls to the store do not grow with keys, keys keep their values."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_streams import files_of, stream

from strandline.streaming import stateful
from strandline.streaming.tables import appended


class Store:
    """Stands in for the handle and the states of one group, and counts the calls."""

    def __init__(self):
        self.calls, self.values = 0, {}

    def getListState(self, name, schema):
        return State(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer


class State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self):
        self.store.calls += 1
        return self.store.values

    def get(self):
        return self._call()[self.name]

    def exists(self):
        return self.name in self._call()

    def put(self, value):
        self._call()[self.name] = value

    update = put

    def appendList(self, value):
        self._call().setdefault(self.name, []).extend(value)

    def clear(self):
        self._call().pop(self.name, None)


class Watermark:
    def __init__(self, at_s):
        self.at_s = at_s

    def getCurrentWatermarkInMs(self):
        return self.at_s * 1000


@pytest.mark.parametrize("members", [1, 500])
def test_calls_to_the_store_do_not_grow_with_keys(members):
    store, alive = Store(), stateful._Liveness("k", 30, 90, 200)
    alive.init(store)
    beats = pd.DataFrame({"k": [str(k) for k in range(members)] * 2, "ts_s": [10] * members + [60] * members})
    assert list(alive.handleInputRows((0,), iter([beats]), None)) == []
    changes = pd.concat([frame for at in (50, 1000) for frame in alive.handleExpiredTimer((0,), Watermark(at), None)])
    by_key = changes.groupby("k").apply(lambda c: list(zip(c.at_s, c.status)), include_groups=False)
    assert len(by_key) == members and store.values == {}
    assert all(c == [(10, "ONLINE"), (40, "SUSPECT"), (60, "ONLINE"), (90, "SUSPECT"), (150, "OFFLINE"), (260, "EVICTED")] for c in by_key)
    assert store.calls < 40


@pytest.mark.parametrize("buckets", [1, 64])
def test_keys_keep_their_values(spark, tmp_path, rows, buckets):
    """Whole numbers beyond doubles beside a null key."""
    big = 2**60
    beat = lambda agent, ts_s: {"agent": agent, "seq": None, "ts_s": ts_s, "holds": True}
    beats = [beat(agent, ts_s) for agent in (None, big, big + 1) for ts_s in (100, 110)]
    files_of(tmp_path / "in", [beats, [beat(1, 500)]])
    source = lambda: stream(spark, tmp_path / "in", "agent long, seq long, ts_s long, holds boolean")
    held = stateful.sustained_stream(source(), ["agent"], F.col("seq"), F.col("ts_s"), F.col("holds"), 50, "0 seconds", buckets)
    assert held.schema["agent"].dataType == source().schema["agent"].dataType
    assert sorted(rows(appended(held, "held")), key=str) == sorted([(k, 100, 150) for k in (None, big, big + 1)], key=str)
