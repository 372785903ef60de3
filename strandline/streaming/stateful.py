"""Operators that keep state of their own per key: sustained conditions and liveness.

Rows wait in the state until the watermark has passed them and are then judged in order
of event time, so the result does not depend on how the input is cut into micro-batches
or in which order its files come. What follows from silence (a hold that is reached, a
member that stays away) comes from event-time timers and needs no further row of the key.
Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.streaming.alerts import EVICT_S, OFFLINE_S, SUSPECT_S

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that the keys of a stateful stream are spread over. A group's rows of a micro-batch are one task's work, its calls
#: to the state store one fixed cost a micro-batch. A stream that goes on must keep the number it began with.
BUCKETS = 1024


def use_state_store(spark: SparkSession) -> None:
    """Stateful operators with timers need the RocksDB state store; call before a query with them starts."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def _fields(**kinds: T.DataType) -> T.StructType:
    """A schema as an object: workers have no session to parse DDL with."""
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then steps over them in order.

    The group is a bucket of keys, so that calls to the state store are made per bucket and
    not per key or row: waiting rows are kept as packed chunks, the states of a bucket's
    keys as one packed table. A subclass has ``ROW`` and ``step(state, rows, upto)``, which
    takes one key's state and rows and gives the rows to emit, the state (None: forget the
    key) and the next moment at which something happens without a row, or None. Moments are
    seconds.
    """

    #: Columns of an input row beside the keys; the first is the moment, rows are ordered by all.
    ROW: T.StructType
    #: Rows of a packed chunk.
    CHUNK = 10_000

    def __init__(self, keys: Sequence[str], output: Sequence[str]):
        self.keys = list(keys)
        self.output = [*keys, *output]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _fields(earliest=T.LongType(), rows=T.BinaryType()))
        self.states = handle.getValueState("states", _fields(states=T.BinaryType()))
        self.timer = handle.getValueState("timer", _fields(at=T.LongType()))

    def step(self, state: tuple | None, rows: list[tuple], upto: int) -> tuple[list[tuple], tuple | None, int | None]:
        raise NotImplementedError

    def _wake(self, at: int | None) -> None:
        """One timer a bucket, at the earliest moment there is something to do."""
        known = self.timer.get()[0] if self.timer.exists() else None
        if at is None or (known is not None and known <= at):
            return
        if known is not None:
            self.handle.deleteTimer(known * 1000)
        self.handle.registerTimer(at * 1000)
        self.timer.update((at,))

    def _packed(self, rows: list[tuple]) -> list[tuple]:
        moment = len(self.keys)
        chunks = [rows[n : n + self.CHUNK] for n in range(0, len(rows), self.CHUNK)]
        return [(min(r[moment] for r in chunk), pickle.dumps(chunk, 5)) for chunk in chunks]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            keys = [[None if pd.isna(v) else v for v in frame[k].tolist()] for k in self.keys]
            chunks = self._packed(list(zip(*keys, *[frame[n].tolist() for n in self.ROW.names])))
            self.waiting.appendList(chunks)
            earliest = min(at for at, _ in chunks)
            first = earliest if first is None else min(first, earliest)
        self._wake(first)
        return iter(())

    def _due(self, upto: int) -> tuple[dict[tuple, list[tuple]], list[tuple]]:
        """Rows by key that the watermark has passed, taken out of the waiting ones; the chunks that go on waiting."""
        due, later, kept, width = {}, [], [], len(self.keys)
        for earliest, packed in self.waiting.get() if self.waiting.exists() else ():
            if earliest > upto:
                kept.append((earliest, bytes(packed)))
                continue
            for row in pickle.loads(bytes(packed)):
                if row[width] <= upto:
                    due.setdefault(row[:width], []).append(row[width:])
                else:
                    later.append(row)
        kept += self._packed(later)
        if due:
            self.waiting.put(kept) if kept else self.waiting.clear()
        return due, kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // 1000
        self.timer.clear()
        states = pickle.loads(bytes(self.states.get()[0])) if self.states.exists() else {}
        due, waiting = self._due(upto)
        woken = [k for k, (_, moment) in states.items() if moment is not None and moment <= upto and k not in due]
        out = []
        for member in [*due, *woken]:
            before = states.pop(member, (None, None))[0]
            found, after, moment = self.step(before, sorted(due.get(member, ())), upto)
            out += [member + row for row in found]
            if after is not None:
                states[member] = (after, moment)
        if states:
            self.states.update((pickle.dumps(states, 5),))
        else:
            self.states.clear()
        self._wake(min([m for _, m in states.values() if m is not None] + [at for at, _ in waiting], default=None))
        if out:
            yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass


class _Sustained(InOrder):
    ROW = _fields(ts_s=T.LongType(), seq=T.LongType(), holds=T.BooleanType())

    def __init__(self, keys: Sequence[str], hold_s: int):
        super().__init__(keys, ["since_s", "fired_s"])
        self.hold_s = hold_s

    def step(self, state, rows, upto):
        out = []
        since, fired = state or (None, False)

        def reach(now: int) -> None:
            nonlocal fired
            if since is not None and not fired and since + self.hold_s <= now:
                fired = True
                out.append((since, since + self.hold_s))

        for ts_s, _, holds in rows:
            reach(ts_s if holds else ts_s - 1)
            if not holds:
                since, fired = None, False
            elif since is None:
                since = ts_s
        reach(upto)
        if since is None:
            return out, None, None
        return out, (since, fired), None if fired else since + self.hold_s


class _Liveness(InOrder):
    ROW = _fields(ts_s=T.LongType())

    def __init__(self, key: str, suspect_s: int, offline_s: int, evict_s: int):
        super().__init__([key], ["at_s", "status"])
        self.silence = [(suspect_s, "SUSPECT"), (offline_s, "OFFLINE"), (evict_s, "EVICTED")]

    def step(self, state, rows, upto):
        out = []
        seen, status = state or (None, None)
        after = ["ONLINE", *[name for _, name in self.silence]]

        def silent(now: int) -> None:
            nonlocal status
            for seconds, name in self.silence:
                if seen is not None and after.index(name) > after.index(status) and seen + seconds <= now:
                    status = name
                    out.append((seen + seconds, name))

        for (ts_s,) in rows:
            silent(ts_s - 1)
            if status != "ONLINE":
                out.append((ts_s, "ONLINE"))
            seen, status = ts_s, "ONLINE"
        silent(upto)
        if status == "EVICTED":
            return out, None, None
        return out, (seen, status), next(seen + s for s, name in self.silence if after.index(name) > after.index(status))


def _stepped(
    stream: DataFrame, processor: InOrder, columns: Sequence[Column], ts_s: Column, delay: str, output: str, buckets: int
) -> DataFrame:
    """Rows that a processor emits. Its keys travel as text (binary and timestamps as they are): pandas would make
    whole numbers beside a null floating-point ones."""
    kinds = {k: stream.schema[k].dataType for k in processor.keys}
    as_is = (T.StringType, T.BinaryType, T.TimestampType, T.TimestampNTZType)
    real = (T.FloatType, T.DoubleType)
    text = [
        F.col(k).alias(k) if isinstance(kind, as_is)
        else (F.col(k) + F.lit(0.0).cast(kind) if isinstance(kind, real) else F.col(k)).cast("string").alias(k)  # no -0.0
        for k, kind in kinds.items()
    ]
    timed = stream.select(*text, *columns, F.timestamp_seconds(ts_s).alias("__time")).withWatermark("__time", delay)
    rows = timed.where("ts_s IS NOT NULL").withColumn("__bucket", F.pmod(F.xxhash64(*processor.keys), F.lit(buckets)))
    added = T.StructType.fromDDL(output)
    carried = T.StructType(
        [T.StructField(k, kind if isinstance(kind, as_is) else T.StringType()) for k, kind in kinds.items()] + added.fields
    )
    out = rows.groupBy("__bucket").transformWithStateInPandas(processor, carried, "append", "eventTime")
    return out.select(*[F.col(k).cast(kind).alias(k) for k, kind in kinds.items()], *added.names)


def sustained_stream(stream: DataFrame, keys: Sequence[str], order: Column, ts_s: Column, condition: Column, hold_s: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """(keys.., since_s, fired_s): once for each time that a condition has held for ``hold_s`` seconds without a break.

    ``fired_s`` is ``since_s + hold_s``; a row without the condition at exactly that second
    still breaks the hold. No row has to come for it: the watermark passing that moment
    is enough. A null condition does not hold. A key's state goes with the condition.
    """
    use_state_store(stream.sparkSession)
    columns = [ts_s.cast("long").alias("ts_s"), F.coalesce(order.cast("long"), F.lit(-(2**63))).alias("seq"), F.coalesce(condition, F.lit(False)).alias("holds")]
    return _stepped(stream, _Sustained(keys, hold_s), columns, ts_s, delay, "since_s long, fired_s long", buckets)


def liveness_stream(
    heartbeats: DataFrame, key: str, ts_s: Column, delay: str,
    suspect_s: int = SUSPECT_S, offline_s: int = OFFLINE_S, evict_s: int = EVICT_S, buckets: int = BUCKETS,
) -> DataFrame:
    """(key, at_s, status): every change of a member's status, as it comes about.

    ONLINE with the first heartbeat and with the one that ends a silence; SUSPECT, OFFLINE
    and EVICTED that many seconds after the last heartbeat, without a further row. A
    heartbeat at exactly that second comes first. An evicted member is forgotten.
    """
    if not suspect_s < offline_s < evict_s:
        raise ValueError("suspect_s < offline_s < evict_s")
    use_state_store(heartbeats.sparkSession)
    processor = _Liveness(key, suspect_s, offline_s, evict_s)
    return _stepped(heartbeats, processor, [ts_s.cast("long").alias("ts_s")], ts_s, delay, "at_s long, status string", buckets)
