"""Keyed machines with timers [2-M]: breakers, the reaping of orphaned runs, heartbeats.

A machine says what an event does to a key's state and when the state runs out by itself. machine() runs it over a stream,
each key's state and timers kept by Spark; folded() runs the same one over a batch. Both take events (key, at, seq, name)
and give transitions (key, at, state, n).

In event time events wait in the state of the key's bucket until the watermark has passed them, so they are taken in order of (at, seq)
however they arrive; what is late beyond the watermark's delay is dropped by Spark. In processing time (live) an event
counts when it comes, timers go by the clock, and state that nobody has touched for TTL is forgotten.

Cases: a null key is a key, a null time is no event, a null name is one that no machine knows and changes nothing; equal
times are taken by seq, a null seq first; repeated rows are events of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

State = tuple[int, ...] | None
Step = tuple[State, str | None, int]
#: Forgetting keys in processing time, milliseconds.
TTL = 86_400_000
#: Keys share the state and timers of so many buckets; a stream that goes on from a checkpoint must keep the number.
BUCKETS = 4096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(Protocol):
    """State is a tuple of whole numbers, described by schema; None is where every key begins."""

    schema: str
    #: The events that do something to a state; all, if None. Others only pass the time, and that the watermark tells.
    names: tuple[str, ...] | None
    #: Whether a timer that is due when an event comes goes before it.
    timer_first: bool

    def due(self, state: State) -> int | None:
        """When the state runs out, in milliseconds."""

    def expire(self, state: State, at: int) -> Step:
        """The state after that, with the transition to tell of (none: null) and its number."""

    def on(self, state: State, at: int, name: str | None) -> Step:
        """The same after an event."""


class Breaker:
    """A model's breaker [M14, E20]. `failure`s count from the first within window_ms; the threshold-th opens it and so does a
    `trip` at once, each failure after that opens it anew; a `success` closes it and forgets; cooldown_ms after it was last
    opened it is half open: all is forgotten and the next request is let through."""

    schema, names, timer_first = "failures long, first_ms long, opened_ms long", ("failure", "trip", "success"), True

    def __init__(self, threshold: int = 3, window_ms: int = 60_000, cooldown_ms: int = 120_000):
        self.threshold, self.window_ms, self.cooldown_ms = threshold, window_ms, cooldown_ms

    def due(self, state: State) -> int | None:
        return state[2] + self.cooldown_ms if state and state[2] >= 0 else None

    def expire(self, state: State, at: int) -> Step:
        return None, "half open", 0

    def on(self, state: State, at: int, name: str | None) -> Step:
        n, first, opened = state or (0, 0, -1)
        if name == "success":
            return None, "closed" if opened >= 0 else None, 0
        if name == "trip":
            n = max(n, self.threshold)
            return (n, at, at), "open", n
        if name != "failure":
            return state, None, 0
        n, first = (1, at) if n == 0 or at - first > self.window_ms else (n + 1, first)
        if n < self.threshold:
            return (n, first, opened), None, n
        return (n, first, at), "open", n


class Reaper:
    """Runs that nobody ends [M11]: from an `open` on a run is running; a `close` finishes it, and timeout_ms without one
    cancels it. What comes after either is no run's. The number is how long the run took, 0 if cancelled: nothing tells when
    that run really ended."""

    schema, names, timer_first = "opened_ms long", ("open", "close"), False

    def __init__(self, timeout_ms: int = 900_000):
        self.timeout_ms = timeout_ms

    def due(self, state: State) -> int | None:
        return state[0] + self.timeout_ms if state else None

    def expire(self, state: State, at: int) -> Step:
        return None, "cancelled", 0

    def on(self, state: State, at: int, name: str | None) -> Step:
        if name == "open" and not state:
            return (at,), None, 0
        if name == "close" and state:
            return None, "finished", at - state[0]
        return state, None, 0


class Heartbeat:
    """A ping after every_ms without an event, and again while the silence lasts, until an `end` or limit_ms of silence [M5].
    The number counts the pings of a silence."""

    schema, names, timer_first = "heard_ms long, pings long", None, False

    def __init__(self, every_ms: int = 15_000, limit_ms: int = 900_000):
        self.every_ms, self.limit_ms = every_ms, limit_ms

    def due(self, state: State) -> int | None:
        return state[0] + (state[1] + 1) * self.every_ms if state else None

    def expire(self, state: State, at: int) -> Step:
        heard, n = state[0], state[1] + 1
        return (heard, n) if (n + 1) * self.every_ms <= self.limit_ms else None, "ping", n

    def on(self, state: State, at: int, name: str | None) -> Step:
        return (None if name == "end" else (at, 0)), None, 0


Told = list[tuple[int, str, int]]


def _until(machine: Machine, state: State, before: int, told: Told) -> State:
    """Lets the state run out as often as it is due before a time."""
    while (due := machine.due(state)) is not None and due < before:
        state, what, n = machine.expire(state, due)
        if what is not None:
            told.append((due, what, n))
    return state


def _after(machine: Machine, state: State, events: list[tuple[int, int | None, str | None]], told: Told) -> State:
    """Takes events in order, each after what was due before it."""
    return _in_order(machine, state, ((at, name) for at, _, name in sorted(events, key=lambda e: (e[0], e[1] is not None, e[1] or 0))), told)


def _in_order(machine: Machine, state: State, events: Iterable[tuple[int, str | None]], told: Told) -> State:
    for at, name in events:
        state = _until(machine, state, at + machine.timer_first, told)
        state, what, n = machine.on(state, at, name)
        if what is not None:
            told.append((at, what, n))
    return state


def _frame(keys: list[str | None], told: Told) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series(keys, dtype=object), "at_ms": [t[0] for t in told], "state": pd.Series([t[1] for t in told], dtype=object), "n": [t[2] for t in told]})


def _whole(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def _events(frame: pd.DataFrame) -> list[tuple[int, int | None, str | None]]:
    return [(int(at), _whole(seq), None if pd.isna(name) else str(name)) for at, seq, name in zip(frame["at_ms"], frame["seq"], frame["name"], strict=True)]


class _Live(StatefulProcessor):
    """Processing time: a key's events count when they come, its timers go by the clock."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.machine.schema, TTL)

    def close(self) -> None:
        pass

    def _load(self) -> State:
        return tuple(map(int, self.state.get())) if self.state.exists() else None

    def _store(self, state: State) -> None:
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            if (due := self.machine.due(state)) is not None:
                self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        told: Told = []
        now, state = timerValues.getCurrentProcessingTimeInMs(), self._load()
        for frame in rows:
            state = _after(self.machine, state, [(now, seq, name) for _, seq, name in sorted(_events(frame), key=lambda e: (e[0], e[1] is not None, e[1] or 0))], told)
        self._store(state)
        yield _frame([key[0]] * len(told), told)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        told: Told = []
        state = _until(self.machine, self._load(), timerValues.getCurrentProcessingTimeInMs() + 1, told)
        self._store(state)
        yield _frame([key[0]] * len(told), told)


_EVENTS = pa.schema([("key", pa.string()), ("at_ms", pa.int64()), ("seq", pa.int64()), ("name", pa.string())])
_KEYS = pa.schema([("key", pa.string()), ("state", pa.list_(pa.int64()))])
SLICE = 65_536


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class _InOrder(StatefulProcessor):
    """Event time, for a bucket of keys at once: with a state, a list and timers for each key, most of the time goes into asking
    for them. Events wait as the batches they came in; the states of the bucket's keys are one value."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getValueState("states", "keys binary")
        self.pending = handle.getListState("pending", "events binary")
        self.timer = handle.getValueState("timer", "at_ms long")

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        """One timer a bucket, at the first time asked for."""
        set_ = int(self.timer.get()[0]) if self.timer.exists() else None
        if set_ is None or at < set_:
            if set_ is not None:
                self.handle.deleteTimer(set_)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for frame in rows:
            if len(frame):
                first = min(int(frame["at_ms"].min()), first if first is not None else 2**63 - 1)
                self.pending.appendValue((_bytes(pa.Table.from_pandas(frame[_EVENTS.names], _EVENTS, preserve_index=False)),))
        if first is not None:
            self._wake(first)
        yield _frame([], [])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        before = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = _table(self.states.get()[0]).to_pydict() if self.states.exists() else {"key": [], "state": []}
        states: dict[str | None, State] = dict(zip(held["key"], map(tuple, held["state"]), strict=True))
        keys: list[str | None] = []
        told: Told = []
        waiting = pa.concat_tables([_EVENTS.empty_table(), *(_table(x[0]) for x in self.pending.get())])
        ready, rest = waiting.filter(pc.less(waiting["at_ms"], before)), waiting.filter(pc.greater_equal(waiting["at_ms"], before))
        for k, events in _by_key(ready):
            states[k] = _in_order(self.machine, states.get(k), events, told)
            keys += [k] * (len(told) - len(keys))
        if len(ready):
            self.pending.clear()
            if len(rest):
                self.pending.appendValue((_bytes(rest),))
        wake = [pc.min(rest["at_ms"]).as_py()] if len(rest) else []
        for k, state in states.items():
            states[k] = state = _until(self.machine, state, before, told)
            keys += [k] * (len(told) - len(keys))
            if state is not None and (due := self.machine.due(state)) is not None:
                wake.append(due)
        left = [(k, list(state)) for k, state in states.items() if state is not None]
        if left:
            self.states.update((_bytes(pa.table([pa.array(c, f.type) for c, f in zip(zip(*left, strict=True), _KEYS, strict=True)], schema=_KEYS)),))
        else:
            self.states.clear()
        if wake:
            # what is due at the watermark itself is so once that has moved on; Spark drops a timer of the time that it fired at
            self._wake(max(min(wake), before + 1))
        yield _frame(keys, told)


def _by_key(events: pa.Table) -> Iterator[tuple[str | None, Iterator[tuple[int, str | None]]]]:
    """Each key with its events in order of (at, seq), a null seq first."""
    if not len(events):
        return
    key, name = (events[c].combine_chunks().dictionary_encode() for c in ("key", "name"))
    names, keys = [*name.dictionary.to_pylist(), None], [*key.dictionary.to_pylist(), None]
    codes, called = (x.indices.fill_null(len(x.dictionary)).to_numpy(zero_copy_only=False) for x in (key, name))
    at, seq = events["at_ms"].to_numpy(), events["seq"].combine_chunks()
    order = np.lexsort((seq.fill_null(0).to_numpy(zero_copy_only=False), seq.is_valid().to_numpy(zero_copy_only=False), at, codes))
    codes, at, called = codes[order], at[order], called[order]
    ends = [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]

    def part(lo: int, hi: int) -> Iterator[tuple[int, str | None]]:
        for k in range(lo, hi, SLICE):
            end = min(k + SLICE, hi)
            yield from zip(at[k:end].tolist(), [names[c] for c in called[k:end].tolist()], strict=True)

    for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
        yield keys[codes[lo]], part(lo, hi)


_OUT = "key string, at_ms bigint, state string, n bigint"


def _keyed(events: DataFrame, key: str, at: str, seq: str, name: str) -> DataFrame:
    return events.select(
        F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), F.col(seq).cast("long").alias("seq"), F.col(name).cast("string").alias("name")
    ).where("at IS NOT NULL")


def _named(out: DataFrame) -> DataFrame:
    return out.select("key", F.timestamp_millis("at_ms").alias("at"), "state", "n")


def machine(events: DataFrame, of: Machine, key: str, at: str = "ts", seq: str = "event_id", name: str = "name", delay: str = "1 minute", live: bool = False) -> DataFrame:
    """A stream of transitions from a stream of events. The query that writes it must run with the RocksDB state store
    (started() sees to that). A transition comes once the watermark, which trails the newest event by delay, has passed it."""
    rows = _keyed(events, key, at, seq, name)
    if live:
        return _named(rows.groupBy("key").transformWithStateInPandas(_Live(of), _OUT, "append", "ProcessingTime"))
    rows = rows.withWatermark("at", delay)
    if of.names is not None:
        # all events move the watermark on: a condition on their time, which none meets, keeps this one from being asked before
        rows = rows.where(F.col("name").isin(*of.names) | (F.col("at") < F.lit("0001-01-01").cast("timestamp")))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "key", "at", "at_ms", "seq", "name")
    return _named(dealt.groupBy("bucket").transformWithStateInPandas(_InOrder(of), _OUT, "append", "EventTime"))


def started(stream: DataFrame, begin: Callable):  # noqa: ANN201
    """begin(stream.writeStream) with the state store that keyed machines need; the session's own setting is put back."""
    conf = stream.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKS)
    try:
        return begin(stream.writeStream)
    finally:
        conf.set(name, before) if before is not None else conf.unset(name)


def folded(events: DataFrame, of: Machine, key: str, at: str = "ts", seq: str = "event_id", name: str = "name", delay_ms: int = 60_000) -> DataFrame:
    """The same transitions from a batch: all before the newest event's time less delay_ms, as a stream would have told them.
    A key's events pass by in order and only its state is held, so a key of many rows takes time but no memory."""
    rows = _keyed(events, key, at, seq, name)
    newest = rows.agg(F.max("at_ms")).first()[0]
    before = (newest if newest is not None else 0) - delay_ms
    rows = rows.where(F.col("at_ms") < before).repartition("key").sortWithinPartitions("key", "at_ms", F.col("seq").asc_nulls_first())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for f in frames:
            keys: list[str | None] = []
            told: Told = []
            for k, part in _runs(f):
                if begun and k != now:
                    _until(of, state, before, told)
                    keys += [now] * (len(told) - len(keys))
                    state = None
                now, begun = k, True
                state = _after(of, state, _events(part), told)
                keys += [k] * (len(told) - len(keys))
            yield _frame(keys, told)
        if begun:
            told = []
            _until(of, state, before, told)
            yield _frame([now] * len(told), told)

    return _named(rows.select("key", "at_ms", "seq", "name").mapInPandas(run, _OUT))


def _runs(frame: pd.DataFrame) -> Iterator[tuple[str | None, pd.DataFrame]]:
    """Neighbouring rows of the same key."""
    keys = [None if pd.isna(k) else k for k in frame["key"]]
    lo = 0
    for hi in range(1, len(keys) + 1):
        if hi == len(keys) or keys[hi] != keys[lo]:
            yield keys[lo], frame.iloc[lo:hi]
            lo = hi
