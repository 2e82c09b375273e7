"""Keyed machines: streams give what batches give, also out of order, in parts and after a restart."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from cairn.streaming import timers

SCHEMA = "run_id string, ts timestamp, event_id bigint, name string, state string, n int, at int"
START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def events(names, n=240, seed=1, step=9):
    rnd, rows, t = random.Random(seed), [], 0
    for k in range(n):
        t += rnd.choice([0, 0, 1, 3, step, 10 * step, 200])
        rows.append((rnd.choice(["a", "a", "b", "c", None]), START + datetime.timedelta(seconds=t), k if k % 17 else None, rnd.choice([*names, *names, None, "other"]), "s", 1, 2))
    return [*rows, rows[3], ("d", None, 1, names[0], "s", 1, 2)]


def plain(machine, rows, delay_ms=60_000):
    """The machines' definitions once more, key by key over a sorted list."""
    ms = lambda t: int((t - START).total_seconds() * 1000)
    rows = [(r[0], ms(r[1]), r[2], r[3]) for r in rows if r[1] is not None]
    before = max(r[1] for r in rows) - delay_ms
    out = []
    for key in {r[0] for r in rows}:
        own = sorted([r[1:] for r in rows if r[0] == key and r[1] < before], key=lambda e: (e[0], -1 if e[1] is None else e[1]))
        out += [(key, at, what, n) for at, what, n in machine(own, before) if at < before]
    return sorted(map(str, out))


def plain_breaker(own, before):
    fails, first, opened = 0, 0, None
    for at, _, name in [*own, (before - 1, 0, "other")]:
        if opened is not None and at >= opened + 120_000:
            yield opened + 120_000, "half open", 0
            fails, opened = 0, None
        if name == "success":
            if opened is not None:
                yield at, "closed", 0
            fails, opened = 0, None
        elif name == "trip":
            fails, first, opened = max(3, fails), at, at
            yield at, "open", fails
        elif name == "failure":
            fails, first = (1, at) if not fails or at - first > 60_000 else (fails + 1, first)
            if fails >= 3:
                opened = at
                yield at, "open", fails


def plain_reaper(own, before):
    begun = None
    for at, _, name in [*own, (before, 0, "")]:
        if begun is not None and begun + 900_000 < at:
            yield begun + 900_000, "cancelled", 0
            begun = None
        if name == "open" and begun is None:
            begun = at
        elif name == "close" and begun is not None:
            yield at, "finished", at - begun
            begun = None


def plain_heartbeat(own, before):
    for (at, _, name), after in zip(own, [*[e[0] for e in own[1:]], before], strict=True):
        for n in range(1, 21):
            if name != "end" and at + n * 15_000 < after:
                yield at + n * 15_000, "ping", n


CASES = [
    (timers.Breaker(), plain_breaker, ["failure", "failure", "failure", "success", "trip"]),
    (timers.Reaper(), plain_reaper, ["open", "close", "more"]),
    (timers.Heartbeat(15_000, 300_000), plain_heartbeat, ["event", "event", "end"]),
]


def told(df):
    return sorted(str((r["key"], round((r["at"].replace(tzinfo=datetime.timezone.utc) - START).total_seconds() * 1000), r["state"], r["n"])) for r in df.select("key", F.col("at").cast("timestamp_ntz").alias("at"), "state", "n").collect())


def drained(spark, stream, out):
    begun = timers.started(stream, lambda w: w.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start())
    begun.awaitTermination(300)
    return spark.read.schema(stream.schema).parquet(out)


@pytest.mark.parametrize(("machine", "want", "names"), CASES)
@pytest.mark.parametrize("seed", [1, 2])
def test_batches(spark, machine, want, names, seed):
    rows = events(names, 400, seed)
    assert told(timers.folded(spark.createDataFrame(rows, SCHEMA).repartition(5), machine, "run_id")) == plain(want, rows)
    assert len(plain(want, rows)) > 20


@pytest.mark.parametrize(("machine", "want", "names"), CASES)
def test_streams_in_parts_and_after_a_restart(spark, tmp_path, machine, want, names):
    rows = events(names)
    table = spark.createDataFrame(rows, SCHEMA)
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = timers.machine(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", "2").parquet(into), machine, "run_id")
    later = START + datetime.timedelta(seconds=[(r[1] - START).total_seconds() for r in rows if r[1]][140])
    old = table.where(F.col("ts").isNull() | (F.col("ts") < F.lit(later)))
    # one file at a time, within a part out of order by as much as the delay allows
    for part in (old, table.where(F.col("ts") >= F.lit(later))):
        part.orderBy(F.col("ts"), F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(into)
        got = drained(spark, stream, out)
    assert told(got) == plain(want, rows)


def test_streams_take_events_in_order_of_time(spark, tmp_path):
    rows = [("a", START + datetime.timedelta(seconds=s), s, n, "", 0, 0) for s, n in ((0, "failure"), (40, "success"), (20, "failure"), (30, "failure"), (4000, "other"))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = timers.machine(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), timers.Breaker(), "run_id")
    assert told(drained(spark, stream, str(tmp_path / "out"))) == sorted(map(str, [("a", 30_000, "open", 3), ("a", 40_000, "closed", 0)]))


def test_nothing(spark):
    assert timers.folded(spark.createDataFrame([], SCHEMA), timers.Breaker(), "run_id").collect() == []


def test_pings_by_the_clock(spark, tmp_path):
    into = str(tmp_path / "in")
    spark.createDataFrame([("a", START, 1, "event", "", 0, 0), ("b", START, 2, "end", "", 0, 0)], SCHEMA).write.parquet(into)
    stream = timers.machine(spark.readStream.schema(SCHEMA).parquet(into), timers.Heartbeat(500, 60_000), "run_id", live=True)
    begun = timers.started(stream, lambda w: w.format("memory").queryName("pings").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start())
    try:
        for _ in range(240):
            if spark.table("pings").count() >= 3:
                break
            time.sleep(0.5)
    finally:
        begun.stop()
    got = spark.table("pings").orderBy("at").collect()
    assert len(got) >= 3 and {(r["key"], r["state"]) for r in got} == {("a", "ping")} and [r["n"] for r in got] == list(range(1, len(got) + 1))


def test_keys_share_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timers, "BUCKETS", 8, raising=False)
    rows = [(f"r{k}", START + datetime.timedelta(seconds=k + 40 * n), 3 * k + n, ("open", "other", "close")[n], "", 0, 0) for k in range(400) for n in range(2 + k % 2)]
    table = spark.createDataFrame([*rows, ("last", START + datetime.timedelta(days=1), 9999, "other", "", 0, 0)], SCHEMA)
    table.write.parquet(str(tmp_path / "in"))
    stream = timers.machine(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), timers.Reaper(), "run_id")
    begun = timers.started(stream, lambda w: w.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    begun.awaitTermination(120)
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert told(got) == told(timers.folded(table, timers.Reaper(), "run_id")) and got.count() == 400
    # a few values for each bucket, where every key had some
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in begun.recentProgress) < 100
