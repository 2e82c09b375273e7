"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from cairn.streaming import runs


@pytest.fixture()
def stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"), "value")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    return e, runs.events_from(spark, str(tmp_path / "in"), e.schema), str(tmp_path / "out")


def drained(spark, df, out, mode="append"):
    if mode == "append":
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start().awaitTermination(120)
        return spark.read.schema(df.schema).parquet(out)
    q = df.writeStream.format("memory").queryName("drained").outputMode(mode).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("drained")


def test_exactly_once(spark, stream):
    batch, live, out = stream
    assert drained(spark, runs.once(live.union(live)), out).count() == batch.count()


def test_keyed_state(spark, stream):
    batch, live, out = stream
    got = drained(spark, runs.keyed_totals(live), out, "update").groupBy("run_id").agg(F.max("n").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(r["run_id"], r["n"]) for r in runs.keyed_totals(batch).collect()}


def test_windows(spark, stream):
    batch, live, out = stream
    got = drained(spark, runs.windowed_counts(live, late="100 days"), out, "update").groupBy("start", "name").agg(F.max("n").alias("n"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in runs.windowed_counts(batch).collect()}


def test_fragments(spark):
    d = spark.createDataFrame([(1, 0, 1, "find", '{"q":'), (1, 0, 2, "", '"x"}'), (1, 1, 3, "", "lost"), (1, 2, 4, "odd", "{bad")], "run_id bigint, index int, seq int, name string, arguments string")
    got = {r["name"]: (r["arguments"], r["parsed"]) for r in runs.merged_fragments(d).collect()}
    assert got == {"find": ('{"q":"x"}', True), "odd": ("{bad", False)}
