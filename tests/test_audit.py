"""Audit chains: every field counts, appending in parts is appending at once, streams go on from their heads."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairn.operators import audit
from cairn.streaming import timers

KINDS = {"seq": "bigint", "severity": "int", "ts": "timestamp_ntz", "actor_roles": "array<string>", "metadata": "map<string,string>"}
SCHEMA = "shard bigint, " + ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in audit.FIELDS)
TEXTS = ["plain", None, "null", 'with "quotes" and \\', "line\nbreak\t\u0007", "Größe 日本 \U0001f512", "", '","actor_user_id":"z']


def log(spark, n=60):
    rows = []
    for k in range(1, n + 1):
        row = {"shard": [1, 1, 2, None][k % 4], "seq": k, "severity": k % 4 if k % 5 else None, "actor_roles": [["b", "a"], [], None][k % 3], "metadata": [{"b": "1", "a": None}, {}, None][k % 3]}
        rows.append(tuple(row.get(c, TEXTS[(k + i) % len(TEXTS)]) for i, c in enumerate(["shard", *audit.FIELDS]) if c != "ts"))
    names = [c for c in ("shard", *audit.FIELDS) if c != "ts"]
    table = spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'shard' else KINDS.get(c, 'string')}" for c in names))
    return table.withColumn("ts", F.expr("TIMESTAMP_NTZ '2024-02-03 04:05:06.000007' + make_interval(0, 0, 0, 0, 0, 0, seq)")).repartition(3)


def plain(rows):
    """The chains by the definition, with Python's own JSON."""
    out, last = [], {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        body = {c: r[c] for c in audit.FIELDS}
        body |= {"ts": r["ts"].strftime("%Y-%m-%dT%H:%M:%S.%f"), "actor_roles": None if r["actor_roles"] is None else sorted(r["actor_roles"])}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        before = last.get(r["shard"], audit.GENESIS)
        last[r["shard"]] = hashlib.sha256(f"{text}|{before}".encode()).hexdigest()
        out.append((r["shard"], r["seq"], before, last[r["shard"]]))
    return sorted(map(str, out))


def told(df):
    return sorted(str((r["shard"], r["seq"], r["prev_hash"], r["hash"])) for r in df.collect())


def test_chains(spark):
    rows = log(spark)
    chained = audit.append(rows)
    assert told(chained) == plain(rows.collect()) and chained.columns == [*rows.columns, "prev_hash", "hash"]
    assert {(r["shard"], r["events"], r["first_invalid_seq"]) for r in audit.verify(chained).collect()} == {(1, 30, None), (2, 15, None), (None, 15, None)}
    assert audit.append(rows.limit(0)).collect() == [] and audit.verify(chained.limit(0)).collect() == []


@pytest.mark.parametrize("field", [c for c in audit.FIELDS if c != "seq"])
def test_any_altered_field_is_found(spark, field):
    chained = audit.append(log(spark, 24))
    other = {"severity": F.coalesce("severity", F.lit(0)) + 7, "ts": F.col("ts") + F.expr("INTERVAL 1 MICROSECOND"), "actor_roles": F.when(F.col("actor_roles").isNull(), F.array()).otherwise(F.array(F.lit("x"))), "metadata": F.create_map(F.lit("a"), F.lit("null"))}
    for seq in (9, 13):
        bad = chained.withColumn(field, F.when(F.col("seq") == seq, other.get(field, F.when(F.col(field).isNull(), F.lit("null")).otherwise(F.lit(None).cast("string")))).otherwise(F.col(field)))
        assert {r["shard"]: r["first_invalid_seq"] for r in audit.verify(bad).collect()} == {1: seq, 2: None, None: None}


def test_moved_and_missing_records_are_found(spark):
    chained = audit.append(log(spark, 24))
    follower = min(r["seq"] for r in chained.where("shard = 1 AND seq > 9").collect())
    assert audit.verify(chained.where("seq <> 9")).where("shard = 1").first()["first_invalid_seq"] == follower
    moved = chained.withColumn("seq", F.when(F.col("seq") == 9, 900).otherwise(F.col("seq")))
    assert audit.verify(moved).where("shard = 1").first()["first_invalid_seq"] == follower
    assert audit.verify(chained, start_seq=9).where("shard = 1").first()["events"] == chained.where("shard = 1 AND seq > 9").count()


def test_appending_in_parts(spark):
    rows = log(spark)
    first = audit.append(rows.where("seq <= 20"))
    second = audit.append(rows.where("seq > 12 AND seq <= 41"), audit.heads(first))
    third = audit.append(rows.where("seq > 41"), audit.heads(first.unionByName(second)))
    assert told(first.unionByName(second).unionByName(third)) == plain(rows.collect())
    stored = audit.heads(first)
    assert {r["first_invalid_seq"] for r in audit.verify(second, stored=stored).collect()} == {None}
    assert None not in {r["first_invalid_seq"] for r in audit.verify(second).collect()}


def test_a_stream_goes_on_from_its_heads(spark, tmp_path):
    rows = log(spark).where("shard IS NOT NULL")
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    stream = audit.chained(spark.readStream.schema(rows.schema).parquet(into))
    for part in ("seq <= 20", "seq > 15 AND seq <= 40", "seq > 40"):
        rows.where(part).write.mode("append").parquet(into)
        timers.started(stream, lambda w: w.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()).awaitTermination(300)
    got = spark.read.schema(stream.schema).parquet(out)
    assert told(got) == plain(rows.collect())
