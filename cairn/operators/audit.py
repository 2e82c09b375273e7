"""The audit log's hash chains [K1, K3, K4, M18, E12, E13].

A record's hash is that of its payload, all FIELDS as JSON with keys in order and nulls written, and of its predecessor's
hash. A log is cut into shards, each a chain of its own. append() goes on from each chain's stored head; within a task the
rows of a chain pass by in order and only the last hash is held. chained() does the same on a stream, the heads in keyed
state. verify() looks at every record on its own, beside its predecessor.

Cases: fields that a table lacks are null, and null is not the text "null"; lists of roles are sorted and maps by key, so that
their order does not matter; a time is written to the microsecond; rows at or before a chain's head are there already and are
passed by; a null shard is a chain; two rows of one seq in a batch are both chained, in the order of their payloads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GENESIS = "0" * 64
#: What a hash commits to.
FIELDS = (
    "seq", "ts", "actor_user_id", "actor_username", "actor_roles", "session_id", "conversation_id", "run_id", "step_id", "action", "resource_type",
    "resource_id", "decision", "reason", "model_used", "lane", "tool_name", "input_digest", "output_digest", "severity", "metadata",
)


def payload(rows: DataFrame) -> Column:
    """The canonical JSON of rows' FIELDS."""
    kinds = {f.name: f.dataType for f in rows.schema}

    def one(name: str) -> Column:
        kind, c = kinds.get(name), F.col(name)
        if kind is None:
            return F.lit(None).cast("string")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        if isinstance(kind, T.ArrayType):
            return F.array_sort(c)
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(c)))
        return c

    return F.to_json(F.struct(*[one(n).alias(n) for n in sorted(FIELDS)]), {"ignoreNullFields": "false"})


def link(json: str, before: str) -> str:
    return hashlib.sha256(f"{json}|{before}".encode("utf-8", "surrogatepass")).hexdigest()


_HEAD, _JSON = "__head", "__payload"


def append(rows: DataFrame, heads: DataFrame | None = None, key: str = "shard") -> DataFrame:
    """rows with prev_hash and hash, in the chain of each key, going on from heads (key, seq, hash)."""
    names = rows.columns
    new = rows.select("*", payload(rows).alias(_JSON), F.lit(None).cast("string").alias(_HEAD))
    if heads is not None:
        typed = [F.col(c).cast(rows.schema[c].dataType) if c in (key, "seq") else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
        new = heads.select(*[t.alias(c) for t, c in zip(typed, names, strict=True)], F.lit(None).cast("string").alias(_JSON), F.col("hash").alias(_HEAD)).unionByName(new)
    # a head before the rows of its chain
    new = new.repartition(key).sortWithinPartitions(key, F.col(_HEAD).isNull(), "seq", _JSON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, before, last = object(), GENESIS, None
        for b in batches:
            kept, prevs, hashes = [], [], []
            for i, (k, seq, json, head) in enumerate(zip(*(b.column(c).to_pylist() for c in (key, "seq", _JSON, _HEAD)), strict=True)):
                if k != chain:
                    chain, before, last = k, GENESIS, None
                if head is not None:
                    before, last = head, seq
                elif last is None or seq > last:
                    kept.append(i)
                    prevs.append(before)
                    before = link(json, before)
                    hashes.append(before)
            out = b.select(names).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*names, "prev_hash", "hash"])

    schema = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    return new.mapInArrow(run, schema)


def heads(chained: DataFrame, key: str = "shard") -> DataFrame:
    """Each chain's last seq and hash, to go on from."""
    return chained.groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def verify(chained: DataFrame, key: str = "shard", start_seq: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Per chain: rows checked, the first row that does not follow from its predecessor or does not hash to its digest (null:
    valid). stored: the heads that the first rows must follow from. The predecessor is looked up before the start is
    applied."""
    w = Window.partitionBy(key).orderBy("seq")
    rows = chained.withColumn("__hash", F.sha2(F.concat(payload(chained), F.lit("|"), F.col("prev_hash")), 256))
    first = F.lit(GENESIS)
    if stored is not None:
        rows = rows.join(stored.select(F.col(key).alias("__key"), F.col("hash").alias("__stored")), F.col(key).eqNullSafe(F.col("__key")), "left")
        first = F.coalesce("__stored", F.lit(GENESIS))
    broken = ~F.col("prev_hash").eqNullSafe(F.coalesce(F.lag("hash").over(w), first)) | ~F.col("hash").eqNullSafe(F.col("__hash"))
    seen = rows.withColumn("__broken", broken)
    seen = seen.where(F.col("seq") > start_seq) if start_seq is not None else seen
    return seen.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.min(F.when(F.col("__broken"), F.col("seq"))).alias("first_invalid_seq"))


class _Chain(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, before = self.head.get() if self.head.exists() else (None, GENESIS)
        new = sorted((int(seq), json) for f in rows for seq, json in zip(f["seq"], f["payload"], strict=True))
        out = []
        for seq, json in ((s, j) for s, j in new if last is None or s > int(last)):
            out.append((seq, json, before, before := link(json, before)))
        if out:
            self.head.update((out[-1][0], before))
        text = lambda k: pd.Series([r[k] for r in out], dtype=object)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype="int64"), "seq": pd.Series([r[0] for r in out], dtype="int64"), "payload": text(1), "prev_hash": text(2), "hash": text(3)})

    def close(self) -> None:
        pass


def chained(events: DataFrame, key: str = "shard") -> DataFrame:
    """A stream of key, seq, payload, prev_hash and hash: each batch goes on from the heads in state, whatever is delivered
    again is passed by. Batches must come in order of seq. Written with timers.started()."""
    rows = events.select(F.col(key).cast("long").alias("key"), F.col("seq").cast("long").alias("seq"), payload(events).alias("payload"))
    out = rows.groupBy("key").transformWithStateInPandas(_Chain(), "key bigint, seq bigint, payload string, prev_hash string, hash string", "append", "none")
    return out.withColumnRenamed("key", key)
