"""Queries of keyed machines with timers, over the event log as a batch and as a stream of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import audit
from cairn.plans.catalogue import _records_of
from cairn.plans.registry import ORACLE_SQL, query
from cairn.sources import shared, tables
from cairn.streaming import timers

#: The log told 200 times as fast, so that failures of a model come within a minute of each other.
_FAST = 200
_DELAY = 60_000


def _calls(e: DataFrame) -> DataFrame:
    """The log as calls of three models."""
    kind, i = F.col("event_type"), F.col("event_id")
    name = F.when(kind == "error", "failure").when((kind == "purchase") & (i % 3 == 0), "success").when((kind == "signup") & (i % 5 == 0), "trip").otherwise(kind)
    at = F.timestamp_millis(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / _FAST).cast("long"))
    return e.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), at.alias("ts"), "event_id", name.alias("name"))


def _agent_runs(e: DataFrame) -> DataFrame:
    """Four events in a row as a run, opened by the first and closed by a purchase."""
    i = F.col("event_id")
    return e.select(F.concat(F.lit("r"), F.floor(i / 4).cast("string")).alias("run_id"), "ts", "event_id", F.when(i % 4 == 0, "open").when(F.col("event_type") == "purchase", "close").alias("name"))


def _feeds(e: DataFrame) -> DataFrame:
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), "ts", "event_id", F.when(F.col("event_type") == "error", "end").otherwise("event").alias("name"))


def _told(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col("key").alias(key), F.col("at").cast("timestamp_ntz").alias("at"), "state", "n")


def _live(spark: SparkSession, d: str) -> DataFrame:
    # a pattern, so that the table may be a file or a folder
    return spark.readStream.schema(tables.table(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parque[t]")


def _run(stream: DataFrame, tag: str) -> DataFrame:
    """All that a stream has to say about the files there are."""
    out = shared.folder(stream.sparkSession, tag)
    begun = timers.started(stream, lambda w: w.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    begun.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


_BREAKERS = f"""
    WITH RECURSIVE e AS (SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS key, CAST(floor(floor(epoch_us(ts) / 1000) / {_FAST}) AS BIGINT) AS t, event_id AS seq,
            CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'success' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'trip' ELSE event_type END AS name FROM events),
    z AS (SELECT max(t) - {_DELAY} AS before FROM e),
    k AS (SELECT e.*, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS k FROM e, z WHERE t < before),
    r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(-1 AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS half, CAST(NULL AS VARCHAR) AS what FROM k
      UNION ALL
      SELECT key, k, t, c, f, CASE WHEN name = 'success' THEN -1 WHEN name IN ('failure', 'trip') AND c >= 3 THEN t ELSE po END, CASE WHEN gone THEN ro + 120000 END,
        CASE WHEN name = 'success' AND po >= 0 THEN 'closed' WHEN name IN ('failure', 'trip') AND c >= 3 THEN 'open' END
      FROM (SELECT *, CASE name WHEN 'success' THEN 0 WHEN 'trip' THEN greatest(pn, 3) WHEN 'failure' THEN CASE WHEN pn = 0 OR t - pf > 60000 THEN 1 ELSE pn + 1 END ELSE pn END AS c,
              CASE WHEN name = 'trip' OR (name = 'failure' AND (pn = 0 OR t - pf > 60000)) THEN t WHEN name = 'success' THEN 0 ELSE pf END AS f
            FROM (SELECT *, CASE WHEN gone THEN 0 ELSE rn END AS pn, CASE WHEN gone THEN 0 ELSE rf END AS pf, CASE WHEN gone THEN -1 ELSE ro END AS po
                  FROM (SELECT k.*, r.n AS rn, r.first AS rf, r.opened AS ro, r.opened >= 0 AND k.t >= r.opened + 120000 AS gone FROM r JOIN k ON k.key = r.key AND k.k = r.k + 1)))),
    l AS (SELECT key, arg_max(opened, k) AS opened FROM r GROUP BY key)
    SELECT key AS model, make_timestamp(t * 1000) AS at, what AS state, CASE WHEN what = 'open' THEN n ELSE 0 END AS n FROM r WHERE what IS NOT NULL
    UNION ALL SELECT key, make_timestamp(half * 1000), 'half open', 0 FROM r WHERE half IS NOT NULL
    UNION ALL SELECT key, make_timestamp((opened + 120000) * 1000), 'half open', 0 FROM l, z WHERE opened >= 0 AND opened + 120000 < before"""


@query(_BREAKERS)
def breaker_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Opened by three failures in a minute or tripped, half open after two minutes, closed by a success"""
    return _told(timers.folded(_calls(tables.table(spark, d, "events")), timers.Breaker(), "model", delay_ms=_DELAY), "model")


@query(_BREAKERS)
def breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from the stream, by state and timers"""
    return _told(_run(timers.machine(_calls(_live(spark, d)), timers.Breaker(), "model"), "breakers"), "model")


_REAPED = f"""
    WITH e AS (SELECT 'r' || CAST(event_id // 4 AS VARCHAR) AS run_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, event_id AS seq, event_id % 4 = 0 AS opens, event_type = 'purchase' AND event_id % 4 <> 0 AS closes FROM events),
    z AS (SELECT max(t) - {_DELAY} AS before FROM e),
    o AS (SELECT run_id, t AS opened, seq FROM e, z WHERE opens AND t < before),
    c AS (SELECT o.run_id, min(e.t) AS closed FROM o JOIN e ON e.run_id = o.run_id AND e.closes AND (e.t > o.opened OR e.t = o.opened AND e.seq > o.seq) GROUP BY o.run_id)
    SELECT run_id, make_timestamp(CASE WHEN closed <= opened + 900000 THEN closed ELSE opened + 900000 END * 1000) AS at, CASE WHEN closed <= opened + 900000 THEN 'finished' ELSE 'cancelled' END AS state,
      CASE WHEN closed <= opened + 900000 THEN closed - opened ELSE 0 END AS n
    FROM o LEFT JOIN c USING (run_id), z WHERE CASE WHEN closed <= opened + 900000 THEN closed ELSE opened + 900000 END < before"""


@query(_REAPED)
def reaped_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs finished, or cancelled after 900 seconds"""
    return _told(timers.folded(_agent_runs(tables.table(spark, d, "events")), timers.Reaper(), "run_id", delay_ms=_DELAY), "run_id")


@query(_REAPED)
def reaped_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from the stream, by state and timers"""
    return _told(_run(timers.machine(_agent_runs(_live(spark, d)), timers.Reaper(), "run_id"), "reaped"), "run_id")


@query(
    f"""WITH e AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS run_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, event_id AS seq, event_type = 'error' AS ends FROM events), z AS (SELECT max(t) - {_DELAY} AS before FROM e),
    g AS (SELECT run_id, t, ends, coalesce(lead(t) OVER (PARTITION BY run_id ORDER BY t, seq), before) AS until FROM e, z WHERE t < before),
    p AS (SELECT run_id, t, unnest(range(1, least(24, CAST(ceil((until - t) / 3600000) AS BIGINT) - 1) + 1)) AS n FROM g WHERE NOT ends)
    SELECT run_id, make_timestamp((t + n * 3600000) * 1000) AS at, 'ping' AS state, n FROM p"""
)
def heartbeat_pings(spark: SparkSession, d: str) -> DataFrame:
    """M5: a ping for each hour of silence of a feed, a day at most, none after its end"""
    return _told(timers.folded(_feeds(tables.table(spark, d, "events")), timers.Heartbeat(3_600_000, 86_400_000), "run_id", delay_ms=_DELAY), "run_id")



@query(ORACLE_SQL["heartbeat_pings"])
def heartbeat_stream(spark: SparkSession, d: str) -> DataFrame:
    """M5: the same from the stream, by state and timers"""
    return _told(_run(timers.machine(_feeds(_live(spark, d)), timers.Heartbeat(3_600_000, 86_400_000), "run_id"), "pings"), "run_id")


@query(ORACLE_SQL["audit_chain"])
def audit_chain_stream(spark: SparkSession, d: str) -> DataFrame:
    """The chains from the stream, their heads in keyed state"""
    return _run(audit.chained(_records_of(tables.audit_from(_live(spark, d)))), "chain").select("shard", "seq", "prev_hash", "hash")
