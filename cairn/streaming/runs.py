"""Event streams and their folds [2-M]: the same functions over a batch and over a stream where the state allows.

Watermarks, windows and sessions are additions: an ordered log has no late data of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def events_from(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of event files [M1, M6]; the checkpoint remembers what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_trigger)).parquet(path)


def numbered(events: DataFrame, run: str = "run_id", order: str = "event_id") -> DataFrame:
    """seq of each event within its run [M1]."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(run).orderBy(order)))


def replay(events: DataFrame, after: int, keep: int = 1000, run: str = "run_id") -> DataFrame:
    """The last events of each run that a subscriber after a number has still to see [M2]."""
    w = Window.partitionBy(run).orderBy(F.desc("seq"))
    return events.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= keep) & (F.col("seq") > after)).drop("__r")


def run_record(events: DataFrame, run: str = "run_id") -> DataFrame:
    """One row for each run: events, last state, first decision, elapsed time [M8, M9, E11, E18, E19]. events: run, seq, ts,
    name, value."""
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max_by("name", "seq").alias("last_name"),
        F.min_by(F.when(F.col("name") == "purchase", F.col("value")), F.when(F.col("name") == "purchase", F.col("seq"))).alias("first_decision"),
        F.max_by(F.when(F.col("name") == "error", F.col("value")), F.when(F.col("name") == "error", F.col("seq"))).alias("last_error"),
        (F.unix_micros(F.max("ts").cast("timestamp")) / 1000 - F.unix_micros(F.min("ts").cast("timestamp")) / 1000).cast("long").alias("wall_ms"),
    )


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", time: str = "ts") -> DataFrame:
    """Events by name in windows of time, for streams as for batches [M, additions]."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), "name").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "name", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "40 days", time: str = "ts", key: str = "run_id") -> DataFrame:
    """Runs of events without a longer gap [M, additions]."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "40 days", time: str = "ts") -> DataFrame:
    """Each event once, however often it is delivered [M19, G9]."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def keyed_totals(events: DataFrame, key: str = "run_id") -> DataFrame:
    """Stream: count and sum of values of each key after each trigger, in keyed state [M8, M14]. Batch: the same by a
    group."""
    if not events.isStreaming:
        return events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return events.select(key, "value").groupBy(key).applyInPandasWithState(step, f"{key} bigint, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def heartbeats(events: DataFrame, every_s: int = 15, run: str = "run_id", time: str = "ts") -> DataFrame:
    """When a run's stream would have to say that it lives: every every_s seconds of silence between events [M5]."""
    w = Window.partitionBy(run).orderBy(time, "event_id")
    t = F.unix_seconds(F.col(time).cast("timestamp"))
    gaps = events.select(run, t.alias("at"), (F.lead(t).over(w) - t).alias("gap")).where(F.col("gap") > every_s)
    return gaps.select(run, "at", F.floor((F.col("gap") - 1) / every_s).cast("long").alias("beats"))


def drop_oldest(events: DataFrame, size: int = 256, run: str = "run_id") -> DataFrame:
    """What a bounded queue of a slow subscriber still holds of each run [M3]."""
    w = Window.partitionBy(run).orderBy(F.desc("seq"))
    return events.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r")


def frames(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Server-sent event frames [A39]."""
    return events.select(run, "seq", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\nevent: "), F.col("name"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n")).alias("frame"))


def merged_fragments(deltas: DataFrame) -> DataFrame:
    """Tool calls from streamed fragments: arguments joined in order, unnamed calls dropped, arguments that are no JSON kept
    as they are [P4]. deltas: run_id, index, seq, name, arguments."""
    g = deltas.groupBy("run_id", "index").agg(
        F.max_by("name", F.when(F.col("name") != "", F.col("seq"))).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "arguments"))), lambda x: x["arguments"]), "").alias("arguments"),
    )
    return g.where("name IS NOT NULL AND name <> ''").withColumn("parsed", F.try_parse_json("arguments").isNotNull())


def until_closed(events: DataFrame, end: str, run: str = "run_id") -> DataFrame:
    """What subscribers of a run get: everything up to its end marker, nothing after [M4]."""
    first = F.min(F.when(F.col("name") == end, F.col("seq"))).over(Window.partitionBy(run))
    return events.withColumn("__end", first).where(F.col("__end").isNull() | (F.col("seq") <= F.col("__end"))).drop("__end")


def stored_trace(events: DataFrame, token: str, reasoning: str, limit: int = 20_000, run: str = "run_id") -> DataFrame:
    """The trace that is kept of a run: no token events, and all reasoning as one event of limit characters after the
    others [M7]. events: run, seq, name, data."""
    rest = events.where(~F.col("name").isin(token, reasoning)).select(run, "seq", "name", "data")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "data"))), lambda x: x["data"]), "")
    one = events.where(F.col("name") == reasoning).groupBy(run).agg(F.max("seq").alias("seq"), F.substring(parts, 1, limit).alias("data"))
    after = rest.groupBy(run).agg(F.max("seq").alias("last"))
    return rest.unionByName(one.join(after, run, "left").select(run, (F.greatest("seq", F.coalesce("last", F.lit(0).cast("long"))) + 1).alias("seq"), F.lit(reasoning).alias("name"), "data"))


def progress(reports: DataFrame, stages: DataFrame, job: str = "job_id") -> DataFrame:
    """The share of a job that is done at each report: stages before it by weight, its own by how far within it is [D27, M21,
    L10]. reports: job, seq, stage, within; stages: stage, pos, weight, a small list."""
    w = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = stages.withColumns({"before": F.coalesce(F.sum("weight").over(w), F.lit(0.0)), "total": F.sum("weight").over(Window.partitionBy(F.lit(0)))})
    part = F.col("weight") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("within")))
    return reports.join(s, "stage").select(job, "seq", F.least(F.lit(1.0), (F.col("before") + part) / F.col("total")).alias("fraction"))


def stage_timings(reports: DataFrame, job: str = "job_id") -> DataFrame:
    """Milliseconds of each stage of a job, from its first to its last report [L10]. reports: job, stage, at_ms."""
    return reports.groupBy(job, "stage").agg((F.max("at_ms") - F.min("at_ms")).alias("ms"))


def last_attempts(attempts: DataFrame, most: int = 2) -> DataFrame:
    """A step's outcome: its first success, or its last attempt; a step is tried again once, with what was wrong told [M20].
    attempts: step_id, attempt, ok, detail."""
    tried = attempts.where(F.col("attempt") <= most)
    order = F.struct("ok", F.when(F.col("ok"), -F.col("attempt")).otherwise(F.col("attempt")))
    return tried.groupBy("step_id").agg(F.max_by(F.struct("attempt", "ok", "detail"), order).alias("b")).select("step_id", "b.*")


def view_state(patches: DataFrame, run: str = "run_id") -> DataFrame:
    """A run's view after its patches: text of the appended tokens, steps by their last mark, things added once [M10]. patches:
    run, seq, kind (token, step, add), key, value."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "value")))), lambda x: x["value"]), "")
    last = patches.where("kind = 'step'").groupBy(run, "key").agg(F.max_by("value", "seq").alias("value")).groupBy(run).agg(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))).alias("steps"))
    whole = patches.groupBy(run).agg(text.alias("text"), F.array_sort(F.collect_set(F.when(F.col("kind") == "add", F.col("key")))).alias("things"))
    return whole.join(last, run, "left").select(run, "text", "things", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"))
