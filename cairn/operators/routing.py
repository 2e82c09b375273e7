"""Model selection and residency [B30, C22-C26, D17, D18, F11-F13, J13, J14, M13-M17, N3-N5]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scores import candidate_score, swap_cost


def required(lane: Column, tokens: Column, tools: Column, json: Column) -> Column:
    """struct<capabilities, window>: what a lane's model must have, with a quarter more context than asked [N4]."""
    first = F.when(lane == "vision", "vision").when(lane == "embedding", "embed").otherwise("chat")
    return F.struct(F.array_compact(F.array(first, F.when(tools, "tools"), F.when(json, "json"))).alias("capabilities"), F.floor(tokens * 1.25).cast("long").alias("window"))


def select_models(requests: DataFrame, models: DataFrame, prefer: str = "loaded_then_quality") -> DataFrame:
    """The best eligible model of each request's lane, else the widest window with chunking [N3, B30, F11].
    requests: request_id, lane, needs; models: model, lane, pos, capabilities, window, quality_tier, speed_tier, ram_gb,
    resident, open (its breaker).

    Models are not met with requests: what a lane's requests may take at a given window is a ladder, from the widest window
    down, with a rung wherever a narrower model is better than all wider ones. A request stands on one rung. There are as many
    rungs as that happens, at most one for each different window."""
    need = F.col("needs")
    named = requests.select("request_id", "lane", need["capabilities"].alias("asked"), F.coalesce(need["window"].cast("long"), F.lit(-(2**63))).alias("least"))
    kinds = named.select("lane", "asked").distinct()
    cost = F.when(F.col("resident"), 0.0).otherwise(swap_cost(F.col("ram_gb")))
    score = F.round(candidate_score(F.col("quality_tier"), F.col("speed_tier"), F.col("resident"), cost, prefer), 9)
    lacks = F.size(F.array_except("asked", "capabilities")) > 0
    able = kinds.join(models, "lane").where(~F.coalesce(F.col("open"), F.lit(False)) & ~F.coalesce(lacks, F.lit(False)))
    # an unknown window is never too small
    wide = F.coalesce(F.col("window").cast("long"), F.lit(2**63 - 1)).alias("wide")
    each = able.select("lane", "asked", wide, F.struct((-score).alias("by"), "pos", "model", cost.alias("swap_s")).alias("best"), F.struct("pos", "model", cost.alias("swap_s")).alias("first"))
    each = each.groupBy("lane", "asked", "wide").agg(F.min("best").alias("best"), F.min("first").alias("first"))
    down = Window.partitionBy("lane", "asked").orderBy(F.desc("wide"))
    wider = F.min("best").over(down.rowsBetween(Window.unboundedPreceding, -1))
    rungs = each.withColumn("wider", wider).where("wider IS NULL OR best < wider").select("lane", "asked", "wide", "best", "first", F.col("wider").isNull().alias("top"), F.lead("wide").over(down).alias("next"))
    on = named["lane"].eqNullSafe(rungs["lane"]) & named["asked"].eqNullSafe(rungs["asked"]) & (F.col("next").isNull() | (F.col("least") > F.col("next"))) & (F.col("top") | (F.col("least") <= F.col("wide")))
    chunked = F.col("least") > F.col("wide")
    taken = F.when(chunked, F.struct(F.lit(True).alias("chunked"), (-F.col("wide").cast("double")).alias("by"), "first.pos", "first.model", "first.swap_s")).otherwise(F.struct(F.lit(False).alias("chunked"), F.col("best.by").alias("by"), "best.pos", "best.model", "best.swap_s"))
    found = named.join(rungs, on).groupBy("request_id").agg(F.min(taken).alias("t"))
    return found.select("request_id", "t.model", "t.swap_s", F.col("t.chunked").alias("requires_chunking"))


def resident_gb(models: DataFrame) -> DataFrame:
    """Memory by physical model, once for all its names, with names and pins [D17, D18]."""
    return models.where("resident").groupBy("physical").agg(F.max("ram_gb").alias("ram_gb"), F.array_sort(F.collect_list("model")).alias("names"), F.bool_or("pinned").alias("pinned"))


def evictions(resident: DataFrame, need_gb: float, budget_gb: float) -> DataFrame:
    """The least recently used models to unload so that need fits in the budget [F13]. resident: physical, ram_gb,
    last_used, pinned; a few rows at most."""
    w = Window.partitionBy(F.lit(0)).orderBy("last_used", "physical").rowsBetween(Window.unboundedPreceding, -1)
    total = resident.groupBy().agg(F.sum("ram_gb").alias("total"))
    free = resident.where("NOT pinned").withColumn("before", F.coalesce(F.sum("ram_gb").over(w), F.lit(0.0)))
    return free.join(total, F.lit(True)).where(F.col("total") - F.col("before") + need_gb > budget_gb).select("physical")


def drift(known: DataFrame, reported: DataFrame) -> DataFrame:
    """Models to adopt or to forget, by what providers report [C24]."""
    j = known.where("resident").select("provider", "physical", F.lit(True).alias("k")).distinct().join(reported.select("provider", "physical", F.lit(True).alias("r")).distinct(), ["provider", "physical"], "full_outer")
    return j.where("k IS NULL OR r IS NULL").select("provider", "physical", F.when(F.col("k").isNull(), "adopt").otherwise("forget").alias("change"))


def budget_state(uses: DataFrame, max_calls: int, max_tokens: int, max_wall_s: float) -> DataFrame:
    """Running use of each run and the first limit it reaches [M13]. uses: run_id, seq, calls, tokens, wall_s."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    r = uses.withColumns({"calls_used": F.sum("calls").over(w), "tokens_used": F.sum("tokens").over(w), "wall_used": F.sum("wall_s").over(w)})
    return r.withColumn("exhausted", F.when(F.col("calls_used") >= max_calls, "tool calls").when(F.col("tokens_used") >= max_tokens, "tokens").when(F.col("wall_used") >= max_wall_s, "time"))


def breaker(events: DataFrame, threshold: int = 3, window_s: int = 60) -> DataFrame:
    """Failures and open state of each model after its events in order [E20, M14]. A success resets; failures count from the
    first within the window. events: model, seq, at (seconds), ok. A fold per model over its events since the last success."""
    w = Window.partitionBy("model").orderBy("seq")
    since = events.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    last = since.groupBy("model").agg(F.max("run").alias("run"))
    xs = since.join(last, ["model", "run"]).where("NOT ok").groupBy("model").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("at").cast("double").alias("at")))).alias("xs"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("first"), F.lit(False).alias("open"))
    step = lambda s, x: F.when(
        (s["n"] == 0) | (x["at"] - s["first"] > window_s), F.struct(F.lit(1).alias("n"), x["at"].alias("first"), (s["open"] | F.lit(threshold <= 1)).alias("open"))
    ).otherwise(F.struct((s["n"] + 1).alias("n"), s["first"].alias("first"), (s["open"] | (s["n"] + 1 >= threshold)).alias("open")))
    state = xs.select("model", F.aggregate("xs", start, step).alias("s"))
    return last.select("model").join(state, "model", "left").select("model", F.coalesce("s.n", F.lit(0)).alias("failures"), F.coalesce("s.open", F.lit(False)).alias("open"))


def rolling_sample(rows: DataFrame, n: int = 1000) -> DataFrame:
    """Mean over each row's last n of its key [M16]. rows: key, seq, value."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(-(n - 1), 0)
    return rows.withColumns({"mean": F.avg("value").over(w), "n": F.count(F.lit(1)).over(w)})
