"""Rates over runs and decisions, roles' clearances, carried states, citations as JSON [B35, B37, C7, D15, D19, D23, D24, E18, E19].

Counts are conditional aggregates in one pass; a rate over no cases has the value that its row says. Percentiles are
order statistics of all values, from counts by value: no list of values is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.access import clearance_rank
from cairn.sources.tables import LADDER


def highest_clearance(users: DataFrame, roles: DataFrame) -> DataFrame:
    """user_id and the highest clearance over all roles of each user; a role that is not known and a clearance that is not on
    the ladder count as the lowest [D15]. users: user_id, role; roles: role, clearance."""
    j = users.join(roles, "role", "left")
    best = F.greatest(F.max(clearance_rank(F.col("clearance"))), F.lit(0))
    return j.groupBy("user_id").agg(F.element_at(F.array(*map(F.lit, LADDER)), (best + 1).cast("int")).alias("clearance"))


def grounding_rates(cases: DataFrame) -> DataFrame:
    """One row: how often unanswerable questions were refused and answerable ones answered with a citation and the expected
    words (1 if there were none of the kind), mean grounded ratio (0 if no case), unresolved citations and failed runs for each
    case [D23]. A run that failed counts as failed beside what else it is. cases: answerable, refused, found, citations,
    unresolved, grounded, failed."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    can = yes("answerable")
    right = ~yes("refused") & (F.coalesce("citations", F.lit(0)) > 0) & yes("found")
    share = lambda hit, of, none: F.when(F.count_if(of) > 0, F.round(F.count_if(hit & of) / F.count_if(of), 10)).otherwise(F.lit(none))
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        share(yes("refused"), ~can, 1.0).alias("refusal_rate"),
        share(right, can, 1.0).alias("answerable_accuracy"),
        F.coalesce(F.round(F.avg(F.coalesce(F.col("grounded"), F.lit(0.0))), 10), F.lit(0.0)).alias("mean_grounded_ratio"),
        F.round(F.coalesce(F.sum("unresolved"), F.lit(0)) / n, 10).alias("hallucinated_citation_rate"),
        F.round(F.count_if(yes("failed")) / n, 10).alias("failed_run_rate"),
    )


def routing_rates(decisions: DataFrame) -> DataFrame:
    """metric and value: decisions by lane and by stage, the shares of the stages, the share of images that met a model which can
    see (1 without images), the share of answers from the cache, and the element at floor(n f) of the sorted latencies
    [D19, D24]. decisions: lane, stage, latency_ms, has_images, sees, cached."""
    cells = decisions.groupBy("lane", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("has_images", F.lit(False))).alias("images"), F.count_if(F.coalesce("has_images", F.lit(False)) & F.coalesce("sees", F.lit(False))).alias("seen"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cached")
    )
    total = F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0)))
    stage = lambda k: F.round(F.coalesce(F.sum(F.when(F.col("stage") == k, F.col("n"))), F.lit(0)) / total, 10)
    shares = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("decisions"),
        stage(0).alias("stage0_share"),
        stage(2).alias("stage2_share"),
        F.when(F.sum("images") > 0, F.round(F.sum("seen") / F.sum("images"), 10)).otherwise(F.lit(1.0)).alias("vision_capability_rate"),
        F.round(F.coalesce(F.sum("cached"), F.lit(0)) / total, 10).alias("cache_hit_rate"),
    )
    names = shares.columns
    long = shares.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names)))).alias("metric", "value"))
    by = lambda c: cells.groupBy(F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("none"))).alias("metric")).agg(F.sum("n").cast("double").alias("value"))
    return long.union(by("lane")).union(by("stage")).union(floor_ranks(decisions, "latency_ms", {"decide_p50_ms": 0.5, "decide_p95_ms": 0.95}))


def floor_ranks(rows: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """metric and value: the elements at floor(n f) of the sorted column, 0 of none. Values are counted, the counts summed over
    ranges of values, and only the range that holds the element is looked at."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.repartitionByRange("v").withColumn("p", F.spark_partition_id())
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = parts.groupBy("p").agg(F.sum("n").alias("size")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    total = F.broadcast(starts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")))  # one row
    placed = parts.join(F.broadcast(starts.select("p", "start")), "p").withColumn("last", F.col("start") + F.sum("n").over(Window.partitionBy("p").orderBy("v"))).join(total)
    at = lambda f: F.least(F.floor(F.col("total") * F.lit(f)), F.col("total") - 1)
    hit = lambda f: (F.col("last") > at(f)) & (F.col("last") - F.col("n") <= at(f))
    out = placed.agg(*[F.coalesce(F.max(F.when(hit(f), F.col("v"))), F.lit(0.0)).alias(name) for name, f in wanted.items()])
    return out.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*map(F.col, wanted)))).alias("metric", "value"))


def approval_states(events: DataFrame, run: str = "run_id", seq: str = "seq", at: str = "ts") -> DataFrame:
    """Each event of a run's approvals with the state after it: what it does not say is as before, the status is its own or
    pending, and the time is counted from the run's first event [E18, E19]. events: run, seq, ts, status, approval_id, tool,
    expires_at, waiting_s, decided_by."""
    w = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    kept = {c: F.last(c, ignorenulls=True).over(w) for c in ("approval_id", "tool", "expires_at")}
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    return events.withColumns(
        kept | {"status": F.coalesce("status", F.lit("pending")), "waiting_s": F.coalesce(F.last("waiting_s", ignorenulls=True).over(w), F.lit(240)), "requested_at": F.first(at).over(w), "at_ms": ms - F.min(ms).over(Window.partitionBy(run))}
    )


#: A citation's fields with their defaults.
CITATION = {
    "n": ("int", 0), "chunk_id": ("string", ""), "doc_id": ("string", ""), "doc_title": ("string", ""), "page_no": ("int", 1), "snippet": ("string", ""), "section_path": ("array<string>", None),
    "score": ("double", 0.0), "retrieval_method": ("string", "hybrid"), "confidence": ("double", 1.0), "doc_type": ("string", ""), "parent_id": ("string", None), "bbox": ("struct<x0:double,y0:double,x1:double,y1:double>", None),
}


def read_citation(json: Column) -> Column:
    """The citation that a JSON object holds: missing and null fields have their defaults, unknown ones are ignored; what is no
    JSON object gives all defaults [B37]."""
    got = F.from_json(json, ", ".join(f"{n} {kind}" for n, (kind, _) in CITATION.items()))

    def one(name: str, kind: str, default: object) -> Column:
        if name == "section_path":
            return F.coalesce(got[name], F.array().cast(kind))
        if name == "bbox":
            return F.struct(*[F.coalesce(got[name][k], F.lit(0.0)).alias(k) for k in ("x0", "y0", "x1", "y1")])
        return F.coalesce(got[name], F.lit(default).cast(kind)) if default is not None else got[name]

    return F.struct(*[one(n, kind, default).alias(n) for n, (kind, default) in CITATION.items()])


def write_citation(citation: Column) -> Column:
    """A citation as JSON: scores to four places, confidence to three, the parent left out [B37]."""
    rounded = {"score": 4, "confidence": 3}
    names = [n for n in CITATION if n != "parent_id"]
    return F.to_json(F.struct(*[(F.round(citation[n], rounded[n]) if n in rounded else citation[n]).alias(n) for n in names]), {"ignoreNullFields": "false"})


def evidence(payload: Column, score: Column, method: str) -> Column:
    """An evidence row from a stored payload map: pages from 1, confidence 1 where there is none or zero [B35]."""
    text = lambda k: F.coalesce(payload[k], F.lit(""))
    number = lambda k, kind, default: F.coalesce(F.nullif(payload[k].try_cast(kind), F.lit(0).cast(kind)), F.lit(default).cast(kind))
    return F.struct(
        text("text").alias("text"), text("doc_id").alias("doc_id"), text("doc_title").alias("doc_title"), text("doc_type").alias("doc_type"), number("page_from", "int", 1).alias("page_from"), number("page_to", "int", 0).alias("page_to"),
        number("mean_confidence", "double", 1.0).alias("confidence"), payload["parent_id"].alias("parent_id"), score.alias("score"), F.lit(method).alias("retrieval_method"),
    )


def with_citations(messages: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    """Messages with their citations in order of their number, none for a message that has none [C7]. citations: the keys, n and
    what else a citation has."""
    rest = [c for c in citations.columns if c not in (*keys, "n")]
    nested = citations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", *rest))).alias("citations"))
    kind = nested.schema["citations"].dataType
    return messages.join(nested, keys, "left").withColumn("citations", F.coalesce("citations", F.array().cast(kind)))
