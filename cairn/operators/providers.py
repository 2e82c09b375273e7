"""Providers and models as rows [C23, C25, C26, D33, F13, G10, M15, M17, N5, P9, P11-P13, P16]. Asking a server stays outside."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_id(name: Column) -> Column:
    """A served name without the tag that means the newest [C23]."""
    return F.regexp_replace(F.lower(name), ":latest$", "")


def availability(models: DataFrame, served: DataFrame) -> DataFrame:
    """Whether each model is served by its provider [C23]. models: model, provider, physical; served: provider, name."""
    s = served.select("provider", normal_id(F.col("name")).alias("k"), F.lit(True).alias("there")).distinct()
    return models.withColumn("k", normal_id(F.col("physical"))).join(s, ["provider", "k"], "left").select("model", F.coalesce("there", F.lit(False)).alias("available"))


def stand_ins(failed: DataFrame, models: DataFrame) -> DataFrame:
    """For each failed model the first of its lane at another provider whose breaker is closed, null if none [C25]. failed:
    model; models: model, lane, provider, pos, open."""
    of = failed.join(models, "model").select(F.col("model").alias("failed"), "lane", F.col("provider").alias("not_provider"))
    ok = models.where("NOT open").select("lane", "provider", "pos", F.col("model").alias("other"))
    # a lane's first closed model of each provider is enough: lanes hold many models, providers are few
    first = ok.groupBy("lane", "provider").agg(F.min(F.struct("pos", "other")).alias("best"))
    found = of.join(first, (of["lane"] == first["lane"]) & (F.col("provider") != F.col("not_provider"))).groupBy("failed").agg(F.min("best").alias("best"))
    return failed.select(F.col("model").alias("failed")).join(found, "failed", "left").select("failed", F.col("best.other").alias("stand_in"))


def sharing_provider(failed: DataFrame, models: DataFrame) -> DataFrame:
    """All models of a provider that could not be reached [C26]."""
    return models.join(failed.join(models, "model").select("provider").distinct(), "provider", "left_semi").select("model", "provider")


def fallback(decisions: DataFrame, models: DataFrame) -> DataFrame:
    """The next model of the lane after one failed, with the confidence times 0.8; none is no row [N5]. decisions: request_id,
    lane, attempted array, confidence; models: model, lane, pos, open. Of n attempted models one of a lane's first n + 1 is
    left, so a lane's ladder is no longer than that, and a decision looks at so many of its own."""
    tries = F.size(F.array_distinct("attempted"))
    most = decisions.agg(F.max(tries)).first()[0] or 0
    w = Window.partitionBy("lane").orderBy("pos", "model")
    once = models.where("NOT open AND model IS NOT NULL").groupBy("lane", "model").agg(F.min(F.struct("pos"))["pos"].alias("pos"))
    first = once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.lit(max(most, 0) + 1))
    lanes = first.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("pos", "model"))).alias("ladder"))
    left = F.filter(F.slice("ladder", 1, tries + 1), lambda m: ~F.array_contains("attempted", m["model"]))
    return decisions.where("attempted IS NOT NULL").join(lanes, "lane").where(F.size(left) > 0).select("request_id", left[0]["model"].alias("model"), F.round(F.col("confidence") * 0.8, 10).alias("confidence"))


def unique_pairs(rows: DataFrame) -> DataFrame:
    """(provider, physical) pairs by first appearance [G10]. rows: pos, provider, physical."""
    return rows.groupBy("provider", "physical").agg(F.min("pos").alias("pos"))


def pinned(manifest: DataFrame, profile: DataFrame) -> DataFrame:
    """Models that the manifest or the profile pins, each once, sorted [P9]. manifest: model, pinned; profile: model."""
    return manifest.where("pinned").select("model").union(profile.select("model").join(manifest.select("model"), "model", "left_semi")).distinct().orderBy("model")


def with_defaults(entries: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Manifest entries with what they leave out [P13]."""
    return entries.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in entries.columns else F.lit(v) for k, v in defaults.items()})


def manifest_digest(entries: DataFrame, order: str, *columns: str) -> DataFrame:
    """One SHA-256 over the entries' canonical JSON in order [P12]. A manifest is a configuration file."""
    row = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), row.alias("j"))))
    return entries.agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("]")), 256).alias("digest"))


def health(checks: DataFrame) -> DataFrame:
    """Each provider's newest check [P11]. checks: provider, at, healthy, latency_ms, models."""
    best = F.max_by(F.struct("healthy", "latency_ms", "models"), "at").alias("b")
    return checks.groupBy("provider").agg(best).select("provider", "b.*")


def roll_up(providers: DataFrame, required: str = "required") -> DataFrame:
    """Whether any provider is healthy and whether all required ones are [D33]."""
    return providers.agg(F.bool_or("healthy").alias("any_healthy"), F.bool_and(F.col("healthy") | ~F.col(required)).alias("required_healthy"), F.count_if(~F.col("healthy")).alias("unhealthy"))


def distinct_prompts(prompts: DataFrame, decide: Column) -> DataFrame:
    """A costly decision once for each different prompt, and back to every row: the batch form of a cache by hash [M15].
    prompts: text; decide is over text."""
    keyed = prompts.withColumn("prompt_hash", F.sha2("text", 256))
    once = keyed.select("prompt_hash", "text").dropDuplicates(["prompt_hash"]).select("prompt_hash", decide.alias("decision"))
    return keyed.join(once, "prompt_hash")


def residency(uses: DataFrame, capacity: int) -> DataFrame:
    """Which uses of a model find it loaded, if the capacity most recently used stay [M17, F13, P16]: uses with hit and
    evicted. A host's log passes through its task in order; only the loaded models are held. uses: host bigint, seq bigint,
    model string."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, loaded = None, {}
        for f in frames:
            rows = []
            for h, seq, model in zip(f["host"], f["seq"], f["model"], strict=True):
                if h != host:
                    host, loaded = h, {}
                hit = loaded.pop(model, None) is not None
                loaded[model] = True
                gone = next(iter(loaded)) if len(loaded) > capacity else None
                if gone is not None:
                    del loaded[gone]
                rows.append((h, seq, model, hit, gone))
            yield pd.DataFrame(rows, columns=["host", "seq", "model", "hit", "evicted"])

    return uses.select("host", "seq", "model").repartition("host").sortWithinPartitions("host", "seq").mapInPandas(run, "host bigint, seq bigint, model string, hit boolean, evicted string")
