"""The relational surface: audit log, documents, conversations, identity, approvals [2-B, 2-C, 2-D, 2-F, 2-G, P17-P24]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def filtered(rows: DataFrame, since: str | None = None, time: str = "ts", **equal: object) -> DataFrame:
    """Equality on each given column, and times from since on [B14, I2]."""
    conditions = [F.col(k) == F.lit(v) for k, v in equal.items() if v is not None]
    if since is not None:
        conditions.append(F.col(time) >= F.lit(since).cast(rows.schema[time].dataType))
    return rows.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of an ordering that must be total [F6, B11]."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    """[D8, D10, D11]"""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """[D9]"""
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def newest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key, the last by order, without a sort of the groups [E9, E10]."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in columns])


def conversation_list(messages: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Conversations that have a message, with counts and the last assistant message's first 140 characters [C4-C7, E10]."""
    out = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.max("turn").alias("last_turn"),
        F.max_by(F.when(F.col("role") == "assistant", F.substring("content", 1, 140)), F.when(F.col("role") == "assistant", F.col("turn"))).alias("preview"),
    )
    if artifacts is None:
        return out
    n = artifacts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_artifacts"))
    return out.join(n, "conv_id", "left").withColumn("n_artifacts", F.coalesce("n_artifacts", F.lit(0).cast("long")))


def recent_history(messages: DataFrame, n: int = 6, width: int = 600) -> DataFrame:
    """The last n turns of each conversation in order, cut to width [F7]."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).select("conv_id", "turn", "role", F.substring("content", 1, width).alias("content"))


def grants(users: DataFrame, roles: DataFrame, permissions: DataFrame) -> DataFrame:
    """user_id, roles, permissions and whether the wildcard is held, by two many-to-many joins [C3, D16, P22].
    users: user_id, role_id; roles: role_id, role; permissions: role_id, permission."""
    held = users.join(roles, "role_id").join(permissions, "role_id", "left")
    return held.groupBy("user_id").agg(
        F.array_sort(F.collect_set("role")).alias("roles"),
        F.array_sort(F.collect_set("permission")).alias("permissions"),
        F.coalesce(F.bool_or(F.col("permission") == "admin:*"), F.lit(False)).alias("wildcard"),
    )


def display_names(rows: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Adds display_name: the full name, or the user name where it is empty, null for an unknown user [C8, C9]."""
    names = users.select(F.col("user_id").alias(key), F.coalesce(F.nullif(F.col("full_name"), F.lit("")), F.col("username")).alias("display_name"))
    return rows.join(names, key, "left")


def lockouts(events: DataFrame, limit: int = 5) -> DataFrame:
    """Failures since the last success of each user, and whether they lock [E21, I4, P23]. events: user, seq, ok."""
    w = Window.partitionBy("user").orderBy("seq")
    runs = events.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    last = Window.partitionBy("user").orderBy(F.desc("run"))
    failures = runs.groupBy("user", "run").agg(F.count(F.when(~F.col("ok"), 1)).alias("failures")).withColumn("r", F.row_number().over(last)).where("r = 1")
    return failures.select("user", "failures", (F.col("failures") >= limit).alias("locked"))


def stale(rows: DataFrame, as_of: str, seconds: int, status: str = "running", time: str = "updated_at", to: str = "failed") -> DataFrame:
    """Rows of a status untouched for too long get another [B31, B32, M11]."""
    old = (F.col("status") == status) & (F.col(time) < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds)))
    return rows.withColumn("status", F.when(old, to).otherwise(F.col("status")))


def decide(status: Column, requester: Column, approver: Column, approved: Column, expires: Column, now: Column) -> Column:
    """The approval state machine: struct<status, refused> [N14, I3]."""
    refused = F.when(status != "pending", F.lit("already decided")).when(now > expires, "expired").when(requester == approver, "own request")
    return F.struct(
        F.when(status != "pending", status).when(now > expires, "expired").when(requester == approver, status).when(approved, "approved").otherwise("rejected").alias("status"), refused.alias("refused")
    )


def visible_artifacts(rows: DataFrame, user_id: str, approver: bool) -> DataFrame:
    """Drafts and pending ones for their creator or an approver, rejected ones for an approver [B16-B18]."""
    open_ = F.col("status") == "approved"
    own = F.col("status").isin("draft", "pending") & ((F.col("created_by") == user_id) | F.lit(approver))
    return rows.where(open_ | own | ((F.col("status") == "rejected") & F.lit(approver)))


def soft_delete(documents: DataFrame, chunks: DataFrame, ids: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Documents marked deleted, their chunks gone [G11-G13]."""
    marked = documents.join(ids.select("doc_id", F.lit(as_of).cast("timestamp_ntz").alias("__gone")), "doc_id", "left")
    kept = marked.withColumn("deleted_at", F.coalesce("__gone", "deleted_at") if "deleted_at" in documents.columns else F.col("__gone")).drop("__gone")
    return kept, chunks.join(ids.select("doc_id"), "doc_id", "left_anti")


def revoke_sessions(sessions: DataFrame, compromised: DataFrame) -> DataFrame:
    """All sessions of a user one of whose revoked tokens came back [G14, P24]."""
    users = sessions.join(compromised.select("token_hash"), "token_hash", "left_semi").where("revoked").select("user_id").distinct().withColumn("__hit", F.lit(True))
    return sessions.join(users, "user_id", "left").withColumn("revoked", F.coalesce("__hit", F.lit(False)) | F.col("revoked")).drop("__hit")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """Rows by key: incoming wins, or only what is new is added [A31, A33, G7, G8]."""
    if replace:
        return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti"))


def unresolved(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys that a dimension lacks: must be empty before an inner join is trusted [C18, G5, N12, N13]."""
    return rows.join(dimension.select(key), key, "left_anti").select(key).distinct()


def hydrated(messages: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Messages with their run's status and how many artifacts it made [C10]. All by run_id; runs: run_id, status."""
    n = artifacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_artifacts"))
    return messages.join(runs.select("run_id", "status"), "run_id", "left").join(n, "run_id", "left").withColumn("n_artifacts", F.coalesce("n_artifacts", F.lit(0).cast("long")))


def failed_cases(cases: DataFrame, gold: DataFrame, source: str) -> DataFrame:
    """The cases of a suite that failed, with their question; a case that the gold set lacks has none [C20, P41]. Evidence is
    kept of these alone. cases: case_id, passed, actual, evidence; gold: case_id, query."""
    j = cases.where(~F.col("passed")).join(gold.select("case_id", "query"), "case_id", "left")
    return j.select("case_id", F.coalesce("query", F.lit("")).alias("prompt"), F.substring("actual", 1, 600).alias("actual"), "evidence", F.concat(F.lit(f"{source}:"), F.col("case_id").cast("string")).alias("source"))


def document_detail(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks [P19]."""
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return documents.join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))


def uploads(files: DataFrame, clearance: str, max_bytes: int, max_pages: int) -> DataFrame:
    """Files with the reason why they are not taken, null if they are [B13, B26]. files: classification, bytes, pages."""
    from cairn.functions.access import LADDER, outranks

    c = F.col("classification")
    reason = F.when(~F.coalesce(c.isin(*LADDER), F.lit(False)), "unknown classification").when(outranks(c, F.lit(clearance)), "above the uploader's clearance").when(F.col("bytes") > max_bytes, "too large").when(F.col("pages") > max_pages, "too many pages")
    return files.withColumn("refused", reason)


def needs_approval(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Whether a call needs a decision: by its tool, by the configuration, for touching restricted sources, or as a
    calculation for engineering [B29]. calls: call_id, tool, touched_restricted, engineering; tools: tool, requires, configured."""
    j = calls.join(tools, "tool", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select("call_id", (yes("requires") | yes("configured") | yes("touched_restricted") | yes("engineering")).alias("needs_approval"))


def owned(rows: DataFrame, user_id: Column, owner: str = "owner_id", archived: str = "archived") -> DataFrame:
    """A user's own rows that are not archived; others are as if they were not [B15, B9]."""
    return rows.where((F.col(owner) == user_id) & ~F.col(archived))


def changed(conversations: DataFrame, changes: DataFrame) -> DataFrame:
    """Conversations renamed or archived by the last change of each kind [P18]. changes: conv_id, seq, title, archived, of which
    one is null."""
    last = changes.groupBy("conv_id").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("new_title"), F.max_by("archived", F.when(F.col("archived").isNotNull(), F.col("seq"))).alias("new_archived"))
    j = conversations.join(last, "conv_id", "left")
    return j.withColumns({"title": F.coalesce("new_title", "title"), "archived": F.coalesce("new_archived", "archived")}).drop("new_title", "new_archived")


def appended(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations touched by their new messages: the newest time, and the title from the first question where there is none
    [P17]. messages: conv_id, turn, role, content, at."""
    n = messages.groupBy("conv_id").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("added"), F.min_by(F.substring("content", 1, 60), F.when(F.col("role") == "user", F.col("turn"))).alias("first"))
    j = conversations.join(n, "conv_id", "left")
    return j.withColumns({"updated_at": F.greatest("updated_at", "at"), "title": F.coalesce(F.nullif("title", F.lit("")), "first"), "added": F.coalesce("added", F.lit(0).cast("long"))}).drop("at", "first")


def after_decision(artifacts: DataFrame, approvals: DataFrame) -> DataFrame:
    """Artifacts with the status and the provenance that their approval's decision gives [P21]. artifacts: artifact_id, status,
    provenance map; approvals: artifact_id, status, decided_by."""
    j = artifacts.join(approvals.withColumnRenamed("status", "decision"), "artifact_id", "left")
    told = F.map_concat("provenance", F.map_from_arrays(F.array(F.lit("approval"), F.lit("decided_by")), F.array("decision", "decided_by")))
    done = F.coalesce(F.col("decision").isin("approved", "rejected"), F.lit(False))
    return j.select("artifact_id", F.when(done, F.col("decision")).otherwise(F.col("status")).alias("status"), F.when(done, told).otherwise(F.col("provenance")).alias("provenance"))


def live_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Sessions neither revoked nor over at a given time, which is always a parameter [I1, I5]."""
    return sessions.where(~F.col("revoked") & (F.col("expires_at") > as_of))
