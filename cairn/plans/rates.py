"""Queries of rates, clearances, carried states and stored citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import redaction, rules
from cairn.operators import measures
from cairn.plans.registry import ORACLE_SQL, query
from cairn.sources import tables


@query(
    """WITH u AS (SELECT o_custkey AS user_id, CAST(o_orderkey % 7 AS INTEGER) AS role FROM orders),
    r AS (SELECT user_id, max(CASE role WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END) AS best FROM u WHERE role <> 3 OR user_id % 4 = 0 GROUP BY 1)
    SELECT user_id, list_element(['public', 'internal', 'confidential', 'restricted'], best + 1) AS clearance FROM r"""
)
def role_clearances(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the roles of their orders; role 4 has a clearance off the ladder, 5 none, 6 is not known"""
    k = F.col("o_orderkey") % 7
    users = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("role"), k.cast("string")).alias("role")).where("role <> 'role3' OR user_id % 4 = 0")
    roles = spark.createDataFrame([("role0", "public"), ("role1", "internal"), ("role2", "confidential"), ("role3", "restricted"), ("role4", "cosmic"), ("role5", None)], "role string, clearance string")
    return measures.highest_clearance(users, roles)


@query(
    """WITH c AS (SELECT conv_id % 3 <> 0 AS answerable, length(text) < 60 AS refused, contains(lower(text), 'an') AS found, length(text) - length(replace(text, '.', '')) AS citations,
        CASE WHEN text LIKE '%?%' THEN 1 ELSE 0 END AS unresolved, (turn % 5) / 4.0::DOUBLE AS grounded, role = 'system' AS failed FROM conversations)
    SELECT count(*) AS cases, round(count(*) FILTER (refused AND NOT answerable) / greatest(1, count(*) FILTER (NOT answerable))::DOUBLE, 10) AS refusal_rate,
      round(count(*) FILTER (NOT refused AND citations > 0 AND found AND answerable) / greatest(1, count(*) FILTER (answerable))::DOUBLE, 10) AS answerable_accuracy, round(avg(grounded), 10) AS mean_grounded_ratio,
      round(sum(unresolved) / count(*)::DOUBLE, 10) AS hallucinated_citation_rate, round(count(*) FILTER (failed) / count(*)::DOUBLE, 10) AS failed_run_rate FROM c"""
)
def grounding_rates(spark: SparkSession, d: str) -> DataFrame:
    """Messages as answers to questions of which a third cannot be answered; a short one is taken for a refusal, stops for
    citations"""
    t = F.col("content")
    cases = tables.messages(spark, d).select(
        (F.col("conv_id") % 3 != 0).alias("answerable"), (F.length(t) < 60).alias("refused"), F.contains(F.lower(t), F.lit("an")).alias("found"), (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))).alias("citations"),
        F.when(t.contains("?"), 1).otherwise(0).alias("unresolved"), ((F.col("turn") % 5) / 4.0).alias("grounded"), (F.col("role") == "system").alias("failed"),
    )
    return measures.grounding_rates(cases)


@query(
    f"""WITH p AS ({ORACLE_SQL['prompt_routes']}), c AS (SELECT coalesce(lane, 'none') AS lane, CASE WHEN length(text) < 40 THEN 0 ELSE stage END AS stage, length(text) AS ms, turn % 4 = 1 AS img, turn % 4 = 1 AND conv_id % 5 <> 0 AS sees,
        row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) > 1 AS cached FROM p JOIN conversations USING (conv_id, turn)),
    s AS (SELECT list_sort(list(ms)) AS xs, count(*) AS n FROM c)
    SELECT 'decisions' AS metric, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'lane:' || lane, count(*)::DOUBLE FROM c GROUP BY lane UNION ALL SELECT 'stage:' || stage, count(*)::DOUBLE FROM c GROUP BY stage
    UNION ALL SELECT 'stage0_share', round(count(*) FILTER (stage = 0) / count(*)::DOUBLE, 10) FROM c UNION ALL SELECT 'stage2_share', round(count(*) FILTER (stage = 2) / count(*)::DOUBLE, 10) FROM c
    UNION ALL SELECT 'vision_capability_rate', round(count(*) FILTER (sees) / count(*) FILTER (img)::DOUBLE, 10) FROM c UNION ALL SELECT 'cache_hit_rate', round(count(*) FILTER (cached) / count(*)::DOUBLE, 10) FROM c
    UNION ALL SELECT 'decide_p50_ms', xs[least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1]::DOUBLE FROM s UNION ALL SELECT 'decide_p95_ms', xs[least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1]::DOUBLE FROM s"""
)
def routing_rates(spark: SparkSession, d: str) -> DataFrame:
    """Messages routed, short ones by the first stage, repeated texts from the cache"""
    m = tables.messages(spark, d)
    first = m.groupBy("content").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    r = m.select("conv_id", "turn", "content", rules.route(F.col("content")).alias("r")).join(first, "content")
    short, image = F.length("content") < 40, F.col("turn") % 4 == 1
    return measures.routing_rates(
        r.select(
            F.col("r.lane").alias("lane"), F.when(short, 0).otherwise(F.col("r.stage")).alias("stage"), F.length("content").alias("latency_ms"), image.alias("has_images"), (image & (F.col("conv_id") % 5 != 0)).alias("sees"),
            (F.struct("conv_id", "turn") != F.col("first")).alias("cached"),
        )
    )


@query(
    """WITH e AS (SELECT user_id AS run_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' END AS status, CASE WHEN event_id % 3 = 0 THEN 'a' || event_id END AS approval_id,
        CASE WHEN event_id % 4 = 0 THEN event_type END AS tool, CASE WHEN event_id % 5 = 0 THEN value END AS expires_at, CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 100 AS INTEGER) END AS waiting_s, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM events)
    SELECT run_id, seq, coalesce(status, 'pending') AS status, last_value(approval_id IGNORE NULLS) OVER w AS approval_id, last_value(tool IGNORE NULLS) OVER w AS tool, last_value(expires_at IGNORE NULLS) OVER w AS expires_at,
      coalesce(last_value(waiting_s IGNORE NULLS) OVER w, 240) AS waiting_s, first_value(ts) OVER w AS requested_at, ms - min(ms) OVER (PARTITION BY run_id) AS at_ms FROM e WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"""
)
def approval_states(spark: SparkSession, d: str) -> DataFrame:
    """The log as approval events that say only what is new"""
    i, kind = F.col("event_id"), F.col("event_type")
    e = tables.table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), i.alias("seq"), "ts", F.when(kind == "purchase", "approved").when(kind == "error", "rejected").alias("status"), F.when(i % 3 == 0, F.concat(F.lit("a"), i.cast("string"))).alias("approval_id"),
        F.when(i % 4 == 0, kind).alias("tool"), F.when(i % 5 == 0, F.col("value")).alias("expires_at"), F.when(i % 7 == 0, (i % 100).cast("int")).alias("waiting_s"),
    )
    return measures.approval_states(e).select("run_id", "seq", "status", "approval_id", "tool", "expires_at", "waiting_s", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"), "at_ms")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN CAST(doc_id % 9 AS INTEGER) ELSE 0 END AS n, CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 1, 80) END AS snippet,
      CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN CAST(1 + n_chars % 50 AS INTEGER) ELSE 1 END AS page_no, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 'dense' ELSE 'hybrid' END AS retrieval_method,
      CASE WHEN doc_id % 7 <> 0 AND doc_id % 4 = 0 THEN round((doc_id % 1000) / 999.0::DOUBLE, 4) ELSE 0 END AS score, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 2 END AS sections FROM documents"""
)
def stored_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations written as JSON with what they have, each seventh broken, read, written and read again"""
    i = F.col("doc_id")
    some = lambda when, value, name: F.when(when, value).alias(name)
    fields = F.struct(
        some(i % 2 == 0, (i % 9).cast("int"), "n"), F.substring("text", 1, 80).alias("snippet"), some(i % 3 == 0, (1 + F.col("n_chars") % 50).cast("int"), "page_no"), some(i % 5 == 0, F.lit("dense"), "retrieval_method"),
        some(i % 4 == 0, (i % 1000) / 999.0, "score"), F.array(F.lit("a"), F.col("source")).alias("section_path"), F.lit("odd").alias("unknown_field"),
    )
    json = F.when(i % 7 == 0, F.lit("{broken")).otherwise(F.to_json(fields))
    once = tables.table(spark, d, "documents").select("doc_id", measures.read_citation(json).alias("c"))
    again = once.select("doc_id", measures.read_citation(measures.write_citation(F.col("c"))).alias("c"))
    return again.select("doc_id", "c.n", "c.snippet", "c.page_no", "c.retrieval_method", "c.score", F.size("c.section_path").alias("sections"))


@query(
    """WITH m AS (SELECT conv_id, turn, role FROM conversations), c AS (SELECT conv_id, turn, unnest(range(1, CAST(turn % 4 AS BIGINT) + 1)) AS n FROM m WHERE role = 'assistant')
    SELECT m.conv_id, m.turn, coalesce(string_agg(n || ':' || (conv_id * 7 + n), ',' ORDER BY n), '') AS cited FROM m LEFT JOIN c USING (conv_id, turn) GROUP BY 1, 2"""
)
def message_citations(spark: SparkSession, d: str) -> DataFrame:
    """Messages with their citations as a list in order, answers of the assistant having up to three"""
    m = tables.messages(spark, d)
    n = F.explode(F.when(F.col("turn") % 4 > 0, F.sequence(F.col("turn") % 4, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))).alias("n")
    cited = m.where("role = 'assistant'").select("conv_id", "turn", n).withColumn("chunk_id", F.col("conv_id") * 7 + F.col("n"))
    out = measures.with_citations(m, cited, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["n"].cast("string"), c["chunk_id"].cast("string"))), ",").alias("cited"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS doc_type, CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 3 AS INTEGER) ELSE 1 END AS page_from, CAST(0 AS INTEGER) AS page_to,
    CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 0 THEN 1.0 ELSE (doc_id % 6) / 10.0::DOUBLE END AS confidence FROM documents"""
)
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evidence from payloads that lack fields, say zero or are no numbers"""
    i = F.col("doc_id")
    payload = F.map_from_arrays(
        F.array(*map(F.lit, ("doc_id", "doc_type", "page_from", "page_to", "mean_confidence"))),
        F.array(i.cast("string"), F.when(i % 2 == 0, F.col("source")), (i % 3).cast("string"), F.lit("none"), F.when(i % 4 != 0, ((i % 6) / 10.0).cast("string"))),
    )
    e = tables.table(spark, d, "documents").select("doc_id", measures.evidence(payload, F.lit(0.5), "dense").alias("e"))
    return e.select("doc_id", "e.doc_type", "e.page_from", "e.page_to", "e.confidence")


@query(
    """WITH e AS (SELECT *, 90 + event_id % 40 AS n FROM events)
    SELECT event_id, '{"event":"' || event_type || '","login":{"api_token":"[REDACTED]","who":{"mail":"write to [REDACTED] now","name":"u' || user_id || '"}},"many":[' || array_to_string(range(1, least(n, 100) + 1), ',')
      || CASE WHEN n > 100 THEN ',"[TRUNCATED: ' || (n - 100) || ' more items]"' ELSE '' END || ']}' AS stored FROM e"""
)
def redacted_props(spark: SparkSession, d: str) -> DataFrame:
    """Three levels of properties with a secret, an address and a long list"""
    u = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    who = F.struct(u.alias("name"), F.concat(F.lit("write to "), u, F.lit("@site.org now")).alias("mail"))
    login = F.struct(F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("api_token"), who.alias("who"))
    json = F.to_json(F.struct(F.sequence(F.lit(1), (90 + F.col("event_id") % 40).cast("int")).alias("many"), login.alias("login"), F.col("event_type").alias("event")))
    return tables.table(spark, d, "events").select("event_id", redaction.redact_json(json).alias("stored"))
