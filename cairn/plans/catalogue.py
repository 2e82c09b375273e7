"""Every registered query over the tables, with SQL for the ones that SQL can state.

A query's docstring or name says which operators it applies; its SQL is the independent statement that results are held
against. Queries whose rules need lookarounds have none and are tested against specification functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import engineering, figures, planning, reports, rules, scores, text
from cairn.functions.access import Principal, clearance_rank, granted, label_rank, missing, outranks, tree
from cairn.operators import answers, audit, chunking, evaluation, records, retrieval, routing
from cairn.plans.registry import ORACLE_SQL, query
from cairn.sources import files, shared, tables
from cairn.streaming import runs

ANALYST = Principal("u1", "confidential", frozenset({"ops", "safety"}))


# --- SQL parts --------------------------------------------------------------------------------------------------------
_ACL = """ list_element(['public','internal','confidential','restricted'], CAST({k} % 4 + 1 AS INTEGER)) AS classification,
 CASE WHEN {k} % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE [list_element(['ops','safety','finance'], CAST({k} % 3 + 1 AS INTEGER))] END AS departments,
 0.5 + ({k} % 6) / 10.0::DOUBLE AS mean_confidence """
_CHUNKS = f"chunks AS (SELECT doc_id AS chunk_id, text, lang, source AS doc_type, n_chars, {_ACL.format(k='doc_id')} FROM documents)"
_VECTORS = f"vectors AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vec, label, {_ACL.format(k='vec_id')} FROM embeddings)"
_SEEN = "classification IN ('public','internal','confidential') AND (len(departments) = 0 OR list_has_any(departments, ['ops','safety']))"
_AUDIT = "audit AS (SELECT event_id AS seq, ts, 'u' || CAST(user_id AS VARCHAR) AS actor, event_type AS action, CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS decision, value, props AS metadata FROM events)"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TERMS = f"""terms AS (SELECT item_id AS query_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9]{{3,}}'), lambda w: lower(w) NOT IN ({_STOP})), lambda w: lower(w)))) AS term FROM benchmark)"""


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g'))"


# --- access and listing [2-B] -----------------------------------------------------------------------------------------
@query(f"WITH {_CHUNKS} SELECT chunk_id, classification, len(departments) AS n_departments FROM chunks WHERE {_SEEN}")
def visible_chunks(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2, B4, K11"""
    return tables.chunks(spark, d).where(ANALYST.predicate()).select("chunk_id", "classification", F.size("departments").cast("long").alias("n_departments"))


@query(f"WITH {_CHUNKS} SELECT classification, count(*) AS n, min(chunk_id) AS first_id FROM chunks WHERE chunk_id NOT IN (3, 5, 8) AND (classification = 'public' OR len(departments) = 0) GROUP BY 1")
def predicate_tree(spark: SparkSession, d: str) -> DataFrame:
    """B3"""
    spec = {"should": [{"field": "classification", "value": "public"}, {"field": "departments", "empty": True}], "must_not": [{"field": "chunk_id", "any": [3, 5, 8]}]}
    return tables.chunks(spark, d).where(tree(spec)).groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_id"))


@query(
    """WITH l AS (SELECT n_name, CASE WHEN n_nationkey % 6 = 5 THEN 'secret' ELSE list_element(['public','internal','confidential','restricted','odd'], CAST(n_nationkey % 5 + 1 AS INTEGER)) END AS label,
        list_element(['public','internal','confidential','restricted','none'], CAST(n_regionkey % 5 + 1 AS INTEGER)) AS clearance FROM nation),
    r AS (SELECT *, CASE WHEN list_position(['public','internal','confidential','restricted'], label) > 0 THEN list_position(['public','internal','confidential','restricted'], label) - 1 ELSE 4 END AS lr,
        CASE WHEN list_position(['public','internal','confidential','restricted'], clearance) > 0 THEN list_position(['public','internal','confidential','restricted'], clearance) - 1 ELSE -1 END AS cr FROM l)
    SELECT n_name, label, clearance, CAST(lr AS INTEGER) AS label_rank, CAST(cr AS INTEGER) AS clearance_rank, lr > cr AS hidden FROM r"""
)
def ladder_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Unknown labels hide, unknown clearances see nothing"""
    n = tables.table(spark, d, "nation")
    label = F.when(F.col("n_nationkey") % 6 == 5, "secret").otherwise(tables._pick((*tables.LADDER, "odd"), F.col("n_nationkey")))
    rows = n.select("n_name", label.alias("label"), tables._pick((*tables.LADDER, "none"), F.col("n_regionkey")).alias("clearance"))
    return rows.withColumns({"label_rank": label_rank(F.col("label")), "clearance_rank": clearance_rank(F.col("clearance")), "hidden": outranks(F.col("label"), F.col("clearance"))})


@query(f"WITH {_CHUNKS} SELECT chunk_id, doc_type, lang FROM chunks WHERE classification IN ('public','internal','confidential') AND doc_type = 'src1' AND text ILIKE '%the%' ORDER BY chunk_id DESC LIMIT 50 OFFSET 5")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of the visible documents, newest first"""
    rows = tables.chunks(spark, d).where(F.col("classification").isin("public", "internal", "confidential") & (F.col("doc_type") == "src1") & F.col("text").ilike("%the%"))
    return records.page(rows.select("chunk_id", "doc_type", "lang"), [F.desc("chunk_id")], 50, 5)


@query(
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.mean_confidence') AS DOUBLE), 1.0) AS mean_confidence,
    coalesce(TRY_CAST(json_extract_string(props, '$.degraded') AS BOOLEAN), false) AS degraded FROM events"""
)
def summary_projection(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a JSON report with defaults"""
    e = tables.table(spark, d, "events")
    get = lambda k, t, v: F.coalesce(F.get_json_object("props", f"$.{k}").try_cast(t), F.lit(v).cast(t)).alias(k)
    return e.select("event_id", get("k", "bigint", 0), get("mean_confidence", "double", 1.0), get("degraded", "boolean", False))


@query(f"WITH {_AUDIT} SELECT seq, actor, action, decision FROM audit WHERE decision = 'deny' AND ts >= TIMESTAMP '2024-01-15 00:00:00'")
def audit_filter(spark: SparkSession, d: str) -> DataFrame:
    """B14, I2"""
    return records.filtered(tables.audit_events(spark, d), since="2024-01-15 00:00:00", decision="deny").select("seq", "actor", "action", "decision")


@query(
    f"WITH {_AUDIT} SELECT 'action' AS kind, action AS name, count(*) AS n FROM audit GROUP BY 2 UNION ALL SELECT 'decision', decision, count(*) FROM audit GROUP BY 2"
)
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Both counts from one aggregation by the pair"""
    both = records.counts(tables.audit_events(spark, d), "action", "decision")
    one = lambda c: both.groupBy(F.lit(c).alias("kind"), F.col(c).alias("name")).agg(F.sum("n").alias("n"))
    return one("action").union(one("decision"))


@query(f"WITH {_AUDIT} SELECT DISTINCT actor FROM audit WHERE actor IS NOT NULL")
def audit_actors(spark: SparkSession, d: str) -> DataFrame:
    """D9"""
    return records.distinct_values(tables.audit_events(spark, d), "actor")


@query(f"WITH {_AUDIT} SELECT seq, actor, action FROM audit WHERE decision = 'deny' ORDER BY seq DESC LIMIT 10")
def recent_denials(spark: SparkSession, d: str) -> DataFrame:
    """F8: a report of ten"""
    return records.page(tables.audit_events(spark, d).where("decision = 'deny'").select("seq", "actor", "action"), [F.desc("seq")], 10)


@query(f"WITH {_AUDIT} SELECT seq, date_trunc('day', ts) AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k FROM audit")
def audit_serialised(spark: SparkSession, d: str) -> DataFrame:
    """P38, I8"""
    return tables.audit_events(spark, d).select("seq", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.get_json_object("metadata", "$.k").cast("long").alias("k"))


#: A record's payload, all its fields.
_PAYLOAD = """CAST(json_object('action', action, 'actor_roles', NULL, 'actor_user_id', actor, 'actor_username', NULL, 'conversation_id', NULL, 'decision', decision, 'input_digest', NULL, 'lane', NULL,
    'metadata', json_object('k', json_extract_string(metadata, '$.k'), 'raw', metadata), 'model_used', NULL, 'output_digest', NULL, 'reason', NULL, 'resource_id', NULL, 'resource_type', NULL, 'run_id', NULL,
    'seq', seq, 'session_id', NULL, 'severity', CASE WHEN decision = 'deny' THEN 2 ELSE 0 END, 'step_id', NULL, 'tool_name', NULL, 'ts', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')) AS VARCHAR)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _records_of(tables.audit_events(spark, d))


def _records_of(log: DataFrame) -> DataFrame:
    """The log as audit records in 50 chains."""
    k = F.get_json_object("metadata", "$.k")
    return log.select((F.col("seq") % 50).alias("shard"), "seq", "ts", F.col("actor").alias("actor_user_id"), "action", "decision", F.when(F.col("decision") == "deny", 2).otherwise(0).alias("severity"), F.create_map(F.lit("raw"), "metadata", F.lit("k"), k).alias("metadata"))


@query(
    f"""WITH RECURSIVE {_AUDIT}, n AS (SELECT *, seq % 50 AS shard, row_number() OVER (PARTITION BY seq % 50 ORDER BY seq) AS k, {_PAYLOAD} AS p FROM audit),
    c AS (SELECT shard, seq, k, repeat('0', 64) AS prev_hash, sha256(p || '|' || repeat('0', 64)) AS hash FROM n WHERE k = 1
      UNION ALL SELECT n.shard, n.seq, n.k, c.hash, sha256(n.p || '|' || c.hash) FROM c JOIN n ON n.shard = c.shard AND n.k = c.k + 1)
    SELECT shard, seq, prev_hash, hash FROM c"""
)
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Hash chains of the log over all fields of a record"""
    return audit.append(_records(spark, d)).select("shard", "seq", "prev_hash", "hash")


@query(ORACLE_SQL["audit_chain"])
def audit_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same appended in three parts, each from the heads that the one before stored, with rows delivered twice"""
    rows, out, heads = _records(spark, d), None, None
    w = F.pmod(F.floor(F.col("seq") / 50), F.lit(1 << 62))
    most = rows.agg(F.max(w)).first()[0] or 0
    for k in range(3):
        part = rows.where((w > most * (k - 1) / 3) & (w <= most * (k + 1) / 3)) if k else rows.where(w <= most / 3)
        done = shared.kept(audit.append(part, heads), "chain")
        out = done if out is None else out.unionByName(done)
        heads = audit.heads(out)
    return out.select("shard", "seq", "prev_hash", "hash")


@query(
    f"""WITH {_AUDIT}, n AS (SELECT seq % 50 AS shard, seq, row_number() OVER (PARTITION BY seq % 50 ORDER BY seq) AS k FROM audit)
    SELECT shard, count(*) AS events, min(CASE WHEN shard < {len(audit.FIELDS)} AND k = 3 THEN CASE WHEN shard = {audit.FIELDS.index('seq')} THEN -seq ELSE seq END END) AS first_invalid_seq FROM n GROUP BY shard"""
)
def audit_verify(spark: SparkSession, d: str) -> DataFrame:
    """In each of 21 chains another field of the third record is altered after it was written"""
    rows = audit.append(_records(spark, d).withColumns({c: F.lit(None).cast("string") for c in audit.FIELDS if c not in ("seq", "ts", "actor_user_id", "action", "decision", "severity", "metadata", "actor_roles")} | {"actor_roles": F.array(F.lit("reader"), F.lit("author"))}))
    third = F.row_number().over(Window.partitionBy("shard").orderBy("seq")) == 3
    forged = {"seq": -F.col("seq"), "ts": F.col("ts") + F.expr("INTERVAL 1 MICROSECOND"), "severity": F.col("severity") + 1, "metadata": F.create_map(F.lit("raw"), F.lit("null")), "actor_roles": F.array(F.lit("author"))}
    rows = rows.withColumn("__third", third)
    altered = rows.withColumns({c: F.when(F.col("__third") & (F.col("shard") == k), forged.get(c, F.lit("forged"))).otherwise(F.col(c)) for k, c in enumerate(audit.FIELDS)}).drop("__third")
    return audit.verify(altered)


# --- conversations and identity [2-C, 2-F, P17-P22] ---------------------------------------------------------------------
@query(
    """SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, arg_max(left(text, 140), turn) FILTER (role = 'assistant') AS preview,
    count(*) FILTER (role = 'user' AND len(text) > 200) AS n_artifacts FROM conversations GROUP BY conv_id"""
)
def conversation_list(spark: SparkSession, d: str) -> DataFrame:
    """C4-C7, D11, E10"""
    m = tables.messages(spark, d)
    made = m.where((F.col("role") == "user") & (F.length("content") > 200)).select("conv_id")
    return records.conversation_list(m, made)


@query("SELECT conv_id, turn, role, left(text, 600) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    """F7"""
    return records.recent_history(tables.messages(spark, d))


@query(
    """WITH u AS (SELECT c_custkey AS user_id, c_nationkey AS role_id FROM customer), r AS (SELECT n_nationkey AS role_id, n_name AS role, n_regionkey FROM nation),
    p AS (SELECT role_id, 'region:' || r_name AS permission FROM r JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT role_id, 'admin:*' FROM r WHERE role_id = 3)
    SELECT user_id, list_sort(list_distinct(list(role))) AS roles, list_sort(list_distinct(list(permission))) AS permissions, bool_or(permission = 'admin:*') AS wildcard,
    NOT (bool_or(permission = 'admin:*') OR bool_or(permission = 'region:ASIA')) AS asia_missing FROM u JOIN r USING (role_id) LEFT JOIN p USING (role_id) GROUP BY user_id"""
)
def role_grants(spark: SparkSession, d: str) -> DataFrame:
    """C3, D15, D16, B27, B28, G4, P22"""
    users = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("role_id"))
    n = tables.table(spark, d, "nation")
    roles = n.select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role"))
    by_region = n.join(tables.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("role_id"), F.concat(F.lit("region:"), "r_name").alias("permission"))
    admin = n.where("n_nationkey = 3").select(F.col("n_nationkey").alias("role_id"), F.lit("admin:*").alias("permission"))
    out = records.grants(users, roles, by_region.union(admin))
    return out.withColumn("asia_missing", ~granted(F.array(F.lit("region:ASIA")), F.col("permissions")) & (F.size(missing(F.array(F.lit("region:ASIA")), F.col("permissions"))) > 0))


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'user' || c_custkey ELSE c_name END AS display_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey"""
)
def display_names(spark: SparkSession, d: str) -> DataFrame:
    """C8, C9"""
    c = tables.table(spark, d, "customer")
    users = c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("full_name"), F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("username"))
    return records.display_names(tables.table(spark, d, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 5 <> 3)")
def unresolved_keys(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of some nations are left out, so that there are keys to miss"""
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey"), "n_name")
    lost = records.unresolved(n, tables.table(spark, d, "supplier").where("s_nationkey % 5 <> 3").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey")
    return n.join(lost, "n_nationkey", "left_semi")


@query(
    """WITH a AS (SELECT user_id AS user, event_id AS seq, event_type <> 'error' AS ok FROM events), r AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user ORDER BY seq) AS run FROM a),
    l AS (SELECT user, max(run) AS run FROM r GROUP BY user) SELECT r.user, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (NOT ok) >= 1 AS locked FROM r JOIN l ON l.user = r.user AND l.run = r.run GROUP BY r.user"""
)
def login_lockouts(spark: SparkSession, d: str) -> DataFrame:
    """E21, I4, P23"""
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return records.lockouts(e, 1)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 900 SECOND THEN 'F' ELSE o_orderstatus END AS status FROM orders"""
)
def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    """B31, B32, M11"""
    o = tables.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    return records.stale(o, "1997-01-01 00:00:00", 900, status="O", to="F").select("o_orderkey", "status")


@query(
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'approved' END AS s, o_custkey % 7 AS rq, o_orderkey % 7 AS ap, o_orderkey % 2 = 0 AS ok, o_orderdate + INTERVAL 24 HOUR AS ex FROM orders)
    SELECT o_orderkey, CASE WHEN s <> 'pending' THEN s WHEN TIMESTAMP '1997-06-01' > ex THEN 'expired' WHEN rq = ap THEN s WHEN ok THEN 'approved' ELSE 'rejected' END AS status,
    CASE WHEN s <> 'pending' THEN 'already decided' WHEN TIMESTAMP '1997-06-01' > ex THEN 'expired' WHEN rq = ap THEN 'own request' END AS refused FROM a"""
)
def approval_decisions(spark: SparkSession, d: str) -> DataFrame:
    """N14, I3"""
    o = tables.table(spark, d, "orders")
    out = records.decide(
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved"), F.col("o_custkey") % 7, F.col("o_orderkey") % 7, F.col("o_orderkey") % 2 == 0,
        F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL 24 HOURS"), F.lit("1997-06-01").cast("timestamp_ntz"),
    )
    return o.select("o_orderkey", out.alias("x")).select("o_orderkey", "x.status", "x.refused")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc, sha256(text) AS sha256 FROM documents")
def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the hash of their content"""
    t = tables.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    first = t.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"))
    return t.join(first, "sha256").select("doc_id", "first_doc", "sha256")


@query(
    """WITH i AS (SELECT doc_id, 'new' AS state FROM documents WHERE doc_id % 3 = 0), e AS (SELECT doc_id, 'old' AS state FROM documents WHERE doc_id % 2 = 0)
    SELECT * FROM i UNION ALL SELECT * FROM e WHERE doc_id NOT IN (SELECT doc_id FROM i)"""
)
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A31, A33, G11, G12"""
    t = tables.table(spark, d, "documents").select("doc_id")
    return records.upsert(t.where("doc_id % 2 = 0").withColumn("state", F.lit("old")), t.where("doc_id % 3 = 0").withColumn("state", F.lit("new")), "doc_id")


# --- retrieval [2-L] ------------------------------------------------------------------------------------------------------
_DENSE = f"""{_VECTORS}, q AS (SELECT chunk_id AS query_id, vec AS q FROM vectors WHERE chunk_id % 50 = 0),
 d AS (SELECT query_id, chunk_id, mean_confidence, round(list_dot_product(q, vec) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(vec, vec))), 10) AS score FROM q, vectors WHERE {_SEEN}),
 dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d QUALIFY rank <= 40)"""
_TOKENS = "regexp_extract_all(lower(text), '[a-z]{1,4}-[0-9]{1,5}[a-z]?|[a-z0-9]+')"
_SPARSE = f"""{_CHUNKS}, {_TERMS}, p AS (SELECT chunk_id, unnest({_TOKENS}) AS term FROM chunks WHERE {_SEEN}),
 s AS (SELECT query_id, chunk_id, count(*) * CAST(0.1 AS DOUBLE) AS score FROM p JOIN terms USING (term) GROUP BY 1, 2),
 sr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 40)"""


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return tables.vectors(spark, d).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("q"))


def _text_queries(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {_DENSE} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM dr")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """L2, F2: cosine top 40 of each query under the predicate"""
    return retrieval.dense(_vector_queries(spark, d), tables.vectors(spark, d), ANALYST).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_SPARSE} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM sr")
def sparse_search(spark: SparkSession, d: str) -> DataFrame:
    """Any-term top 40 of each query under the predicate; passages carry their document's columns"""
    return retrieval.sparse(_text_queries(spark, d), tables.chunks(spark, d), ANALYST).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


# each vector query takes the words of a benchmark item, so all have both halves
_ASKED = f"""asked AS (SELECT DISTINCT chunk_id AS query_id, CAST(floor(chunk_id / 50) AS BIGINT) % (SELECT count(*) FROM benchmark) AS item_id FROM vectors WHERE chunk_id % 50 = 0),
 both_terms AS (SELECT a.query_id, t.term FROM asked a JOIN terms t ON t.query_id = a.item_id)"""
_FUSED = f"""{_DENSE}, {_SPARSE.replace('p AS (', _ASKED + ', p AS (', 1).replace('JOIN terms USING', 'JOIN both_terms USING')},
 b AS (SELECT query_id, chunk_id, rank, 'dense' AS method, 1.0::DOUBLE AS w FROM dr UNION ALL SELECT query_id, chunk_id, rank, 'sparse', 0.8::DOUBLE FROM sr),
 f AS (SELECT query_id, chunk_id, sum(w / (60 + rank)) AS raw, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(method) END AS method, 0.5 + (chunk_id % 6) / 10.0::DOUBLE AS c FROM b GROUP BY 1, 2),
 g AS (SELECT *, round(CASE WHEN c < 0.8 THEN raw * (1 - 0.15::DOUBLE * (0.8::DOUBLE - c) / 0.8::DOUBLE) ELSE raw END, 10) AS score FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM g QUALIFY rank <= 8)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    vectors, texts = _vector_queries(spark, d), _text_queries(spark, d)
    n = F.broadcast(texts.agg(F.count(F.lit(1)).alias("n")))  # one row
    asked = vectors.select("query_id").join(n).select("query_id", ((F.col("query_id") / 50).cast("long") % F.col("n")).alias("item_id"))
    words = asked.join(texts.withColumnRenamed("query_id", "item_id"), "item_id").select("query_id", "text")
    return retrieval.fuse(retrieval.dense(vectors, tables.vectors(spark, d), ANALYST), retrieval.sparse(words, tables.chunks(spark, d), ANALYST), limit=8)


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, score, method, CAST(rank AS INTEGER) AS rank FROM h")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Both searches fused, penalised, the best 8 of each query"""
    return _hybrid(spark, d).select("query_id", "chunk_id", "score", "method", "rank")


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, round(least(greatest(score / max(score) OVER (PARTITION BY query_id), 0.15), 1.0), 6) AS weight FROM h")
def evidence_edges(spark: SparkSession, d: str) -> DataFrame:
    """L13, J24, D32"""
    hits = _hybrid(spark, d).withColumns({"doc_type": F.lit("d"), "cited": F.lit(False)})
    return retrieval.evidence_graph(hits)[1]


@query(
    f"WITH {_CHUNKS}, a AS (SELECT chunk_id, n_chars * 1.0::DOUBLE AS score FROM chunks WHERE chunk_id % 2 = 0), b AS (SELECT chunk_id, n_chars * 0.5::DOUBLE + 300 AS score FROM chunks WHERE chunk_id % 3 = 0) SELECT chunk_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY chunk_id"
)
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    """G2, G3, F9, M12"""
    c = tables.chunks(spark, d)
    return retrieval.merge_evidence(c.where("chunk_id % 2 = 0").select("chunk_id", (F.col("n_chars") * 1.0).alias("score")), c.where("chunk_id % 3 = 0").select("chunk_id", (F.col("n_chars") * 0.5 + 300).alias("score")))


@query(
    f"WITH {_CHUNKS} SELECT chunk_id, CASE WHEN len(l) <= 240 THEN l ELSE regexp_replace(left(l, 240), '\\s\\S*$', '') || '…' END AS snippet, round(mean_confidence, 3) AS confidence FROM (SELECT *, trim(replace(text, chr(10), ' ')) AS l FROM chunks)"
)
def citations(spark: SparkSession, d: str) -> DataFrame:
    """One line of each passage"""
    return tables.chunks(spark, d).select("chunk_id", text.snippet(F.col("text")).alias("snippet"), F.round("mean_confidence", 3).alias("confidence"))


# --- chunking [2-E] -----------------------------------------------------------------------------------------------------
@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children of every document; each 7th line opens a section"""
    t = tables.table(spark, d, "documents")
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 7 == 3, F.concat(F.lit("## "), F.substring(s, 1, 40))).otherwise(s))
    return chunking.chunk(chunking.blocks_of(t.select("doc_id", F.array_join(lines, "\n\n").alias("text"))))


@query("SELECT doc_id, count(*) AS blocks, CAST(sum(greatest(1, CAST(floor(len(b) / 3.6::DOUBLE) AS INTEGER))) AS BIGINT) AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents) WHERE trim(b) <> '' GROUP BY doc_id")
def block_totals(spark: SparkSession, d: str) -> DataFrame:
    """A15, B19, H3, D11"""
    t = tables.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("b")).where(F.trim("b") != "")
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(text.estimated_tokens(F.col("b"))).alias("tokens"))


@query(
    """SELECT l_orderkey AS doc_id, coalesce(sum(c * w) FILTER (w > 0) / sum(w) FILTER (w > 0), 1.0) AS confidence, min(x) AS x0, max(x) AS x1, CAST(sum(w) AS BIGINT) AS words FROM
    (SELECT l_orderkey, 0.5 + (l_linenumber % 6) / 10.0::DOUBLE AS c, CAST(l_quantity AS BIGINT) % 11 AS w, l_discount AS x FROM lineitem) GROUP BY l_orderkey"""
)
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence weighted by words"""
    t = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (0.5 + (F.col("l_linenumber") % 6) / 10.0).alias("confidence"), (F.col("l_quantity").cast("long") % 11).alias("words"), "l_discount")
    return t.groupBy("doc_id").agg(scores.weighted_confidence().alias("confidence"), F.min("l_discount").alias("x0"), F.max("l_discount").alias("x1"), F.sum("words").alias("words"))


@query(
    """WITH p AS (SELECT page_id, CAST(page_id * 37 % 60 AS BIGINT) AS words, 0.5 + (page_id % 6) / 10.0::DOUBLE AS confidence, 0.4 + (page_id % 5) / 10.0::DOUBLE AS alpha, page_id % 9 = 0 AS drawing, page_id % 11 = 0 AS hand, page_id % 10 = 0 AS blank FROM pages)
    SELECT page_id, array_to_string(CASE WHEN blank AND words = 0 THEN [] ELSE list_filter([CASE WHEN drawing THEN 'drawing' END, CASE WHEN hand THEN 'handwriting' END, CASE WHEN words < 30 THEN 'too_few_words' END,
    CASE WHEN words > 0 AND confidence < 0.72 THEN 'low_confidence' END, CASE WHEN words > 0 AND alpha < 0.55 THEN 'garbled' END], lambda x: x IS NOT NULL) END, ',') AS reasons FROM p"""
)
def page_escalation(spark: SparkSession, d: str) -> DataFrame:
    """B21-B23, L11, L12"""
    i = F.col("page_id")
    verdict = scores.page_verdict(i * 37 % 60, 0.5 + (i % 6) / 10.0, 0.4 + (i % 5) / 10.0, i % 9 == 0, i % 11 == 0, i % 10 == 0)
    return tables.table(spark, d, "pages").select("page_id", F.array_join(verdict, ",").alias("reasons"))


@query(
    """WITH t AS (SELECT p_partkey, CAST(p_size * 90 AS INTEGER) AS w, CAST(p_size * 60 AS INTEGER) AS h FROM part), b AS (SELECT p_partkey, w, h, unnest(range(0, w, 896)) AS x FROM t), c AS (SELECT *, unnest(range(0, h, 896)) AS y FROM b)
    SELECT p_partkey, count(*) AS tiles, CAST(sum((least(x + 1024, w) - x) * (least(y + 1024, h) - y)) AS BIGINT) AS area FROM c WHERE least(x + 1024, w) - x >= 64 AND least(y + 1024, h) - y >= 64 GROUP BY p_partkey"""
)
def image_tiles(spark: SparkSession, d: str) -> DataFrame:
    """A21, J21"""
    w, h = (F.col("p_size") * 90).cast("int"), (F.col("p_size") * 60).cast("int")
    t = tables.table(spark, d, "part").select("p_partkey", F.explode(scores.tiles(w, h)).alias("b"))
    return t.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("tiles"), F.sum(((F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))).cast("long")).alias("area"))


@query()
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    """Text and blocks of web pages"""
    t = tables.table(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))
    return t.select("page_id", F.size(F.filter(F.split("text", "\n"), lambda s: s != "")).cast("long").alias("blocks"), text.word_count(F.col("text")).alias("words"), F.sha2("text", 256).alias("sha256"))


# --- text functions [2-H] ---------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {_norm('text')} AS normalised FROM documents")
def normalised_text(spark: SparkSession, d: str) -> DataFrame:
    """H11"""
    return tables.table(spark, d, "documents").select("doc_id", text.normalised(F.col("text")).alias("normalised"))


@query(
    f"SELECT item_id, array_to_string(list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{{3,}}')), lambda w: false), '') AS none, CAST(len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9]{{3,}}'), lambda w: lower(w) NOT IN ({_STOP})))) AS BIGINT) AS n_terms FROM benchmark"
)
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """H1, E15"""
    return tables.table(spark, d, "benchmark").select("item_id", F.lit("").alias("none"), F.size(text.query_terms(F.col("text"))).cast("long").alias("n_terms"))


@query()
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document; its word classes are Java's, so it is held against a Python statement of the masks"""
    return tables.table(spark, d, "documents").select("doc_id", F.sha2(text.redact_text(F.col("text")), 256).alias("redacted"))


@query(
    "SELECT event_id, CASE WHEN event_type LIKE '%sign%' THEN '[REDACTED]' ELSE event_type END AS masked FROM (SELECT event_id, event_type FROM events)"
)
def redacted_maps(spark: SparkSession, d: str) -> DataFrame:
    """A map whose key is sensitive for some rows"""
    e = tables.table(spark, d, "events")
    key = F.when(F.col("event_type").contains("sign"), "user_password").otherwise("kind")
    return e.select("event_id", F.element_at(F.map_values(text.redact_map(F.create_map(key, F.col("event_type")))), 1).alias("masked"))


@query("SELECT n_nationkey, trim(regexp_replace(lower(n_comment), '[^a-z0-9]+', '_', 'g'), '_') AS slug, left(regexp_replace(n_comment, '[\\[\\]:*?/\\\\]', '-', 'g'), 31) AS sheet FROM nation".replace("n_comment", "n_name || ' / Report: 2029'"))
def name_slugs(spark: SparkSession, d: str) -> DataFrame:
    """H6, H30"""
    name = F.concat("n_name", F.lit(" / Report: 2029"))
    return tables.table(spark, d, "nation").select("n_nationkey", text.slug(name).alias("slug"), text.sheet_name(name).alias("sheet"))


@query("SELECT doc_id, CASE WHEN len(text) <= 500 THEN text WHEN strpos(reverse(left(text, 500)), ' ') > 0 AND 500 - strpos(reverse(left(text, 500)), ' ') > 400 THEN left(text, 500 - strpos(reverse(left(text, 500)), ' ')) ELSE left(text, 500) END AS fitted FROM documents")
def fitted_text(spark: SparkSession, d: str) -> DataFrame:
    """H5, B38"""
    return tables.table(spark, d, "documents").select("doc_id", text.fit(F.col("text"), 500).alias("fitted"))


@query()
def answer_features(spark: SparkSession, d: str) -> DataFrame:
    """Sentences, figures, markers, refusals of messages"""
    m = tables.messages(spark, d).where("role = 'assistant'")
    c = F.col("content")
    return m.select("conv_id", "turn", F.size(text.sentences(c)).alias("sentences"), F.size(figures.figures(c)).alias("figures"), F.size(text.marker_ids(c)).alias("markers"), rules.is_refusal(c).alias("refusal"), F.sha2(text.restore_spaces(text.plain_maths(text.strip_markers(c))), 256).alias("clean"))


@query("SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda x: CASE WHEN contains(replace(x, ',', ''), '.') THEN rtrim(rtrim(replace(x, ',', ''), '0'), '.') ELSE replace(x, ',', '') END))) AS numbers FROM documents")
def numbers_in_text(spark: SparkSession, d: str) -> DataFrame:
    """H12, H13"""
    return tables.table(spark, d, "documents").select("doc_id", F.array_sort(figures.numbers(F.col("text"))).alias("numbers"))


@query(
    """SELECT conv_id, turn, CASE WHEN len(x) = 0 THEN 0.0 ELSE levenshtein(x, y) / len(x)::DOUBLE END AS cer, CASE WHEN len(replace(x, ' ', '')) = 0 THEN 0.0 ELSE levenshtein(replace(x, ' ', ''), replace(y, ' ', '')) / len(replace(x, ' ', ''))::DOUBLE END AS cer_no_spaces
    FROM (SELECT conv_id, turn, {a} AS x, {b} AS y FROM conversations) a""".format(a=_norm("text"), b=_norm("replace(text, 'the ', 'teh')"))
)
def character_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error rates of whole messages with a planted fault"""
    m = tables.messages(spark, d).repartition("conv_id", "turn")
    pair = m.select("conv_id", "turn", text.normalised(F.col("content")).alias("x"), text.normalised(F.replace("content", F.lit("the "), F.lit("teh"))).alias("y"))
    return pair.select("conv_id", "turn", evaluation.character_error_rate(F.col("x"), F.col("y")).alias("cer"), evaluation.character_error_rate(F.col("x"), F.col("y"), False).alias("cer_no_spaces"))


@query()
def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with planted faults"""
    t = tables.table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    pair = t.select("doc_id", text.normalised(F.col("text")).alias("x"), text.normalised(F.regexp_replace(F.replace("text", F.lit("the "), F.lit("the")), "ing", "ihg")).alias("y"))
    return pair.select("doc_id", evaluation.document_errors("x", "y").alias("f")).select("doc_id", F.round("f.cer", 10).alias("cer"), F.round("f.wer", 10).alias("wer"), *(F.col(f"f.{k}") for k in (*evaluation.FAULT_KINDS, "words")))


# --- rules and routing [2-N] ---------------------------------------------------------------------------------------------
def _feature_sql(c: str) -> str:
    hits = ", ".join(f"CAST(len(regexp_extract_all({c}, '{p}')) AS BIGINT) AS {k}" for k, p in rules.FEATURES.items() if k != "unit_hits")
    flags = ", ".join(f"regexp_matches({c}, '{p}') AS {k}" for k, p in rules.FLAGS.items())
    return f"CAST(len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')) AS BIGINT) AS word_count, {hits}, {flags}"


@query(f"SELECT conv_id, turn, {_feature_sql('text')} FROM conversations")
def prompt_features(spark: SparkSession, d: str) -> DataFrame:
    """H19, H20, K9"""
    return tables.messages(spark, d).select("conv_id", "turn", rules.prompt_features(F.col("content")).alias("f")).select("conv_id", "turn", "f.*").drop("unit_hits")


@query(
    f"""WITH f AS (SELECT conv_id, turn, {_feature_sql('text')} FROM conversations),
    s AS (SELECT conv_id, turn, 3.0 * has_code_fence::INT + 2.0 * least(code_verb_hits, 3) + 1.5 * least(file_extension_hits, 2) + 1.5 * least(library_hits, 2) + 2.5 * artifact_code_request::INT AS coding,
      1.0 + least(comparison_verb_hits, 3) + 1.3 * (word_count > 40)::INT AS reasoning, 2.5 * summarise_document::INT + 1.5 * multi_document::INT AS long_ctx, 1.0 * (word_count < 5)::INT AS utility FROM f),
    r AS (SELECT *, list_reverse_sort([coding, reasoning, long_ctx, 0.0, utility]) AS o FROM s)
    SELECT conv_id, turn, CASE WHEN o[1] - o[2] < 0.25 THEN NULL WHEN o[1] = coding THEN 'coding' WHEN o[1] = reasoning THEN 'reasoning' WHEN o[1] = long_ctx THEN 'long_ctx' ELSE 'utility' END AS lane,
    CASE WHEN o[1] - o[2] < 0.25 THEN 2 ELSE 1 END AS stage FROM r"""
)
def prompt_routes(spark: SparkSession, d: str) -> DataFrame:
    """N2, J15, F12"""
    return tables.messages(spark, d).select("conv_id", "turn", rules.route(F.col("content")).alias("r")).select("conv_id", "turn", "r.lane", "r.stage")


@query(
    """WITH m AS (SELECT p_partkey AS model, p_size % 3 AS lane, CAST(p_size * 1000 AS BIGINT) AS w, 1 + p_size % 4 AS q, 1 + p_partkey % 4 AS s, 2.0 + p_size % 9 AS ram, p_partkey % 5 = 0 AS res, p_partkey % 13 = 0 AS open FROM part),
    r AS (SELECT s_suppkey AS request_id, s_suppkey % 3 AS lane, CAST(floor((s_suppkey * 977 % 60000) * 1.25) AS BIGINT) AS need FROM supplier),
    j AS (SELECT *, CASE WHEN res THEN 0.0 ELSE 6.0 * greatest(0.5, ram / 6) END AS cost, CASE WHEN open THEN 'circuit open' WHEN w < need THEN 'window too small' END AS reason FROM r JOIN m USING (lane)),
    k AS (SELECT *, round((5.0 - q) + (5.0 - s) * 0.5 - cost * 0.15 + res::INT, 9) AS score FROM j),
    o AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY reason IS NOT NULL, CASE WHEN reason IS NULL THEN -score WHEN reason = 'window too small' THEN -w ELSE 'infinity'::DOUBLE END, model) AS rn FROM k)
    SELECT request_id, model, CAST(round(cost, 6) AS DOUBLE) AS swap_s, reason IS NOT NULL AS requires_chunking FROM o WHERE rn = 1 AND (reason IS NULL OR reason = 'window too small')"""
)
def model_selection(spark: SparkSession, d: str) -> DataFrame:
    """B30, C22, F11, J13, J14, N3, N4"""
    p = tables.table(spark, d, "part")
    models = p.select(
        F.col("p_partkey").alias("model"), (F.col("p_size") % 3).cast("long").alias("lane"), F.col("p_partkey").alias("pos"), F.array(F.lit("chat")).alias("capabilities"), (F.col("p_size") * 1000).cast("long").alias("window"),
        (1 + F.col("p_size") % 4).alias("quality_tier"), (1 + F.col("p_partkey") % 4).alias("speed_tier"), (2.0 + F.col("p_size") % 9).alias("ram_gb"), (F.col("p_partkey") % 5 == 0).alias("resident"), (F.col("p_partkey") % 13 == 0).alias("open"),
    )
    s = tables.table(spark, d, "supplier")
    need = routing.required(F.lit("reasoning"), F.col("s_suppkey") * 977 % 60000, F.lit(False), F.lit(False))
    requests = s.select(F.col("s_suppkey").alias("request_id"), (F.col("s_suppkey") % 3).cast("long").alias("lane"), need.alias("needs"))
    return routing.select_models(requests, models).withColumn("swap_s", F.round("swap_s", 6))


@query("SELECT CAST(p_size % 7 AS BIGINT) AS physical, max(p_retailprice) AS ram_gb, list_sort(list(p_partkey)) AS names, bool_or(p_partkey % 10 = 0) AS pinned FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def resident_memory(spark: SparkSession, d: str) -> DataFrame:
    """D17, D18"""
    p = tables.table(spark, d, "part").select((F.col("p_size") % 7).cast("long").alias("physical"), F.col("p_retailprice").alias("ram_gb"), F.col("p_partkey").alias("model"), (F.col("p_partkey") % 10 == 0).alias("pinned"), (F.col("p_partkey") % 2 == 0).alias("resident"))
    return routing.resident_gb(p)


@query(
    """WITH e AS (SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS calls, CAST(floor(value) AS BIGINT) AS tokens, 1.0::DOUBLE AS wall_s FROM events),
    r AS (SELECT *, sum(calls) OVER w AS c, sum(tokens) OVER w AS t, sum(wall_s) OVER w AS s FROM e WINDOW w AS (PARTITION BY run_id ORDER BY seq))
    SELECT run_id, seq, CAST(c AS BIGINT) AS calls_used, CAST(t AS BIGINT) AS tokens_used, CASE WHEN c >= 5 THEN 'tool calls' WHEN t >= 2000 THEN 'tokens' WHEN s >= 30 THEN 'time' END AS exhausted FROM r"""
)
def run_budgets(spark: SparkSession, d: str) -> DataFrame:
    """M13"""
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("calls"), F.floor("value").cast("long").alias("tokens"), F.lit(1.0).alias("wall_s"))
    return routing.budget_state(e, 5, 2000, 30).select("run_id", "seq", "calls_used", "tokens_used", "exhausted")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS model, floor(epoch(ts)) AS at, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT DISTINCT model, CAST(0 AS BIGINT) AS k, 0 AS n, CAST(0 AS DOUBLE) AS first, false AS open FROM e
      UNION ALL SELECT e.model, e.k, CASE WHEN e.ok THEN 0 WHEN r.n = 0 OR e.at - r.first > 864000 THEN 1 ELSE r.n + 1 END, CASE WHEN e.ok THEN 0 WHEN r.n = 0 OR e.at - r.first > 864000 THEN e.at ELSE r.first END,
        NOT e.ok AND (r.open OR CASE WHEN r.n = 0 OR e.at - r.first > 864000 THEN 1 ELSE r.n + 1 END >= 2) FROM r JOIN e ON e.model = r.model AND e.k = r.k + 1)
    SELECT model, arg_max(n, k) AS failures, arg_max(open, k) AS open FROM r GROUP BY model"""
)
def circuit_breakers(spark: SparkSession, d: str) -> DataFrame:
    """E20, M14"""
    e = tables.table(spark, d, "events").select(F.col("user_id").alias("model"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return routing.breaker(e, 2, 86400 * 10)


# --- streams and folds [2-M] ------------------------------------------------------------------------------------------------
_RUNS = "e AS (SELECT user_id AS run_id, event_id, ts, event_type AS name, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", F.col("event_type").alias("name"), "value")


@query(
    f"""WITH {_RUNS} SELECT run_id, count(*) AS n_events, arg_max(name, seq) AS last_name, arg_min(value, seq) FILTER (name = 'purchase') AS first_decision, arg_max(value, seq) FILTER (name = 'error') AS last_error,
    CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS wall_ms FROM e GROUP BY run_id"""
)
def run_records(spark: SparkSession, d: str) -> DataFrame:
    """M1, M8, M9, E11, E18, E19, I6"""
    return runs.run_record(runs.numbered(_runs(spark, d)))


@query(f"WITH {_RUNS} SELECT run_id, seq, name FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM e) WHERE r <= 20 AND seq > 5")
def replay_buffer(spark: SparkSession, d: str) -> DataFrame:
    """M2, M3, G9"""
    return runs.replay(runs.numbered(_runs(spark, d)).withColumn("seq", F.col("seq").cast("long")), 5, 20).select("run_id", "seq", "name")


@query(f"WITH {_RUNS} SELECT date_trunc('day', ts) AS start, name, count(*) AS n FROM e GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """M (addition): windows of a day"""
    return runs.windowed_counts(_runs(spark, d)).select(F.col("start").cast("timestamp_ntz").alias("start"), "name", "n")


@query(
    f"""WITH {_RUNS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts) AS k FROM g) SELECT run_id, min(ts) AS start, count(*) AS n FROM s GROUP BY run_id, k"""
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """M (addition): sessions with a gap of six hours"""
    return runs.sessions(_runs(spark, d)).select("run_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    f"WITH {_RUNS}, g AS (SELECT run_id, epoch(ts) AS t, lead(epoch(ts)) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS n FROM (SELECT run_id, event_id, date_trunc('second', ts) AS ts0, ts FROM e)) SELECT run_id, CAST(count(*) AS BIGINT) AS gaps FROM g WHERE floor(n) - floor(t) > 3600 GROUP BY run_id"
)
def silence(spark: SparkSession, d: str) -> DataFrame:
    """M5: runs' silences of more than an hour"""
    return runs.heartbeats(_runs(spark, d), 3600).groupBy("run_id").agg(F.count(F.lit(1)).alias("gaps"))


@query(f"WITH {_RUNS} SELECT run_id, event_id, round(avg(value) OVER (PARTITION BY run_id ORDER BY event_id ROWS 9 PRECEDING), 6) AS mean FROM e")
def rolling_latency(spark: SparkSession, d: str) -> DataFrame:
    """M16"""
    e = _runs(spark, d).select(F.col("run_id").alias("key"), F.col("event_id").alias("seq"), "value")
    return routing.rolling_sample(e, 10).select(F.col("key").alias("run_id"), F.col("seq").alias("event_id"), F.round("mean", 6).alias("mean"))


# --- evaluation [2-D, 2-J] ---------------------------------------------------------------------------------------------------
@query(
    f"""WITH {_DENSE}, g AS (SELECT a.chunk_id AS query_id, b.chunk_id FROM vectors a JOIN vectors b ON a.label = b.label AND a.chunk_id % 50 = 0),
    n AS (SELECT query_id, count(*) AS rel FROM g GROUP BY 1), f AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM dr JOIN g USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY 1)
    SELECT query_id, round(coalesce(found / rel::DOUBLE, 0), 10) AS recall, round(coalesce(1 / first::DOUBLE, 0), 10) AS reciprocal_rank,
    round(coalesce(gain / list_sum(list_transform(range(1, least(rel, 10) + 1), lambda r: 1 / log2(r + 1))), 0), 10) AS ndcg FROM n LEFT JOIN f USING (query_id)"""
)
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Dense search against vectors of the same label"""
    v = tables.vectors(spark, d)
    labels = v.select("chunk_id", "label")
    asked = labels.where("chunk_id % 50 = 0").withColumnsRenamed({"chunk_id": "query_id", "label": "wanted"})
    sizes = asked.join(labels.groupBy(F.col("label").alias("wanted")).agg(F.count(F.lit(1)).alias("relevant")), "wanted").select("query_id", "relevant")
    hits = retrieval.dense(_vector_queries(spark, d), v, ANALYST).join(labels, "chunk_id").join(asked, "query_id").select("query_id", "rank", (F.col("label") == F.col("wanted")).alias("hit"))
    return evaluation.ranking_metrics(hits, sizes)


_PAIRS = "p AS (SELECT CAST(l.quality AS VARCHAR) AS expected, CASE WHEN d.n_chars > 400 THEN '1' ELSE '0' END AS actual FROM labels l JOIN documents d USING (doc_id))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    j = tables.table(spark, d, "labels").join(tables.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("quality").cast("string").alias("expected"), F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("actual"))


@query(f"WITH {_PAIRS} SELECT expected, actual, count(*) AS n FROM p GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """D20, F10"""
    return evaluation.confusion(_pairs(spark, d))


@query(
    f"""WITH {_PAIRS}, e AS (SELECT expected AS label, count(*) AS support, count(*) FILTER (expected = actual) AS hit FROM p GROUP BY 1), a AS (SELECT actual AS label, count(*) AS predicted FROM p GROUP BY 1)
    SELECT label, round(coalesce(hit / predicted::DOUBLE, 1.0), 10) AS precision, round(hit / support::DOUBLE, 10) AS recall, support FROM e LEFT JOIN a USING (label)"""
)
def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """D20, D23, D24"""
    return evaluation.per_label(evaluation.confusion(_pairs(spark, d)))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """D19, J19, P15"""
    return tables.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), evaluation.nearest_rank("value", 0.5).alias("p50"), evaluation.nearest_rank("value", 0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    """WITH m AS (SELECT 'suite' || CAST(o_orderkey % 5 AS VARCHAR) AS suite, o_orderpriority AS metric, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2),
    t AS (SELECT DISTINCT o_orderpriority AS metric, CASE WHEN o_orderpriority LIKE '1%' THEN '<=' ELSE '>=' END AS op, 150000.0::DOUBLE AS threshold FROM orders WHERE o_orderpriority NOT LIKE '5%')
    SELECT suite, bool_and(coalesce(CASE WHEN op = '>=' THEN value >= threshold WHEN op = '<=' THEN value <= threshold END, true)) AS passed,
    coalesce(list_sort(list(metric) FILTER (NOT coalesce(CASE WHEN op = '>=' THEN value >= threshold WHEN op = '<=' THEN value <= threshold END, true))), []) AS failures FROM m LEFT JOIN t USING (metric) GROUP BY suite"""
)
def suite_results(spark: SparkSession, d: str) -> DataFrame:
    """C21, D25, D26, D30, E22, P42, P44"""
    o = tables.table(spark, d, "orders")
    m = o.groupBy(F.concat(F.lit("suite"), (F.col("o_orderkey") % 5).cast("string")).alias("suite"), F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    t = m.where(~F.col("metric").like("5%")).select("suite", "metric", F.when(F.col("metric").like("1%"), "<=").otherwise(">=").alias("op"), F.lit(150000.0).alias("threshold"))
    b = m.select("suite", "metric", F.lit(149000.0).alias("baseline"))
    return evaluation.suite_passed(evaluation.suite_report(m, t, b))


@query("SELECT l_returnflag AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n, round(sum(CAST(l_quantity AS BIGINT)) / sum(sum(CAST(l_quantity AS BIGINT))) OVER ()::DOUBLE, 10) AS share FROM lineitem GROUP BY 1")
def fault_shares(spark: SparkSession, d: str) -> DataFrame:
    """D22, D31"""
    t = tables.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("q"))
    return evaluation.fault_shares(t, "kind", "q")


@query("SELECT source AS doc_type, list_sort(list_distinct(list(CAST(doc_id % 20 AS BIGINT)))) AS pages, min(0.5 + (doc_id % 6) / 10.0::DOUBLE) AS confidence, bool_or(0.5 + (doc_id % 6) / 10.0::DOUBLE < 0.85) AS uncertain FROM documents GROUP BY 1")
def provenance_sources(spark: SparkSession, d: str) -> DataFrame:
    """D12-D14, H29, P36"""
    c = tables.chunks(spark, d)
    return c.groupBy("doc_type").agg(F.array_sort(F.collect_set(F.col("chunk_id") % 20)).alias("pages"), F.min("mean_confidence").alias("confidence"), F.bool_or(F.col("mean_confidence") < 0.85).alias("uncertain"))


# --- calculations [2-J] -----------------------------------------------------------------------------------------------------
@query(
    """SELECT p_partkey, round((p_size + 10.0 - 0.5 * p_size) / (1.0 + p_partkey % 9), 9) AS rate, round(p_size * 0.1 * 500 / nullif(138.0 * 0.85 - 0.6 * p_size * 0.1, 0), 9) AS shell,
    round(CASE WHEN abs(p_size * 1.0 - (p_partkey % 40 + 1)) < 0.000001 THEN p_size * 1.0 ELSE (p_size - (p_partkey % 40 + 1)) / ln(p_size / (p_partkey % 40 + 1.0)) END, 9) AS lmtd, round(p_size * 4.186 * 12.5, 9) AS duty FROM part""".replace("0.1 ", "0.1::DOUBLE ").replace("138.0", "138.0::DOUBLE").replace("1.0 +", "1.0::DOUBLE +").replace("* 4.186 *", "* 4.186::DOUBLE *").replace("p_size / (", "p_size::DOUBLE / (").replace("0.5 *", "0.5::DOUBLE *").replace("p_size * 1.0", "p_size::DOUBLE")
)
def calculations(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's formulas over columns"""
    s, k = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    p = tables.table(spark, d, "part")
    return p.select(
        "p_partkey",
        F.round(engineering.corrosion_rate(s + 10.0, 0.5 * s, 1.0 + k % 9)["value"], 9).alias("rate"),
        F.round(engineering.minimum_thickness(s * 0.1, F.lit(500.0), F.lit(138.0), 0.85)["value"], 9).alias("shell"),
        F.round(engineering.log_mean_difference(s, k % 40 + 1)["value"], 9).alias("lmtd"),
        F.round(engineering.heat_duty(s, F.lit(4.186), F.lit(12.5))["value"], 9).alias("duty"),
    )


@query(
    "SELECT p_partkey, CASE WHEN a > 45 THEN a - 90 ELSE a END AS angle, round(p_size * 25.4::DOUBLE, 6) AS mm FROM (SELECT *, ((p_partkey * 7) % 90)::DOUBLE AS a FROM part)"
)
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    """J20, J22, 1.2: conversions, angles"""
    return tables.table(spark, d, "part").select("p_partkey", scores.fold_angle((F.col("p_partkey") * 7).cast("double")).alias("angle"), F.round(engineering.convert(F.col("p_size").cast("double"), F.lit("in"), "mm"), 6).alias("mm"))


# --- joins [2-C] --------------------------------------------------------------------------------------------------------------
@query("SELECT b.item_id, count(*) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def passages_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole passages found in whole documents"""
    probes = tables.table(spark, d, "benchmark").select(F.col("item_id").alias("probe_id"), F.col("text").alias("probe"))
    found = retrieval.passages(tables.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), probes)
    return found.groupBy(F.col("probe_id").alias("item_id")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    """SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate"""
)
def dataset_query(spark: SparkSession, d: str) -> DataFrame:
    """The table.query seam: a typed query over lifted datasets (TPC-H 3 without its limit)"""
    c, o, i = (tables.table(spark, d, n) for n in ("customer", "orders", "lineitem"))
    j = c.where("c_mktsegment = 'BUILDING'").join(o.where("o_orderdate < TIMESTAMP_NTZ '1995-03-15'"), F.col("c_custkey") == F.col("o_custkey")).join(i.where("l_shipdate > TIMESTAMP_NTZ '1995-03-15'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")).select("l_orderkey", "revenue", "o_orderdate")


@query(
    """WITH s AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'view'), r AS (SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'signup')
    SELECT s.event_id, r.event_id AS in_force FROM s ASOF LEFT JOIN r ON s.user_id = r.user_id AND s.ts >= r.ts"""
)
def readings_in_force(spark: SparkSession, d: str) -> DataFrame:
    """C-note (addition): the last reading at or before each event, by a window over both, not a range join"""
    e = tables.table(spark, d, "events").where("event_type IN ('view', 'signup')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "signup", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(w)
    return e.select("event_id", "event_type", held.alias("in_force")).where("event_type = 'view'").select("event_id", "in_force")


@query()
def answer_validation(spark: SparkSession, d: str) -> DataFrame:
    """Assistant messages as answers"""
    m = tables.messages(spark, d).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("content", F.lit(" [1]")).alias("text"))
    return answers.validate(m).select("answer_id", "refusal", "grounded_ratio", F.size("unsupported").alias("n_unsupported"), "acceptable")


# --- reports, plans, providers [2-H, 2-N, 2-P] ---------------------------------------------------------------------------
@query(
    f"""WITH {_FUSED}, t AS (SELECT h.query_id, h.rank, '<source id="' || h.chunk_id || '">' || chr(10) || '[' || h.rank || '] Doc ' || h.chunk_id || ' — page 1' ||
      CASE WHEN h.c < 0.8 THEN ' — OCR confidence ' || CAST(round(h.c * 100) AS INTEGER) || '%' ELSE '' END || chr(10) || trim(left(d.text, 200)) || chr(10) || '</source>' AS b FROM h JOIN documents d ON d.doc_id = h.chunk_id)
    SELECT query_id, '<sources>' || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY rank) || chr(10) || '</sources>' AS prompt FROM t GROUP BY query_id"""
)
def evidence_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The best passages of each query as a prompt"""
    c = tables.chunks(spark, d).select("chunk_id", F.concat(F.lit("Doc "), F.col("chunk_id").cast("string")).alias("title"), F.substring("text", 1, 200).alias("text"), "mean_confidence")
    return reports.evidence_prompt(_hybrid(spark, d).select("query_id", "chunk_id", "rank").join(c, "chunk_id"))


@query(
    """WITH s AS (SELECT source AS title, list_sort(list_distinct(list(CAST(doc_id % 3 AS BIGINT)))) AS p, min(0.5 + (doc_id % 6) / 10.0::DOUBLE) AS c FROM documents GROUP BY 1)
    SELECT title, title || CASE WHEN len(p) > 1 THEN ' — pages ' ELSE ' — page ' END || array_to_string(p, ', ') || CASE WHEN c < 0.85 THEN '  [text recognised from a scan at ' || CAST(round(c * 100) AS INTEGER) || '% confidence — verify against the original]' ELSE '' END AS line FROM s"""
)
def provenance_lines(spark: SparkSession, d: str) -> DataFrame:
    """D12, D13, H28, H29, P36, P37"""
    c = tables.chunks(spark, d).groupBy(F.col("doc_type").alias("title")).agg(F.array_sort(F.collect_set(F.col("chunk_id") % 3)).alias("p"), F.min("mean_confidence").alias("c"))
    return c.select("title", reports.source_line(F.col("title"), F.col("p"), F.col("c")).alias("line"))


@query(
    """WITH r AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, n_name) + 1 AS r FROM nation)
    SELECT n_regionkey, CAST(r AS INTEGER) AS "row", 1 AS col, 'number' AS kind, CAST(NULL AS VARCHAR) AS text, CAST(n_nationkey AS DOUBLE) AS number FROM r
    UNION ALL SELECT n_regionkey, CAST(r AS INTEGER), 2, 'text', n_name, NULL FROM r UNION ALL SELECT n_regionkey, CAST(r AS INTEGER), 3, 'formula', '=A' || r || '*2', NULL FROM r"""
)
def workbook_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cell grid of a sheet for each region"""
    return reports.cells(tables.table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), "n_regionkey", ["n_nationkey", "n_name"], {"double": "=A{row}*2"})


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(replace(n_name, ' ', '-')) || '.example:' || (8000 + n_nationkey) ELSE '10.0.0.' || n_nationkey END AS host, n_nationkey % 2 = 1 AS private,
    CAST(floor(n_nationkey * 1001 / 4) AS BIGINT) + 800 * (n_nationkey % 3) AS tokens FROM nation"""
)
def provider_hosts(spark: SparkSession, d: str) -> DataFrame:
    """B33, P5, P14"""
    n = tables.table(spark, d, "nation").withColumn("n_name", F.replace("n_name", F.lit(" "), F.lit("-")))
    url = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://user@"), "n_name", F.lit(".example:"), (8000 + F.col("n_nationkey")).cast("string"), F.lit("/v1"))).otherwise(F.concat(F.lit("10.0.0."), F.col("n_nationkey").cast("string")))
    host = planning.host_of(url)
    return n.select("n_nationkey", host.alias("host"), planning.is_private(host).alias("private"), planning.prompt_tokens(F.col("n_nationkey") * 1001, F.col("n_nationkey") % 3).alias("tokens"))
