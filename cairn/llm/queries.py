"""The registered query of each operator: production parameters over whole tables, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import ball_tree, filter_audit, hyperdimensional, licences, near_dup, packing, piece_bpe, quality, secrets, substring_dedup, suffix_tree, token_count, yinyang
from cairn.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(read(spark, sf_dir, "documents"))


def op2_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(read(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), capacity=2048, end_id=1)


def op4_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), limit=2048)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read(spark, sf_dir, "documents"))


def op6_dice_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"), threshold=0.8)


def op7_prefix_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(read(spark, sf_dir, "documents"))


def op8_lsh_forest_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.components(read(spark, sf_dir, "documents"), n=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_divergence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op10_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperdimensional.identify(read(spark, sf_dir, "documents"))


def op12_transposition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), part="source")


def op13_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.compress(read(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_tree_score, op2_ball_tree_top_k, op3_minimum_slack_packing, op4_two_tier_token_counts, op5_suffix_array_dedup, op6_dice_licence_scan, op7_prefix_table_pieces, op8_lsh_forest_near_dup, op9_divergence_quality, op10_ownership_secrets, op11_hyperdimensional_language, op12_transposition_audit, op13_yinyang_codes)}

ORACLE_SQL: dict[str, str] = {
    "op2_ball_tree_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_lsh_forest_near_dup": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 85 * (u.n + v.n - c)),
        b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.v)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id""",
    "op12_transposition_audit": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
                + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
                + 16 * CAST(coalesce(doc_id > first_id, false) AS INT) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE list_unique([a.x, b.x, c.x, d.x, e.x]) = 5),
        s AS (SELECT filter_order, k AS step, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS bit,
                coalesce(CAST(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(filter_order, CAST(i AS INT), 1)) - 65))) AS INT), 0) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
                coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
          CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
    "op13_yinyang_codes": """
        WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT r, k, v[4 * k + 1] AS a, v[4 * k + 2] AS b, v[4 * k + 3] AS c, v[4 * k + 4] AS d FROM v, (SELECT unnest(range(16)) AS k)),
        c0 AS (SELECT k, r - 1 AS e, a, b, c, d FROM p WHERE r <= 64),
        a1 AS (SELECT p.r, p.k, min((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) + (p.d - q.d) * (p.d - q.d)) AS m,
                 arg_min(q.e, ((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) + (p.d - q.d) * (p.d - q.d)) * 64 + q.e) AS e FROM p JOIN c0 q USING (k) GROUP BY p.r, p.k),
        m1 AS (SELECT k, a1.e, floor(sum(a) / count(*)) AS a, floor(sum(b) / count(*)) AS b, floor(sum(c) / count(*)) AS c, floor(sum(d) / count(*)) AS d FROM p JOIN a1 USING (r, k) GROUP BY k, a1.e),
        c1 AS (SELECT k, e, CAST(coalesce(m1.a, c0.a) AS BIGINT) AS a, CAST(coalesce(m1.b, c0.b) AS BIGINT) AS b, CAST(coalesce(m1.c, c0.c) AS BIGINT) AS c, CAST(coalesce(m1.d, c0.d) AS BIGINT) AS d FROM c0 LEFT JOIN m1 USING (k, e)),
        a2 AS (SELECT p.r, p.k, arg_min(q.e, ((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) + (p.d - q.d) * (p.d - q.d)) * 64 + q.e) AS e FROM p JOIN c1 q USING (k) GROUP BY p.r, p.k),
        m2 AS (SELECT k, a2.e, floor(sum(a) / count(*)) AS a, floor(sum(b) / count(*)) AS b, floor(sum(c) / count(*)) AS c, floor(sum(d) / count(*)) AS d FROM p JOIN a2 USING (r, k) GROUP BY k, a2.e),
        c2 AS (SELECT k, e, CAST(coalesce(m2.a, c1.a) AS BIGINT) AS a, CAST(coalesce(m2.b, c1.b) AS BIGINT) AS b, CAST(coalesce(m2.c, c1.c) AS BIGINT) AS c, CAST(coalesce(m2.d, c1.d) AS BIGINT) AS d FROM c1 LEFT JOIN m2 USING (k, e)),
        a3 AS (SELECT p.r, p.k, min((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) + (p.d - q.d) * (p.d - q.d)) AS m,
                 arg_min(q.e, ((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) + (p.d - q.d) * (p.d - q.d)) * 64 + q.e) AS e FROM p JOIN c2 q USING (k) GROUP BY p.r, p.k),
        x AS (SELECT r, CAST(sum(m) AS BIGINT) AS error, string_agg(lpad(format('{:x}', e), 2, '0'), '' ORDER BY k) AS code FROM a3 GROUP BY r),
        h AS (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY k, e)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM x JOIN v USING (r), h""",
}
