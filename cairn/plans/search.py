"""Queries of the kept indexes: text by positions, vectors by lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import postings, retrieval, vector_lists
from cairn.plans.catalogue import _CHUNKS, _SEEN, _TOKENS, ANALYST, _vector_queries
from cairn.plans.registry import query
from cairn.sources import shared, tables


def _index(spark: SparkSession, d: str, stems: bool) -> postings.Index:
    return postings.write_index(tables.chunks(spark, d), shared.folder(spark, "postings"), stems)


def _questions(spark: SparkSession, d: str, first: int | None = None) -> DataFrame:
    """The benchmark's passages, or so many of each one's first words, as questions."""
    text = F.col("text")
    if first is not None:
        text = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.lower(text), F.lit(postings.TOKEN), F.lit(0)), 1, first))
    return tables.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "chunk_id", "score", "rank")


_PLACES = f"""{_CHUNKS}, w AS (SELECT chunk_id, {_TOKENS} AS w FROM chunks WHERE {_SEEN}),
    p AS (SELECT chunk_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM w), q AS (SELECT item_id AS query_id, {_TOKENS} AS q FROM benchmark)"""
_BEST = "SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {0} QUALIFY rank <= 40"


@query(
    f"""WITH {_PLACES}, s AS (SELECT query_id, chunk_id, round(count(*) * 0.1::DOUBLE, 6) AS score FROM q JOIN p a ON a.term = q[1] JOIN p b USING (chunk_id) JOIN p c USING (chunk_id)
      WHERE len(q) >= 3 AND b.term = q[2] AND b.place = a.place + 1 AND c.term = q[3] AND c.place = a.place + 2 GROUP BY 1, 2)
    {_BEST.format('s')}"""
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """H2, L3, L4: the first three words of each question, one after the other, by a kept index of positions"""
    asked = _questions(spark, d, 3).where(F.size(F.split("text", " ")) == 3)
    return _shown(postings.search(asked, _index(spark, d, False), ANALYST, "phrase"))


@query(
    f"""WITH {_PLACES}, t AS (SELECT query_id, q[1] AS u, q[2] AS v FROM q WHERE len(q) >= 2 AND q[1] <> q[2]),
    m AS (SELECT query_id, chunk_id, place, p.term, lag(place) OVER w AS before, lag(p.term) OVER w AS term_before FROM t JOIN p ON p.term IN (u, v) WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY place)),
    s AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (place - before)), 6) AS score FROM m WHERE term <> term_before GROUP BY 1, 2)
    {_BEST.format('s')}"""
)
def both_terms_search(spark: SparkSession, d: str) -> DataFrame:
    """H2, L3, L4: the first two words of each question, wherever they stand, ranked by how near they are"""
    asked = _questions(spark, d, 2).where("split(text, ' ')[0] <> split(text, ' ')[1]")
    return _shown(postings.search(asked, _index(spark, d, False), ANALYST, "all"))


@query(
    f"""WITH {_PLACES}, one AS (SELECT query_id, chunk_id, round(count(*) * 0.1::DOUBLE, 6) AS score FROM q JOIN p a ON a.term = q[1] JOIN p b USING (chunk_id) JOIN p c USING (chunk_id)
        WHERE len(q) >= 3 AND b.term = q[2] AND b.place = a.place + 1 AND c.term = q[3] AND c.place = a.place + 2 GROUP BY 1, 2),
    open1 AS (SELECT query_id, q FROM q WHERE (SELECT count(*) FROM one WHERE one.query_id = q.query_id) < 3),
    u AS (SELECT query_id, unnest(list_distinct(q[1:3])) AS term FROM open1), a AS (SELECT query_id, chunk_id, count(*) AS tf, count(DISTINCT p.term) AS n FROM u JOIN p USING (term) GROUP BY 1, 2),
    m AS (SELECT query_id, chunk_id, place, term FROM u JOIN p USING (term)), need AS (SELECT query_id, count(*) AS need FROM u GROUP BY 1),
    l AS (SELECT m.*, list({{'t': m2.term, 'p': m2.place}}) AS near FROM m JOIN m m2 ON m2.query_id = m.query_id AND m2.chunk_id = m.chunk_id AND m2.place <= m.place GROUP BY ALL),
    z AS (SELECT query_id, chunk_id, place, list_min(list_transform(list_distinct(list_transform(near, lambda x: x.t)), lambda t: list_max(list_transform(list_filter(near, lambda x: x.t = t), lambda x: x.p)))) AS first,
            len(list_distinct(list_transform(near, lambda x: x.t))) AS n, near FROM l),
    v AS (SELECT query_id, chunk_id, first, min(place) AS place, arg_min(near, place) AS near FROM z JOIN need USING (query_id) WHERE z.n = need GROUP BY 1, 2, 3),
    two AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + place - first - (len(list_filter(near, lambda x: x.p >= first)) - 1))), 6) AS score FROM v GROUP BY 1, 2),
    after2 AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2),
    open2 AS (SELECT query_id FROM open1 WHERE (SELECT count(*) FROM after2 WHERE after2.query_id = open1.query_id) < 3),
    three AS (SELECT query_id, chunk_id, round(tf * 0.1::DOUBLE, 6) AS score FROM a JOIN open2 USING (query_id)),
    fin AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM after2 UNION ALL SELECT * FROM three) GROUP BY 1, 2)
    SELECT query_id, CAST(CASE WHEN query_id IN (SELECT query_id FROM open2) THEN 3 WHEN query_id IN (SELECT query_id FROM open1) THEN 2 ELSE 1 END AS INTEGER) AS pass_no, chunk_id, score,
      CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fin QUALIFY rank <= 8"""
)
def sufficient_search(spark: SparkSession, d: str) -> DataFrame:
    """The first three words of each question as a phrase; for questions with fewer than three passages all of them anywhere;
    for those with fewer still any of them"""
    index = _index(spark, d, False)
    passes = [lambda q, mode=mode: postings.search(q, index, ANALYST, mode, k=1000) for mode in ("phrase", "all", "any")]
    return retrieval.until_sufficient(_questions(spark, d, 3), passes, enough=3)


@query()
def stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    """Any stem of each question, the 40 best; tested against brute force"""
    return _shown(postings.search(_questions(spark, d), _index(spark, d, True), ANALYST))


@query()
def listed_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best vectors of each query under the predicate by inverted lists; recall is tested against brute force"""
    index = vector_lists.write_lists(tables.vectors(spark, d), shared.folder(spark, "lists"))
    return vector_lists.search(_vector_queries(spark, d), index, ANALYST).select("query_id", "chunk_id", "score", "rank")


@query()
def listed_vector_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of each query's 10 best by brute force the lists find"""
    vectors, queries = tables.vectors(spark, d), _vector_queries(spark, d)
    got = vector_lists.search(queries, vector_lists.write_lists(vectors, shared.folder(spark, "lists")), ANALYST)
    want = retrieval.dense(queries, vectors, ANALYST, k=10).select("query_id", "chunk_id")
    hit = want.join(got.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("of"))
