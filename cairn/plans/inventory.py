"""Queries over the smaller operators: pages, providers, runs, identity, files. Entities are stood in for by the tables, with
columns that are pure functions of the key, so that the SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import engineering, planning, reports, rules, text
from cairn.functions.access import Principal
from cairn.operators import answers, chunking, evaluation, pages, providers, records, routing
from cairn.plans.registry import query
from cairn.sources import files, tables
from cairn.streaming import runs


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.table(spark, d, name)


def _words(n: Column, word: str) -> Column:
    return F.trim(F.repeat(F.lit(f"{word} "), n.cast("int")))


# --- pages [2-A] --------------------------------------------------------------------------------------------------------
def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Line items as spans of pages: an order a document, its lines spread over two pages."""
    i, n = _t(spark, d, "lineitem"), F.col("l_linenumber")
    return i.select(F.col("l_orderkey").alias("doc_id"), (n % 2 + 1).cast("long").alias("page"), (8.0 + F.col("l_quantity") % 9).alias("size"), _words(F.col("l_quantity") % 11, "ab").alias("text"), (F.col("l_partkey") % 3 == 0).alias("bold"), ((n - 1) / 7.0).alias("y0"), (n / 7.0).alias("y1"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    i = _t(spark, d, "lineitem").where("l_returnflag = 'R'")
    return i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).cast("long").alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") * 10).alias("x1"), F.lit(-500.0).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


_SPANS = "spans AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS BIGINT) AS page, 8.0 + l_quantity % 9 AS size, trim(repeat('ab ', CAST(l_quantity % 11 AS INTEGER))) AS text, CAST(l_quantity % 11 AS BIGINT) AS n, l_partkey % 3 = 0 AS bold, (l_linenumber - 1) / 7.0::DOUBLE AS y0, l_linenumber / 7.0::DOUBLE AS y1 FROM lineitem)"
_KINDS = f"""{_SPANS}, im AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS BIGINT) AS page, least(1.0, sum(l_quantity * 10 * 500) / 480000.0::DOUBLE) AS coverage FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
 kinds AS (SELECT s.doc_id, s.page, CAST(s.words AS BIGINT) AS words, coalesce(im.coverage, 0.0) AS coverage, s.words >= 12 AND coalesce(im.coverage, 0.0) <= 0.55 AS native FROM (SELECT doc_id, page, sum(n) AS words FROM spans GROUP BY 1, 2) s LEFT JOIN im USING (doc_id, page))"""


@query(f"WITH {_KINDS} SELECT doc_id, page, words, round(coverage, 9) AS coverage, native FROM kinds")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a text layer of their own"""
    return pages.page_kinds(_spans(spark, d), _images(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {_KINDS} SELECT doc_id, count(*) AS pages, count(*) FILTER (native) AS native_pages, count(*) FILTER (NOT native) AS scanned_pages, CASE WHEN bool_and(native) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mean_confidence FROM kinds GROUP BY 1")
def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    """P45"""
    return pages.document_pages(pages.page_kinds(_spans(spark, d), _images(spark, d)))


@query(
    f"""WITH {_SPANS}, z AS (SELECT doc_id, page, round(size, 1) AS size, sum(len(text)) AS n FROM spans GROUP BY 1, 2, 3), b AS (SELECT doc_id, page, first(size ORDER BY n DESC, size) AS body FROM z GROUP BY 1, 2),
    h AS (SELECT *, size / body AS ratio, len(text) <= 160 AND regexp_matches(text, '[a-z]') AND size > body * 1.15::DOUBLE AS heading FROM spans JOIN b USING (doc_id, page))
    SELECT CASE WHEN heading THEN 'heading' WHEN y1 < 0.06 THEN 'header' WHEN y0 > 0.94 THEN 'footer' ELSE 'paragraph' END AS type, CASE WHEN heading THEN CASE WHEN ratio >= 1.6::DOUBLE THEN 1 WHEN ratio >= 1.3::DOUBLE THEN 2 ELSE 3 END END AS level, count(*) AS blocks, sum(body) AS body_sizes FROM h GROUP BY 1, 2"""
)
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Headings by the size over the page's body"""
    return pages.classified(_spans(spark, d)).groupBy("type", "level").agg(F.count(F.lit(1)).alias("blocks"), F.sum("body_size").alias("body_sizes"))


@query(
    """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS "order", round(CASE WHEN l_partkey % 4 = 0 THEN l_quantity / 50.0::DOUBLE ELSE l_quantity / 100.0::DOUBLE END, 9) AS confidence, round(least(1.0, l_quantity / 40.0::DOUBLE), 9) AS x1 FROM lineitem
    WHERE l_quantity % 11 > 0 AND NOT (l_partkey % 4 > 0 AND l_suppkey % 5 = 0)"""
)
def recognised_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two engines, one of which gives percents and -1 where it has no confidence"""
    i = _t(spark, d, "lineitem")
    one = F.lit(1.0)
    base = i.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("long").alias("line"), _words(F.col("l_quantity") % 11, "ab").alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("l_quantity").alias("x1"), one.alias("y1"), F.lit(40.0).alias("width"), one.alias("height"), "l_partkey", "l_suppkey", "l_quantity")
    first = base.where("l_partkey % 4 = 0").withColumn("confidence", F.col("l_quantity") / 50)
    other = pages.percent_confidence(base.where("l_partkey % 4 > 0").withColumn("confidence", F.when(F.col("l_suppkey") % 5 == 0, -1.0).otherwise(F.col("l_quantity"))))
    return pages.recognised(first.unionByName(other)).select("doc_id", "order", F.round("confidence", 9).alias("confidence"), F.round("box.x1", 9).alias("x1"))


@query(
    """WITH p AS (SELECT doc_id, 0.6::DOUBLE + (doc_id % 4) / 10.0::DOUBLE AS c, unnest(['One ' || doc_id] || CASE WHEN doc_id % 3 = 0 THEN ['a [illegible] mark'] ELSE [] END) AS text FROM documents)
    SELECT doc_id, text, round(least(c, 0.75::DOUBLE) * CASE WHEN contains(text, '[illegible]') THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 9) AS confidence FROM p"""
)
def transcribed_pages(spark: SparkSession, d: str) -> DataFrame:
    """A20"""
    t = _t(spark, d, "documents")
    said = F.concat(F.lit("  One "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.lit("\n\n \n\na [illegible] mark\n")).otherwise(F.lit("\n\n")))
    return t.select("doc_id", F.explode(pages.transcribed(said, 0.6 + (F.col("doc_id") % 4) / 10)).alias("p")).select("doc_id", "p.text", F.round("p.confidence", 9).alias("confidence"))


_TYPES = "['application/pdf','image/png','image/jpeg','application/vnd.openxmlformats-officedocument.spreadsheetml.sheet','application/zip','text/plain','text/csv','application/octet-stream','image/webp']"


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents' texts behind the signatures of file types, dealt by the id."""
    lead = ("255044462D312E37", "89504E470D0A1A0A", "FFD8FFE0", "504B0304" + b"..xl/workbook.xml".hex(), "504B0304" + b"plain".hex(), "", "", "0001020300", "52494646" + "00000000" + "57454250")
    names = ("a.pdf", "a.png", "a.jpg", "a.xlsx", "a.zip", "a.txt", "a.csv", "a.bin", "a.pdf")
    k = (F.col("doc_id") % 9 + 1).cast("int")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), k)
    body = F.when(F.col("doc_id") % 9 == 6, F.lit(b"a,b\n1,2\n")).otherwise(F.lit(b"Some words of text.\n"))
    return _t(spark, d, "documents").select("doc_id", pick(names).alias("name"), F.concat(F.unhex(pick(lead)), body).alias("content"))


@query(f"SELECT doc_id, list_element({_TYPES}, CAST(doc_id % 9 + 1 AS INTEGER)) AS mime, doc_id % 9 = 8 AS extension_mismatch FROM documents")
def sniffed_files(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2, A3, A4, A5: types by content; the SQL knows which signature was put in front"""
    return _blobs(spark, d).select("doc_id", files.sniff(F.col("content"), F.col("name")).alias("s")).select("doc_id", "s.mime", "s.extension_mismatch")


@query("SELECT 'f' || doc_id AS path, 1 AS page, 0 AS blocks FROM documents WHERE doc_id % 9 IN (1, 2, 8)")
def image_pages(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    b = _blobs(spark, d).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), files.sniff(F.col("content"), F.col("name"))["mime"].alias("mime"))
    return pages.image_pages(b)


@query(
    """WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, 'V-' || (1000 + l_partkey % 90) AS tag FROM lineitem), o AS (SELECT DISTINCT l_orderkey AS doc_id, 'V' || (1000 + l_partkey % 60) AS k FROM lineitem), r AS (SELECT 'V' || (1000 + n_nationkey * 2) AS k FROM nation)
    SELECT f.doc_id, tag, list_filter([CASE WHEN o.k IS NOT NULL THEN 'ocr' END, CASE WHEN r.k IS NOT NULL THEN 'registry' END], lambda x: x IS NOT NULL) AS confirmed_by FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.k = replace(tag, '-', '') LEFT JOIN r ON r.k = replace(tag, '-', '')"""
)
def confirmed_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of drawings, and who else knows them"""
    i = _t(spark, d, "lineitem")
    tag = lambda n, dash: F.concat(F.lit(f"V{dash}"), (1000 + n).cast("string"))
    found = i.select(F.col("l_orderkey").alias("doc_id"), tag(F.col("l_partkey") % 90, "-").alias("tag"))
    seen = i.select(F.col("l_orderkey").alias("doc_id"), tag(F.col("l_partkey") % 60, "").alias("tag"))
    return pages.confirmed_tags(found, seen, _t(spark, d, "nation").select(tag(F.col("n_nationkey") * 2, "-").alias("tag")))


@query("SELECT doc_id, round(CASE WHEN len(text) = 0 THEN 0.0 ELSE len(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', '', 'g')) / len(text)::DOUBLE END, 9) AS alpha, strlen(text) > 3000 AS long FROM documents")
def text_shares(spark: SparkSession, d: str) -> DataFrame:
    """D5, B26"""
    return _t(spark, d, "documents").select("doc_id", F.round(text.alpha_ratio(F.col("text")), 9).alias("alpha"), (F.octet_length("text") > 3000).alias("long"))


@query("SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words, CAST(floor(len(text) / 4) AS BIGINT) + 800 * (turn % 2) AS prompt_tokens, CAST(floor(len(text) / 4) AS BIGINT) + 800 * (turn % 2) + turn AS total FROM conversations")
def message_sizes(spark: SparkSession, d: str) -> DataFrame:
    """D6, P5, P6"""
    m = tables.messages(spark, d)
    tokens = planning.prompt_tokens(F.length("content"), F.col("turn") % 2)
    return m.select("conv_id", "turn", text.word_count(F.col("content")).alias("words"), tokens.alias("prompt_tokens"), planning.total_tokens(tokens, F.col("turn")).alias("total"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS ord_before, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_quantity / 50.0::DOUBLE, 3), round_even(l_tax, 3), l_linenumber) - 1 AS ord FROM lineitem WHERE l_returnflag <> 'A'")
def reading_orders(spark: SparkSession, d: str) -> DataFrame:
    """Blocks by their rounded place on the page, empty ones dropped"""
    i = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").alias("ord_before"), (F.col("l_quantity") / 50.0).alias("y0"), F.col("l_tax").alias("x0"), F.when(F.col("l_returnflag") == "A", " ").otherwise("x").alias("text"))
    return chunking.reading_order(i).select("doc_id", "ord_before", "ord")


@query("SELECT doc_id, CASE WHEN len(text) > 160 THEN left(text, 160) || '…' ELSE text END AS told FROM documents")
def logged_arguments(spark: SparkSession, d: str) -> DataFrame:
    """B38"""
    return _t(spark, d, "documents").select("doc_id", text.summarised(F.col("text")).alias("told"))


@query(
    """SELECT p_partkey, round((p_size + 1 - 3.0::DOUBLE) / 0.25::DOUBLE, 9) AS life, round(138.0::DOUBLE * 0.85 * p_size / (500 + 0.6::DOUBLE * p_size), 9) AS pressure,
    round(0.61::DOUBLE / sqrt(1 - pow(p_size / 60.0::DOUBLE, 4)) * pi() * 0.01::DOUBLE / 4 * sqrt(2 * 1000.0 / 998.0::DOUBLE), 9) AS flow FROM part"""
)
def more_calculations(spark: SparkSession, d: str) -> DataFrame:
    """J2, J4, J7"""
    s = F.col("p_size").cast("double")
    return _t(spark, d, "part").select(
        "p_partkey", F.round(engineering.remaining_life(s + 1, F.lit(3.0), F.lit(0.25))["value"], 9).alias("life"), F.round(engineering.working_pressure(s, F.lit(500.0), F.lit(138.0), 0.85)["value"], 9).alias("pressure"),
        F.round(engineering.orifice_flow(s / 60, F.lit(0.1), F.lit(1000.0), F.lit(998.0))["value"], 9).alias("flow"),
    )


# --- records [2-B, 2-C, 2-P] -------------------------------------------------------------------------------------------
_UPLOADS = """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'unknown classification' WHEN doc_id % 5 = 3 THEN 'above the uploader''s clearance' WHEN strlen(text) > 5000 THEN 'too large' WHEN doc_id % 7 = 6 THEN 'too many pages' END AS refused FROM documents"""


@query(_UPLOADS)
def refused_uploads(spark: SparkSession, d: str) -> DataFrame:
    """B13, B26"""
    ladder = F.element_at(F.array(*map(F.lit, ("public", "internal", "confidential", "restricted", "secret"))), (F.col("doc_id") % 5 + 1).cast("int"))
    t = _t(spark, d, "documents").select("doc_id", ladder.alias("classification"), F.octet_length("text").alias("bytes"), F.when(F.col("doc_id") % 7 == 6, 900).otherwise(3).alias("pages"))
    return records.uploads(t, "confidential", 5000, 500).select("doc_id", "refused")


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS artifact_id FROM orders WHERE CASE o_orderkey % 4 WHEN 0 THEN true WHEN 3 THEN false ELSE o_custkey % 10 = 3 END
    UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 4 < 4"""
)
def visible_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """What a creator sees, and (negative ids) what an approver sees"""
    status = F.element_at(F.array(*map(F.lit, ("approved", "draft", "pending", "rejected"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), status.alias("status"), (F.col("o_custkey") % 10).cast("string").alias("created_by"))
    return records.visible_artifacts(a, "3", False).select("artifact_id").union(records.visible_artifacts(a, "3", True).select(-F.col("artifact_id")))


@query("SELECT o_orderkey AS conv_id FROM orders WHERE o_custkey % 10 = 3 AND o_orderkey % 4 <> 1")
def own_conversations(spark: SparkSession, d: str) -> DataFrame:
    """B15, B9"""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("conv_id"), (F.col("o_custkey") % 10).alias("owner_id"), (F.col("o_orderkey") % 4 == 1).alias("archived"))
    return records.owned(o, F.lit(3)).select("conv_id")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_returnflag AS type FROM lineitem WHERE l_orderkey % 10 = 1 AND l_linenumber <= 3 AND l_returnflag IN ('A', 'R') QUALIFY row_number() OVER (ORDER BY l_orderkey, l_linenumber) BETWEEN 6 AND 25")
def blocks_of_type(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of some types, in order, a page of them; lines that share a number go by type, so that a page's edge
    falls between the same rows however they are stored"""
    i = _t(spark, d, "lineitem").where("l_orderkey % 10 = 1 AND l_linenumber <= 3").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("type"))
    return records.page(i.where(F.col("type").isin("A", "R")), [F.col("doc_id"), F.col("ord"), F.col("type")], 20, 5)


@query("SELECT o_orderkey AS call_id, o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 OR o_custkey % 7 = 0 OR o_custkey % 11 = 0 AS needs_approval FROM orders")
def approvals_needed(spark: SparkSession, d: str) -> DataFrame:
    """By tool, configuration, source and kind"""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), (F.col("o_orderkey") % 3).alias("tool"), (F.col("o_custkey") % 7 == 0).alias("touched_restricted"), (F.col("o_custkey") % 11 == 0).alias("engineering"))
    tools = spark.createDataFrame([(0, True, None), (1, False, True)], "tool bigint, requires boolean, configured boolean")
    return records.needs_approval(o, tools)


@query(
    """SELECT c.conv_id, c.turn, CASE WHEN r.user_id IS NULL THEN NULL WHEN r.errors > 0 THEN 'failed' ELSE 'done' END AS status, coalesce(a.n, 0) AS n_artifacts FROM conversations c
    LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) r ON r.user_id = c.conv_id LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) a ON a.user_id = c.conv_id"""
)
def hydrated_messages(spark: SparkSession, d: str) -> DataFrame:
    """C10"""
    e = _t(spark, d, "events").withColumnRenamed("user_id", "run_id")
    status = e.groupBy("run_id").agg(F.when(F.count_if(F.col("event_type") == "error") > 0, "failed").otherwise("done").alias("status"))
    m = tables.messages(spark, d).withColumn("run_id", F.col("conv_id"))
    return records.hydrated(m, status, e.where("event_type = 'purchase'")).select("conv_id", "turn", "status", "n_artifacts")


@query("SELECT l.doc_id AS case_id, coalesce(b.text, '') AS prompt, left(d.text, 600) AS actual, 'e' || l.doc_id AS evidence, 'suite:' || l.doc_id AS source FROM labels l JOIN documents d USING (doc_id) LEFT JOIN benchmark b ON b.item_id = l.doc_id WHERE l.quality = 0")
def failed_cases(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as cases, benchmark items as the gold set"""
    c = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed"), F.col("text").alias("actual"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence"))
    return records.failed_cases(c, _t(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("query")), "suite")


@query("SELECT d.doc_id, d.lang, len(d.text) AS chars FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0")
def truth_of_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Truth pages joined to the manifest's documents"""
    return _t(spark, d, "documents").join(_t(spark, d, "labels").where("toxic = 0"), "doc_id").select("doc_id", "lang", F.length("text").cast("long").alias("chars"))


@query("SELECT o_orderkey AS doc_id, count(l_orderkey) AS n_chunks FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1")
def document_detail(spark: SparkSession, d: str) -> DataFrame:
    """P19"""
    chunks = _t(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "doc_id")
    return records.document_detail(_t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), chunks)


@query("SELECT url AS image FROM pages WHERE page_id = 7")
def page_image(spark: SparkSession, d: str) -> DataFrame:
    """P20: one page's image by its key"""
    return records.filtered(_t(spark, d, "pages"), page_id=7).select(F.col("url").alias("image"))


@query(
    """WITH c AS (SELECT user_id AS conv_id, arg_max('t' || event_id, event_id) FILTER (event_type = 'view') AS t, arg_max(event_id % 2 = 0, event_id) FILTER (event_type = 'error') AS a FROM events GROUP BY 1)
    SELECT c_custkey AS conv_id, coalesce(t, c_name) AS title, coalesce(a, false) AS archived FROM customer LEFT JOIN c ON conv_id = c_custkey"""
)
def changed_conversations(spark: SparkSession, d: str) -> DataFrame:
    """P18"""
    base = _t(spark, d, "customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("title"), F.lit(False).alias("archived"))
    e = _t(spark, d, "events").where("event_type IN ('view', 'error')")
    changes = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("title"), F.when(F.col("event_type") == "error", F.col("event_id") % 2 == 0).alias("archived"))
    return records.changed(base, changes)


@query(
    """WITH n AS (SELECT conv_id, max(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * turn) AS newest, count(*) AS added, arg_min(left(text, 60), turn) FILTER (role = 'user') AS first FROM conversations GROUP BY 1)
    SELECT c_custkey AS conv_id, CASE WHEN c_custkey % 2 = 0 THEN first ELSE c_name END AS title, greatest(TIMESTAMP '2024-01-01 00:02:00', newest) AS updated_at, coalesce(added, 0) AS added FROM customer LEFT JOIN n ON conv_id = c_custkey"""
)
def touched_conversations(spark: SparkSession, d: str) -> DataFrame:
    """P17"""
    at = lambda n: (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=n)).cast("timestamp_ntz")
    base = _t(spark, d, "customer").select(F.col("c_custkey").alias("conv_id"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")).alias("title"), at(F.lit(2)).alias("updated_at"))
    return records.appended(base, tables.messages(spark, d).withColumn("at", at(F.col("turn").cast("int"))))


@query("SELECT o_orderkey AS artifact_id, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' WHEN o_orderkey % 3 = 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN o_orderkey % 3 < 2 THEN 'u' || o_custkey END AS decided_by FROM orders")
def decided_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """P21"""
    o = _t(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("artifact_id"), F.lit("pending").alias("status"), F.create_map(F.lit("sources"), F.lit("2")).alias("provenance"))
    status = F.element_at(F.array(*map(F.lit, ("approved", "rejected", "pending"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    p = o.select(F.col("o_orderkey").alias("artifact_id"), status.alias("status"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("decided_by"))
    return records.after_decision(a, p).select("artifact_id", "status", F.try_element_at("provenance", F.lit("decided_by")).alias("decided_by"))


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderdate > TIMESTAMP '1996-06-01'")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """I1, I5"""
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderkey") % 5 == 0).alias("revoked"), F.col("o_orderdate").alias("expires_at"))
    return records.live_sessions(s, F.lit("1996-06-01").cast("timestamp_ntz")).select("session_id")


@query("WITH s AS (SELECT o_orderkey, o_custkey, o_orderkey % 9 = 0 AS r FROM orders), u AS (SELECT DISTINCT o_custkey FROM s WHERE r AND (o_orderkey % 27 = 0 OR o_orderkey % 10 = 1)) SELECT o_orderkey AS token_hash, r OR u.o_custkey IS NOT NULL AS revoked FROM s LEFT JOIN u USING (o_custkey)")
def revoked_sessions(spark: SparkSession, d: str) -> DataFrame:
    """A revoked token that comes back ends all of its user's sessions"""
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("token_hash"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 9 == 0).alias("revoked"))
    return records.revoke_sessions(s, s.where("token_hash % 27 = 0 OR token_hash % 10 = 1")).select("token_hash", "revoked")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 6 = 0 THEN TIMESTAMP '2024-05-01' END AS deleted_at, count(l_orderkey) AS chunks FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_orderkey % 6 <> 0) ON l_orderkey = o_orderkey GROUP BY 1")
def deleted_documents(spark: SparkSession, d: str) -> DataFrame:
    """G13"""
    docs, chunks = _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))
    kept, left = records.soft_delete(docs, chunks, docs.where("doc_id % 6 = 0"), "2024-05-01")
    return records.document_detail(kept, left).withColumnRenamed("n_chunks", "chunks")


@query("SELECT user_id AS key, max(event_id) AS id, arg_max(event_type, event_id) AS name FROM events GROUP BY 1")
def newest_rows(spark: SparkSession, d: str) -> DataFrame:
    """E9"""
    e = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    return records.newest(e, ["key"], ["id"], ["id", "name"])


@query("SELECT n_nationkey, list_sort(list_intersect(CASE n_nationkey % 3 WHEN 0 THEN ['ops','safety'] WHEN 1 THEN ['finance'] ELSE [] END, ['ops','finance'])) AS shared, 'classification in public, internal, confidential; departments ops, safety or unrestricted' AS filter FROM nation")
def shared_departments(spark: SparkSession, d: str) -> DataFrame:
    """G6, B7"""
    n = F.col("n_nationkey") % 3
    own = F.when(n == 0, F.array(F.lit("ops"), F.lit("safety"))).when(n == 1, F.array(F.lit("finance"))).otherwise(F.array().cast("array<string>"))
    who = Principal("u1", "confidential", frozenset({"ops", "safety"}))
    return _t(spark, d, "nation").select("n_nationkey", F.array_sort(F.array_intersect(own, F.array(F.lit("ops"), F.lit("finance")))).alias("shared"), F.lit(who.describe()).alias("filter"))


# --- answers [2-C, 2-D, 2-E, 2-H] -----------------------------------------------------------------------------------------
@query(
    """SELECT conv_id * 1000 + turn AS answer_id, CASE WHEN turn % 2 = 0 THEN 'B [1] then A [2] and [1].' ELSE 'A [1] alone.' END AS text, CASE WHEN turn % 2 = 0 THEN ['b' || conv_id, 'a' || conv_id] ELSE ['a' || conv_id] END AS cited,
    CASE WHEN turn % 2 = 0 THEN [] ELSE ['zz', '[7]'] END AS unresolved FROM conversations"""
)
def resolved_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers by id and by place; the SQL knows what was cited"""
    c = F.col("conv_id").cast("string")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("B [[cite:B"), c, F.lit("]] then A [1] and (cite: b"), c, F.lit(")."))).otherwise(F.concat(F.lit("A [[cite:a"), c, F.lit(", zz]] alone [7].")))
    m = tables.messages(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), said.alias("text"), F.array(F.concat(F.lit("a"), c), F.concat(F.lit("b"), c)).alias("evidence"))
    return answers.resolve_markers(m)


@query(
    """SELECT p_partkey AS answer_id, x.value, x.found, CASE WHEN x.found THEN [1] ELSE [] END AS sources FROM part, unnest([{'value': CAST(p_size AS VARCHAR), 'found': p_partkey % 2 = 0}, {'value': '1200', 'found': true}, {'value': '0.5', 'found': false}]) AS t(x)"""
)
def verified_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of answers, and the sources that hold them"""
    p, k = _t(spark, d, "part"), F.col("p_size").cast("string")
    a = p.select(F.col("p_partkey").alias("answer_id"), F.concat(F.lit("It is "), k, F.lit(" mm [1], of 1,200 kg and 0.50.")).alias("text"))
    s = p.select(F.col("p_partkey").alias("answer_id"), F.lit(1).alias("n"), F.concat(F.lit("Weight 1200; "), F.when(F.col("p_partkey") % 2 == 0, k).otherwise(F.lit("none"))).alias("text"))
    return answers.verify_figures(a, s).select("answer_id", "value", "found", "sources")


@query("SELECT p_partkey AS answer_id, 'rate' AS name, 1.5 * p_size::DOUBLE AS value FROM part WHERE p_partkey % 3 > 0")
def overridden_results(spark: SparkSession, d: str) -> DataFrame:
    """Calculated values that an answer does not repeat within two per cent"""
    p = _t(spark, d, "part")
    near = F.format_string("%.2f", F.col("p_size") * F.lit(1.5) * F.when(F.col("p_partkey") % 3 == 0, 1.01).otherwise(1.1))
    a = p.select(F.col("p_partkey").alias("answer_id"), F.concat(F.lit("The rate is "), near, F.lit(" mm.")).alias("text"))
    return answers.overridden(a, p.select(F.col("p_partkey").alias("answer_id"), F.lit("rate").alias("name"), (F.col("p_size") * 1.5).alias("value")))


@query("SELECT DISTINCT c_custkey AS answer_id, v AS value, first_value('step' || pos) OVER (PARTITION BY c_custkey, v ORDER BY pos) AS name FROM customer, unnest([{'pos': 1, 'v': CAST(c_nationkey AS VARCHAR)}, {'pos': 2, 'v': '7'}, {'pos': 3, 'v': CAST(c_nationkey AS VARCHAR)}]) AS t(x), unnest([x.v]) AS u(v), unnest([x.pos]) AS w(pos)")
def calculated_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the tools' results, by the first calculation that gave them"""
    c = _t(spark, d, "customer")
    k = F.col("c_nationkey").cast("string")
    said = F.array(F.concat(F.lit("rate "), k, F.lit(".0")), F.lit("total 7"), F.concat(F.lit("again "), k))
    r = c.select(F.col("c_custkey").alias("answer_id"), F.posexplode(said).alias("p", "output")).select("answer_id", (F.col("p") + 1).alias("pos"), F.concat(F.lit("step"), (F.col("p") + 1).cast("string")).alias("name"), "output")
    return answers.calculated(r)


@query("SELECT conv_id, turn, 'n' || turn || '  text' AS clean, CASE WHEN turn % 2 = 0 THEN '[A > B]' || chr(10) || 'x' ELSE 'x' END AS context, CASE WHEN turn % 3 = 0 THEN 'Sources (as stated in the answer)' ELSE 'Findings' END AS heading, [1, 12] AS ordinals, ['V-1201', 'P-101A'] AS tags FROM conversations")
def tidied_texts(spark: SparkSession, d: str) -> DataFrame:
    """H4, H17, H24, H19"""
    m, n = tables.messages(spark, d), F.col("turn")
    section = F.when(n % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array().cast("array<string>"))
    return m.select(
        "conv_id", "turn", text.strip_markers(F.concat(F.lit("n"), n.cast("string"), F.lit(" [[cite:a]] text [cite: b, c]"))).alias("clean"), text.contextualised(section, F.lit("x")).alias("context"),
        text.safe_heading(F.when(n % 3 == 0, "Sources:").otherwise("Findings")).alias("heading"), text.ordinals(F.lit("as [1] and [[12]] but not [123]")).alias("ordinals"), text.equipment_tags(F.lit("V-1201, P-101A and V-1201 but not V-12")).alias("tags"),
    )


@query(
    """SELECT p_partkey, CAST(CAST(p_size AS VARCHAR) || ' mm/year' AS VARCHAR) AS quantity, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS half,
    abs(p_size - 30) > 0 AS contradicted, CASE WHEN abs(2 - 2.0) > 0.5 THEN 'x' WHEN p_size > 40 THEN 'the interval disagrees with the years given' END AS reason FROM part"""
)
def engineer_quantities(spark: SparkSession, d: str) -> DataFrame:
    """H21, H31, I9, J10, J1"""
    s = F.col("p_size")
    rate = engineering.corrosion_rate(F.lit(10.0), F.lit(8.0), F.when(s > 40, 5.0).otherwise(2.0), F.lit(2020.0), F.lit(2022.0))
    return _t(spark, d, "part").select(
        "p_partkey", engineering.tidy_quantity(F.concat((s * 2).cast("string"), F.lit(".00 mm per 2 year"))).alias("quantity"), text.quantity_text(s / F.lit(2.0)).alias("half"),
        engineering.contradicted(engineering.readings_beside(F.array(F.lit("2022 inlet 30.0 mm"), F.lit("2021 inlet 12.0 mm")), F.lit("2022")), s.cast("double")).alias("contradicted"), rate["reason"].alias("reason"),
    )


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS ok, p_partkey % 4 = 2 AS refused, CASE p_partkey % 4 WHEN 0 THEN round(p_size / 5.0::DOUBLE, 9) WHEN 3 THEN round(p_size * 4.186::DOUBLE * 10, 9) END AS value,
    CASE p_partkey % 4 WHEN 0 THEN 'mm/year' WHEN 1 THEN 'mm/year' WHEN 2 THEN 'mm' ELSE 'kW' END AS unit FROM part"""
)
def dispatched_calculations(spark: SparkSession, d: str) -> DataFrame:
    """Calculations by name with inputs as people write them: aliases, units, what is missing, what is refused"""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    name = F.element_at(F.array(*map(F.lit, ("corrosion_rate", "corrosion_rate", "minimum_thickness", "heat_duty"))), (k + 1).cast("int"))
    whole = F.create_map(F.lit("initial"), F.concat((F.col("p_size") + 10).cast("string"), F.lit(" mm")), F.lit("Current"), F.lit("1 cm"), F.lit("years"), F.lit("5 year(s)"), F.lit("colour"), F.lit("red"))
    short = F.create_map(F.lit("initial"), F.concat(s, F.lit(" mm")))
    high = F.create_map(F.lit("pressure"), F.lit("900 MPa"), F.lit("radius"), F.lit("1 m"), F.lit("stress"), F.lit("100 MPa"))
    heat = F.create_map(F.lit("mass_flow"), F.concat(s, F.lit(" kg/s")), F.lit("specific_heat"), F.lit("4.186 kJ/kg/K"), F.lit("difference"), F.lit("10 K"))
    raw = F.when(k == 0, whole).when(k == 1, short).when(k == 2, high).otherwise(heat)
    # a small file is one task or two; the work is in the rows
    r = _t(spark, d, "part").repartition("p_partkey").select("p_partkey", engineering.dispatch(name, raw).alias("r"))
    return r.select("p_partkey", "r.ok", "r.refused", F.round("r.value", 9).alias("value"), "r.unit")


@query("SELECT n_nationkey, 'mass_flow (kg/s), heat (kJ)' AS parameters, CASE WHEN n_nationkey % 2 = 0 THEN 'timeout' ELSE 'other' END AS kind, n_nationkey % 2 = 0 AS retry, CASE WHEN n_nationkey % 2 = 0 THEN 'The request took too long and was stopped.' ELSE 'The run failed.' END AS message, greatest(0.0::DOUBLE, 10.0 - n_nationkey) AS remaining_s, CASE WHEN n_nationkey % 3 = 0 THEN 'ok' WHEN n_nationkey % 3 = 1 THEN 'refused' ELSE 'failed' END AS outcome FROM nation")
def failures_told(spark: SparkSession, d: str) -> DataFrame:
    """H32, P7, P30, P33, P34"""
    n = F.col("n_nationkey")
    kind = F.when(n % 2 == 0, "timeout").otherwise("other")
    return _t(spark, d, "nation").select(
        "n_nationkey", reports.parameter_text(F.array(F.lit("mass_flow"), F.lit("heat")), F.array(F.lit("kg/s"), F.lit("kJ"))).alias("parameters"), kind.alias("kind"), rules.retryable(kind).alias("retry"), rules.failure_message(kind).alias("message"),
        planning.remaining_seconds(F.lit(10.0), n.cast("double")).alias("remaining_s"), planning.outcome(n % 3 == 0, n % 3 == 1).alias("outcome"),
    )


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'set' ELSE 'fallback' END AS setting, 'plain' AS plain, n_nationkey % 3 = 0 AND n_nationkey >= 12 AS stale, CASE WHEN n_nationkey % 2 = 0 THEN 1706745600 END AS expiry, left(repeat('ab', 2000), 2000) AS payload FROM nation")
def settings_expanded(spark: SparkSession, d: str) -> DataFrame:
    """A28, K10, K14, P8, P10"""
    n = F.col("n_nationkey")
    env = F.create_map(F.lit("MODE"), F.when(n % 2 == 0, "set").otherwise(""))
    return _t(spark, d, "nation").select(
        "n_nationkey", planning.expanded(F.lit("${MODE:-fallback}"), env).alias("setting"), planning.expanded(F.lit("plain"), env).alias("plain"), planning.stale(F.when(n % 3 == 0, 1).otherwise(0), n * 5.0).alias("stale"),
        planning.expiry_seconds(F.when(n % 2 == 0, "2024-02-01 00:00:00").otherwise("soon")).alias("expiry"), planning.compact(F.repeat(F.lit("ab"), 2000)).alias("payload"),
    )


# --- providers and models [2-N, 2-P] -----------------------------------------------------------------------------------
def _models(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(k.alias("model"), F.concat(F.lit("m"), (k % 50).cast("string")).alias("physical"), (k % 4).alias("provider"), (F.col("p_size") % 3).cast("long").alias("lane"), k.alias("pos"), (k % 13 == 0).alias("open"), (k % 10 == 0).alias("pinned"))


_MODELS = "m AS (SELECT p_partkey AS model, 'm' || (p_partkey % 50) AS physical, p_partkey % 4 AS provider, CAST(p_size % 3 AS BIGINT) AS lane, p_partkey AS pos, p_partkey % 13 = 0 AS open, p_partkey % 10 = 0 AS pinned FROM part)"


@query(f"WITH {_MODELS} SELECT model, (provider, physical) IN (SELECT s_suppkey % 4, 'm' || (s_suppkey % 50) FROM supplier) AS available FROM m")
def model_availability(spark: SparkSession, d: str) -> DataFrame:
    """C23"""
    k = F.col("s_suppkey")
    served = _t(spark, d, "supplier").select((k % 4).alias("provider"), F.concat(F.lit("M"), (k % 50).cast("string"), F.when(k % 2 == 0, ":latest").otherwise("")).alias("name"))
    return providers.availability(_models(spark, d), served)


@query(f"WITH {_MODELS} SELECT f.model AS failed, arg_min(o.model, o.pos) AS stand_in FROM m f LEFT JOIN m o ON o.lane = f.lane AND o.provider <> f.provider AND NOT o.open WHERE f.model % 20 = 7 GROUP BY 1")
def stand_in_models(spark: SparkSession, d: str) -> DataFrame:
    """C25"""
    m = _models(spark, d)
    return providers.stand_ins(m.where("model % 20 = 7").select("model"), m)


@query(f"WITH {_MODELS} SELECT model, provider FROM m WHERE provider IN (SELECT provider FROM m WHERE model = 6)")
def unreachable_models(spark: SparkSession, d: str) -> DataFrame:
    """C26"""
    m = _models(spark, d)
    return providers.sharing_provider(m.where("model = 6").select("model"), m)


@query(
    f"""WITH {_MODELS}, r AS (SELECT s_suppkey AS request_id, CAST(s_suppkey % 3 AS BIGINT) AS lane, 0.5 + (s_suppkey % 5) / 10.0::DOUBLE AS confidence FROM supplier),
    l AS (SELECT lane, list(model ORDER BY pos) AS ladder FROM m WHERE NOT open GROUP BY 1) SELECT request_id, ladder[2] AS model, round(confidence * 0.8::DOUBLE, 10) AS confidence FROM r JOIN l USING (lane) WHERE len(ladder) > 1"""
)
def fallback_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The first of each lane has failed"""
    m = _models(spark, d)
    first = m.where("NOT open").groupBy("lane").agg(F.min_by("model", "pos").alias("first"))
    k = F.col("s_suppkey")
    r = _t(spark, d, "supplier").select(k.alias("request_id"), (k % 3).alias("lane"), (0.5 + (k % 5) / 10.0).alias("confidence")).join(first, "lane").withColumn("attempted", F.array("first"))
    return providers.fallback(r, m)


@query(f"WITH {_MODELS}, n AS (SELECT *, row_number() OVER (PARTITION BY provider, physical ORDER BY pos) AS r FROM m) SELECT provider, physical, pos FROM n WHERE r = 1")
def unique_models(spark: SparkSession, d: str) -> DataFrame:
    """G10"""
    return providers.unique_pairs(_models(spark, d))


@query(f"WITH {_MODELS} SELECT model FROM m WHERE pinned UNION SELECT model FROM m WHERE model IN (SELECT s_suppkey * 3 FROM supplier)")
def pinned_models(spark: SparkSession, d: str) -> DataFrame:
    """P9"""
    return providers.pinned(_models(spark, d), _t(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("model")))


@query("SELECT sha256('[' || string_agg('{\"kind\":\"' || coalesce(nullif(n_name, 'FRANCE'), 'none') || '\",\"model\":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']') AS digest FROM nation")
def manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    """Entries with their defaults, as one digest"""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("model"), F.when(F.col("n_name") != "FRANCE", F.col("n_name")).alias("kind"))
    return providers.manifest_digest(providers.with_defaults(n, {"kind": "none"}), "model", "model", "kind")


_HEALTH = "h AS (SELECT user_id % 6 AS provider, arg_max(event_type <> 'error', event_id) AS healthy, arg_max(value, event_id) AS latency_ms FROM events GROUP BY 1)"


def _health(spark: SparkSession, d: str) -> DataFrame:
    return providers.health(_t(spark, d, "events").select((F.col("user_id") % 6).alias("provider"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("healthy"), F.col("value").alias("latency_ms"), F.lit(1).alias("models")))


@query(f"WITH {_HEALTH} SELECT provider, healthy, latency_ms FROM h")
def provider_health(spark: SparkSession, d: str) -> DataFrame:
    """P11"""
    return _health(spark, d).drop("models")


@query(f"WITH {_HEALTH} SELECT bool_or(healthy) AS any_healthy, bool_and(healthy OR provider % 2 = 1) AS required_healthy, count(*) FILTER (NOT healthy) AS unhealthy FROM h")
def health_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """D33"""
    return providers.roll_up(_health(spark, d).withColumn("required", F.col("provider") % 2 == 0))


@query("SELECT conv_id, turn, sha256(role || (turn % 5)) AS prompt_hash, upper(role || (turn % 5)) AS decision FROM conversations")
def cached_decisions(spark: SparkSession, d: str) -> DataFrame:
    """A costly step once for each different prompt"""
    m = tables.messages(spark, d).withColumn("text", F.concat("role", (F.col("turn") % 5).cast("string")))
    return providers.distinct_prompts(m, F.upper("text")).select("conv_id", "turn", "prompt_hash", "decision")


@query(
    """WITH u AS (SELECT user_id AS host, event_id AS seq, event_type AS model, max(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)
    SELECT host, seq, coalesce(last IS NOT NULL AND (SELECT count(DISTINCT v.model) FROM u v WHERE v.host = u.host AND v.seq > u.last AND v.seq < u.seq) < 3, false) AS hit FROM u"""
)
def loaded_models(spark: SparkSession, d: str) -> DataFrame:
    """Three models stay loaded, the least recently used goes"""
    return providers.residency(_t(spark, d, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.col("event_type").alias("model")), 3).select("host", "seq", "hit")


@query(
    f"""WITH {_MODELS}, k AS (SELECT DISTINCT provider, physical FROM m WHERE pinned), r AS (SELECT DISTINCT provider, physical FROM m WHERE lane = 1)
    SELECT provider, physical, CASE WHEN k.physical IS NULL THEN 'adopt' ELSE 'forget' END AS change FROM k FULL JOIN r USING (provider, physical) WHERE k.physical IS NULL OR r.physical IS NULL"""
)
def model_drift(spark: SparkSession, d: str) -> DataFrame:
    """What is held to be loaded, and what providers report"""
    m = _models(spark, d)
    return routing.drift(m.withColumn("resident", F.col("pinned")), m.where("lane = 1"))


# --- runs [2-M] -----------------------------------------------------------------------------------------------------------
def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("data"), "value")


@query("SELECT user_id AS run_id, count(*) AS n FROM events e WHERE event_id <= coalesce((SELECT min(event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'purchase'), event_id) GROUP BY 1")
def closed_runs(spark: SparkSession, d: str) -> DataFrame:
    """M4"""
    return runs.until_closed(_events(spark, d), "purchase").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT user_id AS run_id, left(string_agg(props, '' ORDER BY event_id), 50) AS data, max(event_id) AS s FROM events WHERE event_type = 'click' GROUP BY 1), l AS (SELECT user_id AS run_id, max(event_id) AS last FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1)
    SELECT user_id AS run_id, event_id AS seq, event_type AS name, props AS data FROM events WHERE event_type NOT IN ('view', 'click') UNION ALL SELECT run_id, greatest(s, coalesce(last, 0)) + 1, 'click', data FROM r LEFT JOIN l USING (run_id)"""
)
def stored_traces(spark: SparkSession, d: str) -> DataFrame:
    """M7: views as tokens, clicks as reasoning"""
    return runs.stored_trace(_events(spark, d), "view", "click", 50)


_STAGES = "s AS (SELECT * FROM (VALUES ('view', 1, 2.0), ('click', 2, 3.0), ('signup', 3, 1.0), ('purchase', 4, 10.0), ('error', 5, 4.0)) t(stage, pos, weight))"


@query(f"WITH {_STAGES}, p AS (SELECT stage, weight, coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT user_id AS job_id, event_id AS seq, round(CAST(before AS DOUBLE) / 20 + CAST(weight AS DOUBLE) / 20 * least(1.0, value / 50.0::DOUBLE), 9) AS fraction FROM events JOIN p ON stage = event_type")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Stages with weights, and how far within one"""
    stages = spark.createDataFrame([("view", 1, 2.0), ("click", 2, 3.0), ("signup", 3, 1.0), ("purchase", 4, 10.0), ("error", 5, 4.0)], "stage string, pos int, weight double")
    r = _events(spark, d).select(F.col("run_id").alias("job_id"), "seq", F.col("name").alias("stage"), (F.col("value") / 50.0).alias("within"))
    return runs.progress(r, stages).withColumn("fraction", F.round("fraction", 9))


@query("SELECT user_id AS job_id, event_type AS stage, max(event_id) - min(event_id) AS ms FROM events GROUP BY 1, 2")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    """L10"""
    return runs.stage_timings(_events(spark, d).select(F.col("run_id").alias("job_id"), F.col("name").alias("stage"), F.col("seq").alias("at_ms")))


@query(
    """WITH a AS (SELECT l_orderkey AS step_id, l_linenumber AS attempt, l_returnflag = 'N' AS ok FROM lineitem WHERE l_linenumber <= 2)
    SELECT step_id, CASE WHEN bool_or(ok) THEN min(attempt) FILTER (ok) ELSE max(attempt) END AS attempt, bool_or(ok) AS ok FROM a GROUP BY 1"""
)
def step_attempts(spark: SparkSession, d: str) -> DataFrame:
    """M20"""
    a = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("step_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") == "N").alias("ok"), F.lit("").alias("detail"))
    return runs.last_attempts(a).select("step_id", "attempt", "ok")


@query(
    """WITH e AS (SELECT user_id AS run_id, event_id AS seq, event_type, 'k' || (event_id % 4) AS key FROM events), s AS (SELECT run_id, key, arg_max(CAST(seq AS VARCHAR), seq) AS v FROM e WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT e.run_id, coalesce(string_agg(CAST(seq AS VARCHAR) || ' ', '' ORDER BY seq) FILTER (event_type = 'view'), '') AS text, coalesce(list_sort(list_distinct(list(key) FILTER (event_type NOT IN ('view', 'click')))), []) AS things,
    coalesce((SELECT list_sort(list(key || '=' || v)) FROM s WHERE s.run_id = e.run_id), []) AS steps FROM e GROUP BY 1"""
)
def view_states(spark: SparkSession, d: str) -> DataFrame:
    """Views append tokens, clicks mark steps, the rest is added once"""
    e = _events(spark, d)
    kind = F.when(F.col("name") == "view", "token").when(F.col("name") == "click", "step").otherwise("add")
    s = F.col("seq").cast("string")
    return runs.view_state(e.select("run_id", "seq", kind.alias("kind"), F.concat(F.lit("k"), (F.col("seq") % 4).cast("string")).alias("key"), F.when(F.col("name") == "view", F.concat(s, F.lit(" "))).otherwise(s).alias("value")))


@query("SELECT user_id AS run_id, event_id AS seq, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of what a bounded queue still holds"""
    return runs.frames(runs.drop_oldest(_events(spark, d), 20))


@query("""SELECT event_id // 4 AS run_id, 0 AS "index", 'tool' || (event_id // 4) AS name, string_agg('part' || event_id, '' ORDER BY event_id) AS arguments FROM events GROUP BY event_id // 4, 3 HAVING bool_or(event_id % 4 = 1)""")
def merged_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls from fragments; only one fragment of each has the name"""
    e, k = _t(spark, d, "events"), F.col("event_id")
    run = (k / 4).cast("long")
    f = e.select(run.alias("run_id"), F.lit(0).alias("index"), k.alias("seq"), F.when(k % 4 == 1, F.concat(F.lit("tool"), run.cast("string"))).otherwise("").alias("name"), F.concat(F.lit("part"), k.cast("string")).alias("arguments"))
    return runs.merged_fragments(f).select("run_id", "index", "name", "arguments")


@query("SELECT event_id, event_type AS name FROM events")
def claimed_once(spark: SparkSession, d: str) -> DataFrame:
    """Events delivered twice are acted on once"""
    e = _t(spark, d, "events").select("event_id", F.col("event_type").alias("name"), "ts")
    return runs.once(e.union(e)).select("event_id", "name")


# --- ids, digests, evaluation [2-I, 2-K, 2-P] ----------------------------------------------------------------------------
@query(
    """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('cairn/chunk/' || doc_id)) AS h FROM documents)
    SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE h[17] WHEN '0' THEN '8' WHEN '4' THEN '8' WHEN '8' THEN '8' WHEN 'c' THEN '8' WHEN '1' THEN '9' WHEN '5' THEN '9' WHEN '9' THEN '9' WHEN 'd' THEN '9' WHEN '2' THEN 'a' WHEN '6' THEN 'a' WHEN 'a' THEN 'a' WHEN 'e' THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS point_id FROM h"""
)
def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """K5"""
    return _t(spark, d, "documents").select("doc_id", text.name_uuid("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("cairn/chunk/"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("SELECT event_id, 'run_' || lpad(format('{:x}', epoch_us(ts) // 1000), 12, '0') || left(sha256(props), 16) AS id FROM events")
def sortable_ids(spark: SparkSession, d: str) -> DataFrame:
    """I10"""
    return _t(spark, d, "events").select("event_id", text.sortable_id(F.col("ts").cast("timestamp"), F.col("props"), "run_").alias("id"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2029-01-31 12:00:05' ELSE TIMESTAMP '2024-01-01' END AS ran_at FROM nation")
def stamped_files(spark: SparkSession, d: str) -> DataFrame:
    """I7"""
    name = F.when(F.col("n_nationkey") % 2 == 0, "run-20290131T120005.json").otherwise("run-20290199T990005.json")
    return _t(spark, d, "nation").select("n_nationkey", text.stamp_of(name, F.lit("2024-01-01").cast("timestamp")).cast("timestamp_ntz").alias("ran_at"))


@query("""SELECT conv_id, turn, sha256('{"content":' || to_json(text) || ',"role":"' || role || '"}') AS fixture_key, turn AS stored FROM conversations""")
def fixture_keys(spark: SparkSession, d: str) -> DataFrame:
    """Digests of requests, and a context stored as JSON and read again"""
    m = tables.messages(spark, d)
    stored = F.from_json(F.to_json(F.struct(F.col("turn").alias("n"), F.array("role").alias("roles"))), "n bigint, roles array<string>")
    return m.select("conv_id", "turn", text.digest(text.canonical_json("content", "role")).alias("fixture_key"), stored["n"].alias("stored"))


@query("SELECT chunk_id, CASE WHEN is_parent THEN NULL ELSE 'v' || chunk_id END AS vector_id FROM (SELECT doc_id AS chunk_id, doc_id % 4 = 0 AS is_parent FROM documents)")
def vector_ids(spark: SparkSession, d: str) -> DataFrame:
    """All but parents are embedded, in batches whose width and number are checked"""
    c = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", (F.col("doc_id") % 4 == 0).alias("is_parent"))
    embedded = evaluation.embedded(c.where("NOT is_parent"), evaluation.hash_vectors("test", 8), 8)
    return c.join(embedded.select("chunk_id", F.concat(F.lit("v"), F.col("chunk_id").cast("string")).alias("vector_id")), "chunk_id", "left").select("chunk_id", "vector_id")


@query("SELECT arg_max(expected || ' -> ' || actual, {'n': n, 'e': expected, 'a': actual}) AS worst FROM (SELECT CAST(l.quality AS VARCHAR) AS expected, CASE WHEN d.n_chars > 400 THEN '1' ELSE '0' END AS actual, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2) WHERE expected <> actual")
def worst_confusion(spark: SparkSession, d: str) -> DataFrame:
    """P43"""
    j = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return evaluation.worst_confusion(evaluation.confusion(j.select(F.col("quality").cast("string").alias("expected"), F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("actual"))))


@query("SELECT event_type, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT) + 1)] AS p95 FROM events WHERE event_id % 5 > 0 GROUP BY 1")
def floor_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The element at floor(n f), which is another percentile than the nearest rank"""
    return _t(spark, d, "events").where("event_id % 5 > 0").groupBy("event_type").agg(evaluation.floor_rank("value", 0.95).alias("p95"))
