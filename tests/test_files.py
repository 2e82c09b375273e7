"""Scans and sinks over small files made here."""

import io
import zipfile

from pyspark.sql import functions as F

from cairn.operators import chunking, evaluation, records, retrieval, routing
from cairn.sources import files

WORD = (
    '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>First </w:t></w:r><w:r><w:t>part</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
)
SLIDE = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:p><a:r><a:t>line</a:t></a:r></a:p></p:sp></p:sld>'


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def test_scan_and_office(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": WORD}))
    (tmp_path / "b.pptx").write_bytes(archive({"ppt/presentation.xml": "<x/>", "ppt/slides/slide10.xml": SLIDE, "ppt/slides/slide2.xml": SLIDE.replace("Title", "Earlier")}))
    (tmp_path / "c.eml").write_bytes(b"From: a@x\r\nTo: b@x\r\nSubject: Pump\r\nContent-Type: text/plain\r\n\r\nIt leaks.\r\n")
    found = files.scan(spark, str(tmp_path)).select("path", "name", "content", "sha256", "kind.mime")
    kinds = {r["name"]: r["mime"] for r in found.collect()}
    assert kinds["a.docx"].endswith("wordprocessingml.document") and kinds["b.pptx"].endswith("presentationml.presentation") and kinds["c.eml"] == "message/rfc822"
    rows = [(r["path"][-6:], r["page_no"], r["type"], r["level"], r["text"]) for r in files.office_blocks(found.where("name <> 'c.eml'")).orderBy("path", "page_no", "pos").collect()]
    assert rows == [("a.docx", 1, "heading", 2, "Scope"), ("a.docx", 1, "paragraph", None, "First part"), ("a.docx", 1, "table", None, "a | b"), ("b.pptx", 1, "paragraph", None, "Earlier\nline"), ("b.pptx", 2, "paragraph", None, "Title\nline")]
    mail = files.mails(found.where("name = 'c.eml'")).first()
    assert (mail["sender"], mail["subject"], mail["text"].strip()) == ("a@x", "Pump", "It leaks.")


def test_blobs(spark, tmp_path):
    df = spark.createDataFrame([(b"one",), (b"two",), (b"one",)], "content binary").withColumn("sha256", F.sha2("content", 256))
    assert files.put_blobs(df, str(tmp_path / "blobs")).count() == 2
    held = spark.read.parquet(str(tmp_path / "blobs"))
    again = df.unionByName(spark.createDataFrame([(b"three",)], "content binary").withColumn("sha256", F.sha2("content", 256)))
    files.put_blobs(again, str(tmp_path / "blobs"), spark.createDataFrame(held.select("sha256").collect(), "sha256 string"))
    held = spark.read.parquet(str(tmp_path / "blobs"))
    assert held.count() == 3 and all(r["intact"] for r in files.verify_blobs(held).collect())


def test_tables_and_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Date,Tag,mm\n2023,V-1201,12.50\n,,\n2029,V-1201,09.2\n")
    rows = files.delimited(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in rows.collect()] == [("2023", "V-1201", "12.50"), ("2029", "V-1201", "09.2")]
    (tmp_path / "g.jsonl").write_text('{"id":"a","n":1}\n\nnot json\n{"id":"b","n":2}\n')
    assert {r["id"] for r in files.json_lines(spark, str(tmp_path / "g.jsonl"), "id string, n int").collect()} == {"a", "b"}
    files.write_log(spark.createDataFrame([(2, "b", None), (1, "a", "x")], "seq int, who string, note string"), str(tmp_path / "log"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"note":"x","seq":1,"who":"a"}', '{"note":null,"seq":2,"who":"b"}']


def test_html(spark):
    page = "<html><head><title>t</title></head><body><script>x()</script><h1>Head</h1><p>One &amp; two</p><!-- no --><ul><li>a</li><li>b</li></ul></body></html>"
    assert spark.range(1).select(files.html_text(F.lit(page))).first()[0] == "Head\nOne & two\na\nb"


def test_markdown_blocks(spark):
    df = spark.createDataFrame([(1, "# Top\n\nintro text\n\n## Sub\nbody\n\n| a | b |\n| 1 | 2 |")], "doc_id bigint, text string")
    got = [(r["type"], r["level"], r["text"]) for r in chunking.blocks_of(df).orderBy("pos").collect()]
    assert got[:3] == [("heading", 1, "Top"), ("paragraph", None, "intro text"), ("heading", 2, "Sub\nbody")] or got[:4] == [("heading", 1, "Top"), ("paragraph", None, "intro text"), ("heading", 2, "Sub"), ("paragraph", None, "body")]
    assert got[-1][0] == "table"


def test_oversized_blocks(spark):
    df = spark.createDataFrame([(1, 0, "table", None, "h1 | h2\n" + "\n".join(f"{k} | value" for k in range(40))), (1, 1, "paragraph", None, "One. " * 300), (1, 2, "paragraph", None, "word " * 400)], "doc_id bigint, pos bigint, type string, level int, text string")
    parts = chunking.split_long(df, 50).collect()
    assert all(p["text"].startswith("h1 | h2\n") for p in parts if p["pos"] == 0) and sum(p["text"].count("value") for p in parts) == 40
    assert sum(p["text"].count("One.") for p in parts) == 300 and sum(p["text"].count("word") for p in parts) == 400
    chunks = chunking.chunk(df, parent=120, child=50, overlap=8).collect()
    assert [c["ordinal"] for c in sorted(chunks, key=lambda c: c["ordinal"])] == list(range(len(chunks)))
    assert all(c["tokens"] <= 80 for c in chunks if not c["is_parent"])


def test_routing_tables(spark):
    models = spark.createDataFrame([("m1", "p", "x", 4.0, True, True, "2024-01-01"), ("m2", "p", "x", 5.0, True, False, "2024-01-02"), ("m3", "p", "y", 3.0, True, False, "2024-01-03")], "model string, provider string, physical string, ram_gb double, resident boolean, pinned boolean, last_used string")
    assert {r["physical"]: (r["ram_gb"], r["pinned"]) for r in routing.resident_gb(models).collect()} == {"x": (5.0, True), "y": (3.0, False)}
    held = spark.createDataFrame([("x", 5.0, "2024-01-01", False), ("y", 3.0, "2024-01-02", False), ("z", 2.0, "2024-01-03", True)], "physical string, ram_gb double, last_used string, pinned boolean")
    assert {r["physical"] for r in routing.evictions(held, 4.0, 12.0).collect()} == {"x"}
    change = routing.drift(models, spark.createDataFrame([("p", "x"), ("p", "w")], "provider string, physical string"))
    assert {(r["physical"], r["change"]) for r in change.collect()} == {("y", "forget"), ("w", "adopt")}


def test_deletes_and_sessions(spark):
    docs = spark.createDataFrame([(1, None), (2, None)], "doc_id bigint, deleted_at timestamp_ntz")
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    d, c = records.soft_delete(docs, chunks, spark.createDataFrame([(1,)], "doc_id bigint"), "2024-01-01")
    assert {r["doc_id"]: r["deleted_at"] is None for r in d.collect()} == {1: False, 2: True} and [r["doc_id"] for r in c.collect()] == [2]
    s = spark.createDataFrame([("u1", "t1", True), ("u1", "t2", False), ("u2", "t3", False)], "user_id string, token_hash string, revoked boolean")
    got = {r["token_hash"]: r["revoked"] for r in records.revoke_sessions(s, spark.createDataFrame([("t1",), ("t3",)], "token_hash string")).collect()}
    assert got == {"t1": True, "t2": True, "t3": False}


def test_reports_and_graph(spark):
    m = spark.createDataFrame([("s", "acc", 0.9), ("s", "lat", 5.0)], "suite string, metric string, value double")
    t = spark.createDataFrame([("s", "acc", ">=", 0.95), ("s", "lat", "<=", 6.0)], "suite string, metric string, op string, threshold double")
    b = spark.createDataFrame([("s", "acc", 0.8), ("s", "lat", 4.0)], "suite string, metric string, baseline double")
    r = evaluation.suite_report(m, t, b)
    assert {x["metric"]: (x["met"], x["arrow"]) for x in r.collect()} == {"acc": (False, "up"), "lat": (True, "down")}
    assert evaluation.suite_passed(r).first()["failures"] == ["acc"]
    hits = spark.createDataFrame([(1, 10, "d1", 0.5, True), (1, 11, "d1", 0.01, False)], "query_id bigint, chunk_id bigint, doc_type string, score double, cited boolean")
    nodes, edges = retrieval.evidence_graph(hits)
    assert nodes.first()["passages"] == 2 and {e["chunk_id"]: e["weight"] for e in edges.collect()} == {10: 1.0, 11: 0.15}
