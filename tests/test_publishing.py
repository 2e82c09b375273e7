"""Changes of several tables at once: all or nothing, by version, and deletions that scans apply."""

import pytest
from pyspark.sql import functions as F

from cairn.operators.publishing import Conflict, Corpus

TABLES = {"documents": "doc_id bigint, title string", "chunks": "doc_id bigint, n int, text string", "vectors": "doc_id bigint, n int, vec array<float>"}


@pytest.fixture()
def corpus(spark, tmp_path):
    return Corpus(spark, f"file://{tmp_path}/corpus", TABLES)


def rows(spark, ids, mark):
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    parts = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    return {"documents": docs.withColumn("title", F.lit(mark)), "chunks": parts.withColumn("text", F.concat(F.lit(mark), F.col("n").cast("string"))), "vectors": parts.withColumn("vec", F.array(F.lit(0.5)))}


def seen(corpus, version=None):
    docs = {(r["doc_id"], r["title"]) for r in corpus.read("documents", version).collect()}
    for name in ("chunks", "vectors"):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n"]) for r in corpus.read(name, version).collect())
        assert got == sorted((i is None, i or 0, n) for i, _ in docs for n in (1, 2, 3)), name
    return docs


def folders(tmp_path):
    return sorted(f"{p.parent.name}/{p.name}" for p in tmp_path.glob("corpus/rows/*/*"))


def test_changes(spark, corpus, tmp_path):
    assert corpus.version() == 0 and corpus.read("chunks").collect() == []
    assert corpus.publish(rows(spark, [1, 2, 3, None], "a")) == 1
    assert corpus.publish(rows(spark, [2, 4], "b")) == 2
    assert corpus.delete(spark.createDataFrame([(1,), (None,), (77,)], "doc_id bigint")) == 3
    assert corpus.publish(rows(spark, [1], "c")) == 4
    want = [set(), {(1, "a"), (2, "a"), (3, "a"), (None, "a")}, {(1, "a"), (2, "b"), (3, "a"), (4, "b"), (None, "a")}, {(2, "b"), (3, "a"), (4, "b"), (None, "a")}, {(1, "c"), (2, "b"), (3, "a"), (4, "b"), (None, "a")}]
    for version in range(5):
        assert seen(corpus, version) == want[version]
    assert corpus.compact() == 5 and seen(corpus) == want[4] and seen(corpus, 3) == want[3]
    assert "tombstones" not in corpus.manifest()
    before = folders(tmp_path)
    gone = corpus.vacuum()
    assert seen(corpus) == want[4] and folders(tmp_path) == sorted(set(before) - set(gone)) and len(folders(tmp_path)) == 3
    assert corpus.publish(rows(spark, [3], "d")) == 6 and (3, "d") in seen(corpus) and len(seen(corpus)) == 5


def test_a_failed_write_leaves_the_version_before(spark, corpus, tmp_path):
    corpus.publish(rows(spark, [1, 2], "a"))
    there = folders(tmp_path)
    new = rows(spark, [2, 3], "b")
    new["vectors"] = new["vectors"].withColumn("vec", F.array(F.raise_error("no room").cast("float")))
    with pytest.raises(Exception, match="no room"):
        corpus.publish(new)
    assert corpus.version() == 1 and seen(corpus) == {(1, "a"), (2, "a")} and folders(tmp_path) == there
    with pytest.raises(ValueError, match="no column odd"):
        corpus.publish({"documents": new["documents"].withColumn("odd", F.lit(1))})
    assert folders(tmp_path) == there


def test_the_later_of_two_writers_gets_a_conflict(spark, corpus, tmp_path):
    corpus.publish(rows(spark, [1], "a"))
    began = corpus.version()
    corpus.publish(rows(spark, [2], "b"), began)
    there = folders(tmp_path)
    with pytest.raises(Conflict):
        corpus.publish(rows(spark, [1], "c"), began)
    with pytest.raises(Conflict):
        corpus.delete(spark.createDataFrame([(1,)], "doc_id bigint"), began)
    assert seen(corpus) == {(1, "a"), (2, "b")} and folders(tmp_path) == there


def test_a_manifest_that_came_meanwhile_is_not_overwritten(spark, corpus, monkeypatch):
    corpus.publish(rows(spark, [1], "a"))
    corpus.publish(rows(spark, [2], "b"))
    monkeypatch.setattr(corpus, "version", lambda: 1)
    with pytest.raises(Conflict):
        corpus.publish(rows(spark, [3], "c"))
    monkeypatch.undo()
    assert corpus.version() == 2 and seen(corpus) == {(1, "a"), (2, "b")}


def test_missing_columns_and_empty_changes(spark, corpus):
    none = spark.createDataFrame([], "doc_id bigint")
    assert corpus.publish({"documents": spark.createDataFrame([(5,), (5,)], "doc_id bigint"), "chunks": none, "vectors": none}) == 1
    assert corpus.delete(none) == 2
    assert [tuple(r)[:2] for r in corpus.read("documents").collect()] == [(5, None), (5, None)]
