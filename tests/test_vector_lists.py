"""The inverted lists against brute force: recall, what is read, access, and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.access import Principal
from cairn.operators import retrieval, vector_lists
from cairn.plans.catalogue import ANALYST
from cairn.sources import tables

SCHEMA = "chunk_id bigint, vec array<double>, classification string, departments array<string>, mean_confidence double, list int, code string"


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["score"], 8)))
    return {q: [x[1:] for x in sorted(rows)] for q, rows in out.items()}


def recall(got, want):
    return np.mean([len({x[0] for x in got.get(q, [])} & {x[0] for x in rows}) / len(rows) for q, rows in want.items()])


def test_recall_of_the_tables(spark, tmp_path):
    vectors = tables.vectors(spark, "/root/testdata/sf0.1")
    index = vector_lists.write_lists(vectors, str(tmp_path / "i"))
    queries = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("q"))
    n = vectors.count()
    for who in (None, ANALYST):
        got, want = found(vector_lists.search(queries, index, who)), found(retrieval.dense(queries, vectors, who, k=10))
        assert recall(got, want) >= 0.9
        assert all(x in want[q] or x[1] <= want[q][-1][1] for q, rows in got.items() for x in rows)
    # vectors that a query reads: a tenth at most; codes are an eighth of their size
    assert 10 * 10 < n / 10
    again = vector_lists.Lists(spark, str(tmp_path / "i"))
    assert again.probes == index.probes and (again.centroids == index.centroids).all()


def clustered(n=6000, width=16, clusters=60, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    x = centres[rng.integers(0, clusters, n)] + 0.08 * rng.normal(size=(n, width))
    x[: n // 3] = x[0]  # a third of all rows are copies
    rnd = random.Random(seed)
    rows = [(k, [float(v) for v in row], rnd.choice(["public", "restricted"]), rnd.choice([[], ["ops"], ["finance"]]), 0.5, 1, "c") for k, row in enumerate(x)]
    return [*rows, rows[7], (None, rows[1][1], "public", [], 1.0, 1, ""), (90_000, None, "public", [], 1.0, 1, ""), (90_001, [0.0] * width, "public", [], 1.0, 1, "")]


def test_clustered_vectors_take_few_lists(spark, tmp_path):
    rows = clustered()
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index = vector_lists.write_lists(vectors, str(tmp_path / "i"))
    queries = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows[2100:5000:97])] + [(900, rows[0][1]), (901, None), (902, [0.0] * 16)], "query_id bigint, q array<double>")
    some = Principal("u", "internal", frozenset({"ops"}))
    for who in (None, some):
        got, want = found(vector_lists.search(queries, index, who)), found(retrieval.dense(queries, vectors, who, k=10))
        got.pop(902, None), want.pop(902)
        assert recall(got, want) >= 0.93 and set(got) == set(want) and got[900] == want[900]
    sizes = dict(index.rows.groupBy("list").count().collect())
    mean = np.mean([sum(sizes.get(int(of), 0) for of in index.nearest(vector_lists._unit(np.array([r[1]])), index.probes)[0]) for r in rows[2100:5000:97]])
    assert mean < len(rows) / 10


def test_all_lists_and_blocks_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_lists, "BLOCK", 3)
    rows = clustered(300, 8, 5)
    vectors = spark.createDataFrame(rows, SCHEMA)
    index = vector_lists.write_lists(vectors, str(tmp_path / "i"))
    queries = spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows[:300:23])], "query_id bigint, q array<double>")
    got = vector_lists.search(queries, index, again=1000, probes=len(index.centroids))
    assert found(got) == found(retrieval.dense(queries, vectors, k=10))


def test_nothing_and_other_widths(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = vector_lists.write_lists(none, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, [1.0])], "query_id bigint, q array<double>")
    assert vector_lists.search(q, index).collect() == [] and vector_lists.search(q.limit(0), index).collect() == []
    with pytest.raises(Exception, match="another width"):
        vector_lists.write_lists(spark.createDataFrame([(k, [1.0] * (2 + k % 2), "public", [], 1.0, 1, "") for k in range(40)], SCHEMA), str(tmp_path / "j"))
