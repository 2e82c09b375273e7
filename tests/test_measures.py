"""Rates, carried states, citations and nested redaction: odd rows and bounds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import redaction
from cairn.operators import measures


def test_clearances(spark):
    roles = spark.createDataFrame([("r", "restricted"), ("i", "internal"), ("odd", "cosmic"), ("none", None)], "role string, clearance string")
    users = spark.createDataFrame([(1, "r"), (1, "i"), (2, "odd"), (3, "none"), (3, "i"), (4, "missing"), (5, None), (None, "i")], "user_id bigint, role string")
    assert dict(measures.highest_clearance(users, roles).collect()) == {1: "restricted", 2: "public", 3: "internal", 4: "public", 5: "public", None: "internal"}


CASES = "answerable boolean, refused boolean, found boolean, citations int, unresolved int, grounded double, failed boolean"


def test_grounding_of_nothing_and_of_nulls(spark):
    assert tuple(measures.grounding_rates(spark.createDataFrame([], CASES)).first()) == (0, 1.0, 1.0, 0.0, 0.0, 0.0)
    rows = [(True, False, True, 1, 0, 1.0, False), (True, None, True, None, 2, None, None), (False, True, None, 0, 0, 0.5, True), (None, False, False, 3, None, 0.0, False)]
    assert tuple(measures.grounding_rates(spark.createDataFrame(rows, CASES)).first()) == (4, 0.5, 0.5, 0.375, 0.5, 0.25)


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 21, 400])
def test_floor_ranks(spark, n):
    rnd = random.Random(n)
    xs = [rnd.choice([1.0, 1.0, 2.5, rnd.random() * 9]) for _ in range(n)]
    rows = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").repartition(3)
    wanted = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    at = lambda f: sorted(xs)[min(n - 1, int(n * f))] if n else 0.0
    assert dict(measures.floor_ranks(rows, "x", wanted).collect()) == {k: at(f) for k, f in wanted.items()}


def test_routing_of_nothing(spark):
    got = dict(measures.routing_rates(spark.createDataFrame([], "lane string, stage int, latency_ms double, has_images boolean, sees boolean, cached boolean")).collect())
    assert got == {"decisions": 0.0, "stage0_share": 0.0, "stage2_share": 0.0, "vision_capability_rate": 1.0, "cache_hit_rate": 0.0, "decide_p50_ms": 0.0, "decide_p95_ms": 0.0}


def test_citations(spark):
    texts = [None, "", "[]", "{}", '{"n": null, "page_no": 7, "bbox": {"x0": 0.5}, "odd": [1]}', '{"score": 0.123456, "confidence": 0.98765, "section_path": ["a"], "parent_id": "p", "doc_title": "\\"q\\" ü"}']
    got = [r["c"].asDict(True) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", measures.read_citation(F.col("t")).alias("c")).orderBy("k").collect()]
    plain = {"n": 0, "chunk_id": "", "doc_id": "", "doc_title": "", "page_no": 1, "snippet": "", "section_path": [], "score": 0.0, "retrieval_method": "hybrid", "confidence": 1.0, "doc_type": "", "parent_id": None, "bbox": {"x0": 0.0, "y0": 0.0, "x1": 0.0, "y1": 0.0}}
    assert got[:4] == [plain] * 4
    assert got[4] == plain | {"page_no": 7, "bbox": plain["bbox"] | {"x0": 0.5}}
    assert got[5] == plain | {"score": 0.123456, "confidence": 0.98765, "section_path": ["a"], "parent_id": "p", "doc_title": '"q" ü'}
    written = json.loads(spark.createDataFrame([(texts[5],)], "t string").select(measures.write_citation(measures.read_citation(F.col("t")))).first()[0])
    assert written == {k: v for k, v in got[5].items() if k != "parent_id"} | {"score": 0.1235, "confidence": 0.988}


def nested(depth, rnd):
    if depth == 0:
        return rnd.choice(["plain", "mail a.b@site.org", "x" * 600, 7, 0.5, None, True, "Bearer " + "a" * 20])
    if rnd.random() < 0.5:
        return [nested(depth - 1, rnd) for _ in range(rnd.choice([0, 1, 3, 103 if depth < 3 else 2]))]
    return {rnd.choice(["name", "Password", "note", "my_api_key", "list"]) + str(k): nested(depth - 1, rnd) for k in range(3)}


def plain_redaction(value, path=()):
    """The same by paths: what a leaf becomes depends on the path to it."""
    if len(path) > 8:
        return "[TRUNCATED: max depth]"
    if isinstance(value, dict):
        return {k: "[REDACTED]" if "password" in k.lower() or "api_key" in k.lower() else plain_redaction(v, (*path, k)) for k, v in value.items()}
    if isinstance(value, list):
        out = [plain_redaction(v, (*path, k)) for k, v in enumerate(value) if k < 100]
        return out if len(value) <= 100 else [*out, f"[TRUNCATED: {len(value) - 100} more items]"]
    known = {"mail a.b@site.org": "mail [REDACTED]", "x" * 600: "x" * 512 + "... [TRUNCATED: 600 chars]", "Bearer " + "a" * 20: "Bearer [REDACTED]"}
    return known.get(value, value) if isinstance(value, str) else value


def test_nested_redaction(spark):
    rnd = random.Random(8)
    values = [nested(d, rnd) for d in [*range(10), 9, 9] for _ in range(6)]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)]
    extra = [(1000, None), (1001, "no json: a@b.cd"), (1002, ""), (1003, "[" * 100_000 + "]" * 100_000), (1004, '{"secret": {"a": 1}, "b": {"c": "ü"}}')]
    got = dict(spark.createDataFrame(rows + extra, "k int, t string").select("k", redaction.redact_json(F.col("t"))).collect())
    for k, v in enumerate(values):
        assert json.loads(got[k]) == plain_redaction(v), k
    assert got[1000] is None and got[1001] == '"no json: [REDACTED]"' and got[1002] == '""' and got[1003] == '"[TRUNCATED: max depth]"' and got[1004] == '{"b":{"c":"ü"},"secret":"[REDACTED]"}'
