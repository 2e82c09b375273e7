"""Models chosen and stood in for: against a plain statement over odd rows, and with work that grows with the rows, not with pairs."""

import random

import pytest

from cairn.operators import providers, retrieval, routing
from cairn.plans import inventory

MODELS = "model bigint, lane bigint, pos bigint, open boolean"
DECISIONS = "request_id bigint, lane bigint, attempted array<bigint>, confidence double"


def plain_fallback(decisions, models):
    for i, lane, attempted, confidence in decisions:
        ladder = sorted((pos, m) for m, at, pos, open_ in models if at == lane and lane is not None and open_ is False and m is not None)
        left = [m for _, m in ladder if attempted is not None and None not in attempted and m not in attempted]
        if left:
            yield i, left[0], round(confidence * 0.8, 10)


def test_fallback(spark):
    rnd = random.Random(3)
    models = [(rnd.choice([*range(25), None]), rnd.choice([0, 1, 2, None]), rnd.randrange(9), rnd.choice([True, False, False, None])) for _ in range(90)]
    decisions = [(i, rnd.choice([0, 1, 2, 7, None]), rnd.choice([None, [], [None, 3], rnd.sample(range(25), rnd.randrange(25)), list(range(25)), [4, 4, 4]]), i / 200) for i in range(200)]
    got = providers.fallback(spark.createDataFrame(decisions, DECISIONS), spark.createDataFrame(models, MODELS))
    assert sorted(map(tuple, got.collect())) == sorted(plain_fallback(decisions, models))
    assert providers.fallback(spark.createDataFrame([], DECISIONS), spark.createDataFrame(models, MODELS)).collect() == []


def test_a_ladder_is_no_longer_than_what_was_attempted(spark):
    models = spark.createDataFrame([(i, 0, i, False) for i in range(3000)], MODELS).repartition(3)
    out = providers.fallback(spark.createDataFrame([(1, 0, [0, 1, 5], 1.0)], DECISIONS), models)
    assert [tuple(r) for r in out.collect()] == [(1, 2, 0.8)]
    # each task sends the first four of a lane, not all
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


REQUESTS = "request_id bigint, lane string, needs struct<capabilities:array<string>,window:bigint>"
OFFERED = "model bigint, lane string, pos bigint, capabilities array<string>, window bigint, quality_tier int, speed_tier int, ram_gb double, resident boolean, open boolean"


def plain_selection(requests, models):
    for i, lane, (asked, least) in requests:
        fit, narrow = [], []
        for model, at, pos, has, window, quality, speed, ram, resident, open_ in models:
            if at != lane or lane is None or open_ or (asked is not None and has is not None and set(asked) - set(has)):
                continue
            swap = 0.0 if resident else 6.0 * max(0.5, ram / 6)
            if window is None or least is None or window >= least:
                fit.append((-round((5.0 - quality) + (5.0 - speed) * 0.5 - swap * 0.15 + resident, 9), pos, model, swap))
            else:
                narrow.append((-window, pos, model, swap))
        for rows, chunked in ((fit, False), (narrow, True)):
            if rows:
                _, _, model, swap = min(rows)
                yield i, model, round(swap, 9), chunked
                break


def test_selection(spark):
    rnd = random.Random(5)
    kinds = ["chat", "tools", "json"]
    some = lambda: rnd.choice([None, rnd.sample(kinds, rnd.randrange(4)), ["chat"]])
    for n in (3, 40, 200):
        models = [(k, rnd.choice(["a", "b", None]), k, some(), rnd.choice([None, *[rnd.randrange(1, 60) * 1000] * 9]), rnd.randrange(1, 5), rnd.randrange(1, 5), float(rnd.randrange(1, 40)), rnd.random() < 0.2, rnd.choice([True, False, False, None])) for k in range(n)]
        requests = [(i, rnd.choice(["a", "b", "c", None]), (some(), rnd.choice([None, rnd.randrange(70000), rnd.randrange(1, 60) * 1000]))) for i in range(300)]
        got = routing.select_models(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(models, OFFERED))
        assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in got.collect()) == sorted(plain_selection(requests, models))


def test_requests_and_models_are_no_pairs(spark):
    models = spark.createDataFrame([(k, "a", k, ["chat"], 1000 + k, 1 + k % 4, 1, 8.0, False, False) for k in range(400)], OFFERED)
    requests = spark.createDataFrame([(i, "a", (["chat"], i)) for i in range(1000)], REQUESTS)
    joins = []

    def walk(node):
        for k in range(node.children().size()):
            walk(node.children().apply(k))
        if "Join" in node.nodeName():
            joins.append(node.metrics().apply("numOutputRows").value())

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # stages hide what is below them
    try:
        out = routing.select_models(requests, models)
        assert len(out.collect()) == 1000
        walk(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert joins and max(joins) <= 1000


def test_a_page_is_the_same_however_rows_are_stored(spark, tmp_path):
    # both edges of the page cut lines of the same number and other types
    rows = [(1, 1, "A")] * 4 + [(11, 2, "R"), (11, 2, "A")] + [(21 + 10 * k, 1, "A") for k in range(18)] + [(901, 3, "R"), (901, 3, "A"), (901, 3, "R")]
    want = sorted(sorted(rows)[5:25])
    for name, stored in (("up", sorted(rows)), ("down", sorted(rows, reverse=True))):
        spark.createDataFrame(stored, "l_orderkey bigint, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        assert sorted(map(tuple, inventory.blocks_of_type(spark, str(tmp_path / name)).collect())) == want


def test_blocks_of_vectors_never_go_through_the_driver(spark):
    rnd = random.Random(8)
    rows = [(k, [round(rnd.random(), 1) for _ in range(4)], "public", [], 0.9) for k in range(300)]
    vectors = spark.createDataFrame(rows, "chunk_id bigint, vec array<double>, classification string, departments array<string>, mean_confidence double")
    out = retrieval.dense(vectors.where("chunk_id < 40").selectExpr("chunk_id AS query_id", "vec AS q"), vectors, k=5)
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in out.collect())
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    for i in range(40):
        mine = [(c, s) for q, _, c, s in got if q == i]
        best = sorted((-sum(a * b for a, b in zip(rows[i][1], v, strict=True)) / (norm(rows[i][1]) * norm(v)), k) for k, v, *_ in rows)[:5]
        assert [s for _, s in mine] == pytest.approx([-s for s, _ in best], abs=1e-9) and len(mine) == 5


def test_a_text_asked_by_many_is_searched_once(spark):
    chunks = spark.createDataFrame([(k, f"pump {'valve ' * (k % 3)} seal{k % 5}", 0.9) for k in range(60)], "chunk_id bigint, text string, mean_confidence double")
    queries = spark.createDataFrame([(q, ("pump valve", "seal1 seal2", "nothing", None)[q % 4]) for q in range(400)], "query_id bigint, text string")
    out = retrieval.sparse(queries, chunks, k=7)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["score"], 6)))
    assert set(got) == {q for q in range(400) if q % 4 < 2}
    words = lambda k: ["pump", *["valve"] * (k % 3), f"seal{k % 5}"]
    for q, rows in got.items():
        n = {k: sum(w in ("pump valve", "seal1 seal2")[q % 4].split() for w in words(k)) for k in range(60)}
        assert sorted(rows) == [(r, k, round(n[k] / 10, 6)) for r, k in enumerate(sorted((k for k in n if n[k]), key=lambda k: (-n[k], k))[:7], 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = retrieval.sparse(queries, chunks, k=7)
        out.collect()
        most = []

        def walk(node):
            for k in range(node.children().size()):
                walk(node.children().apply(k))
            if "Join" in node.nodeName():
                most.append(node.metrics().apply("numOutputRows").value())

        walk(out._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # 400 queries: their hits before the best are taken would be 10,000 rows and more
    assert max(most) <= 400 * 7
