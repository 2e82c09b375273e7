"""Operators 11 to 13 against brute force, held-out accuracy and odd rows."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ROWS, SCHEMA

from cairn.llm import filter_audit, hyperdimensional, queries, yinyang


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(where)
    return spark.read.parquet(where)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11: language ---------------------------------------------------------------------------------------------------------
def plain_trigrams(text):
    codes = [0]
    for c in text:
        f = hyperdimensional._fold(ord(c))
        if f or codes[-1]:
            codes.append(f)
    return [*zip(codes, codes[1:], codes[2:])] if codes[-1] == 0 else [*zip(codes, codes[1:] + [0], codes[2:] + [0])]


def plain_profile(text):
    v, out = hyperdimensional._letters, np.zeros(hyperdimensional.DIMENSIONS)
    for a, b, c in plain_trigrams(text):
        out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


HARD = ["a", "  a ", "Été à la mer", "don't—stop 12 x", "हिन्दी भाषा", "日本語 の 文", "\U00010400\U00010428 deseret", "İstanbul ŞŞ", "abc" * 500, "x" * 3000, "", "123 ,,"]


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_profiles(monkeypatch, piece):
    monkeypatch.setattr(hyperdimensional, "PIECE", piece)
    for text in HARD if piece > 3 else [t[:200] for t in HARD]:
        assert (hyperdimensional.profile(text) == plain_profile(text)).all()


def test_trigram_order_matters_and_letters_are_fixed():
    assert abs(plain_profile("abc") @ plain_profile("cba")) < 0.5 * plain_profile("abc") @ plain_profile("abc")
    assert hashlib.sha256(hyperdimensional.Letters()[97].tobytes()).hexdigest() == hashlib.sha256(hyperdimensional.Letters()[97].tobytes()).hexdigest()
    assert abs(hyperdimensional.Letters()[97] @ hyperdimensional.Letters()[98]) < 200


def plain_identify(rows):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 4 == 2
    known = {}
    for i, text, lang, *_ in rows:
        if not held(i) and lang is not None and text and any(c.isalpha() for c in text):
            known[lang] = known.get(lang, 0) + plain_profile(text)
    out = []
    for i, text, *_ in rows:
        best, score = "und", 0.0
        if known and text and any(c.isalpha() for c in text):
            p = plain_profile(text)
            cosines = [(-round(float(k @ p) / float(np.linalg.norm(k) * np.linalg.norm(p)), 9), x) for x, k in known.items()]
            score, best = min(cosines)
            score = max(0.0, -score)
        out.append((i, held(i), best, round(score, 6)))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_language_is_that_of_the_nearest_prototype(docs, block):
    got = hyperdimensional.identify(docs, block).collect()
    assert sorted(str((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6))) for r in got) == plain_identify(ROWS)


def test_small_merges_and_many_languages_in_a_task(docs, monkeypatch):
    monkeypatch.setattr(hyperdimensional, "PENDING", 50)
    monkeypatch.setattr(hyperdimensional, "BLOCK", 2)
    got = hyperdimensional.identify(docs).collect()
    assert sorted(str((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6))) for r in got) == plain_identify(ROWS)


def test_languages_of_nothing(spark, docs, empty):
    assert hyperdimensional.identify(empty).collect() == []
    got = hyperdimensional.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == len(ROWS) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_equal_prototypes_go_to_the_smaller_language(spark):
    rows = [(k, "the same words in two languages", "zz" if k % 2 else "aa") for k in range(1, 40)]
    got = hyperdimensional.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"aa"}


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = hyperdimensional.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    blind = hyperdimensional.identify(docs.withColumn("lang", F.when(~hyperdimensional.held_out(F.col("doc_id")), F.col("lang"))).withColumn("source", F.lit("x"))).collect()
    whole = hyperdimensional.identify(docs).collect()
    assert sorted(map(str, blind)) == sorted(map(str, whole))


# --- 12: audit ------------------------------------------------------------------------------------------------------------
def test_swaps_visit_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), set()
        seen.add(tuple(order))
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def plain_audit(rows, labels):
    """rows: (doc_id, text, part); each order is applied to the documents themselves."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    facts = []
    for i, text, part in rows:
        t = text or ""
        ws = [w for w in t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        facts.append((part or "", fails, i in good, i in toxic))
    out = []
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        total, found = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[1][x]]
                left = [f for f in left if not f[1][x]]
                total[x] += len(gone)
                fails = [f for f in own if f[1][x]]
                found.append((part, order, step, len(left), len(gone), len(fails) - len(gone), sum(sum(f[1].values()) == 1 for f in fails), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        out += [(*f, total[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit(spark, docs, empty):
    more = [(900, "# ten $ # " * 60, "src1"), (901, "AB CD " * 40, "src1"), (902, "AB CD " * 40, None), (902, "AB CD " * 40, ""), (3, "AB CD " * 40, "src2")]
    rows = [(r[0], r[1], r[3]) for r in ROWS] + more
    table = docs.select("doc_id", "text", "source", "n_chars", F.lit(1).alias("good"), F.lit(2).alias("mask"), F.lit(3).alias("part"), F.lit(4).alias("n"))
    table = table.unionByName(spark.createDataFrame(more, "doc_id bigint, text string, source string"), allowMissingColumns=True)
    rnd = random.Random(3)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 60, 2), 900, 902]] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (12345, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("source", F.lit("s"))
    assert audited(filter_audit.audit(table, said)) == plain_audit(rows, labels)
    assert audited(filter_audit.audit(table, said.limit(0))) == plain_audit(rows, [])
    assert filter_audit.audit(empty, said).collect() == []


def test_audit_adds_up(spark, sf):
    got = queries.op12_transposition_audit(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.groupBy("filter_order").agg(F.sum("removed").alias("r"), F.sum(F.when(F.col("step") == 5, F.col("kept"))).alias("k")).where(F.col("r") + F.col("k") != n).count() == 0
    assert got.groupBy("part", "filter_order").count().where("count <> 5").count() == 0


# --- 13: codes ------------------------------------------------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector, label)."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(fine[0][1])
    fine = [(i, [math.floor(x) * scale if abs(x) > 2**53 else math.floor(x * scale) for x in v], label) for i, v, label in fine if len(v) == length]
    size = length // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in fine[:entries]] for p in range(parts)]

    def assign():
        return [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in fine]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), a in zip(fine, got) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors, total = [sum(d for d, _ in a) for a in got], {}
    for (_, _, label), e in zip(fine, errors):
        total[label] = total.get(label, 0) + e
    most = 2**63 - 1
    return sorted(str((i, "".join(f"{k:02x}" for _, k in a), min(e, most), min(total[label], most), digest)) for (i, _, label), a, e in zip(fine, got, errors))


VECTORS = "vec_id bigint, embedding array<double>, label int, codes int, bounds string, vector int, n int, total int, common int, none int, name int"


def vectors(n, width, seed, spread=1.0):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(10 * n), [rnd.choice([round(rnd.gauss(0, spread), 1), rnd.gauss(0, spread)]) for _ in range(width)], rnd.choice([0, 0, 0, 1, 2, None])) for _ in range(n)]
    rows += [(rows[0][0], rows[0][1], 1), (rows[0][0], rows[1][1], 2), rows[5], (None, rows[2][1], None), (7, None, 1), (8, [None] * width, 1), (9, [math.nan] * width, 1), (10, [math.inf] + [0.0] * (width - 1), 1), (11, [], 3), (99999, [1.0] * (width + 4), 3), (-5, [0.0] * width, 1), (100, [0.0] * width, 1)]
    return rows


def coded(spark, rows, **kw):
    table = spark.createDataFrame([(*r, 1, "b", 2, 3, 4, 5, 6, 7) for r in rows], VECTORS).repartition(3)
    return sorted(str(tuple(r)) for r in yinyang.compress(table, **kw).collect())


@pytest.mark.parametrize(("width", "parts", "entries", "rounds"), [(8, 4, 16, 2), (12, 3, 64, 3), (4, 4, 3, 1), (8, 2, 256, 2), (8, 1, 5, 0)])
def test_codes(spark, width, parts, entries, rounds):
    rows = vectors(150, width, width + entries)
    assert coded(spark, rows, parts=parts, entries=entries, rounds=rounds, scale=256) == plain_codes(rows, parts, entries, rounds, 256)


def test_codes_of_very_large_components(spark):
    rows = vectors(60, 8, 5) + [(3, [1e30, -1e30, 1e9, 0.5, 1e15, -3e7, 2.0**60, 1.0], 1), (1, [1e300] * 8, 4), (400, [-1e300] * 8, 4), (401, [6e4] * 8, None)]
    for entries in (4, 64):
        assert coded(spark, rows, parts=2, entries=entries, rounds=2, scale=256) == plain_codes(rows, 2, entries, 2, 256)


def test_codes_of_rare_labels_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(yinyang, "COMMON", 3)
    rows = [(i, v, k % 37 if k % 3 else 5) for k, (i, v, _) in enumerate(vectors(120, 8, 9))]
    assert coded(spark, rows, parts=4, entries=8, rounds=2, scale=256) == plain_codes(rows, 4, 8, 2, 256)
    empty = spark.createDataFrame([], VECTORS)
    assert yinyang.compress(empty).collect() == [] and yinyang.compress(empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert coded(spark, rows[:3], parts=4) == plain_codes(rows[:3], 4, 64, 2, 256)


def test_bounds_pass_groups_by_and_change_nothing():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-2000, 2000, (64, 4))
    x = (centres[rnd.integers(0, 64, 5000)] + rnd.integers(-40, 40, (5000, 4))).astype(float)
    first = centres.astype(float) + rnd.integers(-9, 9, (64, 4))
    book = yinyang.Codebook(first, yinyang.groups(first, 7))
    code, _, bounds = book.begin(x)
    for _ in range(3):
        new = np.array([np.floor(x[code == k].mean(axis=0)) if (code == k).any() else book.entries[k] for k in range(64)])
        book = book.moved(new)
        code, best, bounds, looked = book.go_on(x, code, bounds)
        d = yinyang.squared(x, new)
        assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and looked < 0.35 * 64 * len(x)
        d[np.arange(len(x)), code] = np.inf
        assert all((bounds[:, g] <= np.sqrt(d[:, m].min(axis=1))).all() for g, m in enumerate(book.members))
