"""The kept text index against brute force, and stems against published pairs."""

import itertools
import random

import numpy as np
import pytest

from cairn.functions.access import Principal
from cairn.functions.stems import stem
from cairn.functions.text import STOP_WORDS
from cairn.operators import postings

#: Words and stems of the published algorithm.
PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consolation consol consolatory consolatori console consol consolidate consolid consolidating consolid consolingly consol consonant conson
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir constable constabl constancy constanc constant constant knack knack
knackeries knackeri knaves knave knavish knavish kneaded knead kneading knead knee knee knees knee kneel kneel kneeling kneel knelt knelt knife knife knightly knight
knitted knit knitting knit knives knive knockers knocker knopp knopp knots knot generate generat general general generously generous communication communic
hopping hop hoping hope happy happi cry cri by by say say ties tie cries cri gas gas gaps gap kiwis kiwi luxuriated luxuri agreed agre feed feed relational relat
dying die news news proceeding proceed skies sky fluently fluentli triplicate triplic hopefulness hope formative format adoption adopt controlling control roll roll
falling fall cease ceas rate rate bed bed shred shred youth youth boy boy o'neill's o'neil valves valv inspections inspect maintenance mainten p-101a p-101a 42 42""".split()


def test_stems():
    for word, want in zip(PAIRS[::2], PAIRS[1::2], strict=True):
        assert stem(word) == want, word


def test_numbers_as_bytes():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2_000_000, 2**31, 2**34, 2**63, 2**64 - 1], np.uint64)
    data, sizes = postings.packed(values)
    assert postings.unpacked(data.tobytes()).tolist() == values.tolist() and sizes.sum() == len(data) and sizes[-1] == 10
    assert postings.unpacked(b"").tolist() == []
    signed = np.array([0, -1, 1, 2**63 - 1, -(2**63), 77])
    assert postings._unsigned(postings._signed(signed)).tolist() == signed.tolist()


WORDS = ["pump", "pumps", "valve", "valves", "the", "of", "and", "inspection", "inspected", "v-101", "seal", "a1"]


def passages(n=90, seed=4):
    rnd = random.Random(seed)
    rows = [(k, " ".join(rnd.choice(WORDS[: 3 if k % 3 == 0 else None]) + rnd.choice(["", ",", ".", "\n"]) for _ in range(rnd.randint(1, 60))), rnd.choice(["public", "restricted"]), rnd.choice([[], ["ops"], ["finance"]]), 0.5) for k in range(n)]
    rows += [(n, None, "public", [], 0.5), (n + 1, "", "public", [], 0.5), (n + 2, "... !", "public", [], None), (None, "pump valve", "public", [], 0.5), (n + 3, "Pump " * 900 + "VALVE", "public", [], 0.5), (n + 4, "x " * 70_000 + "pump of valve", "public", [], 0.9)]
    return rows


QUERIES = [(1, "pump"), (2, "valves of the pump"), (3, "pump pump valve"), (4, "the"), (5, ""), (6, None), (7, "V-101 seal a1"), (8, "inspection of pumps and valves"), (9, "nowhere pump"), (10, "pump valve"), (11, "pump the valve")]


def spec(rows, queries, mode, stems, seen):
    """Every span of every passage is looked at."""

    def terms(text):
        found = postings._WORDS.findall((text or "").lower())
        return [("" if w in STOP_WORDS else stem(w)) if stems else w for w in found]

    out = []
    for q, text in queries:
        asked = [(k, t) for k, t in enumerate(terms(text)) if t]
        hits = []
        for key, body, label, departments, _ in rows:
            if key is None or not asked or not seen(label, departments):
                continue
            words = terms(body)
            at = [(p, w) for p, w in enumerate(words) if w in {t for _, t in asked}]
            if mode == "any":
                score = 0.1 * len(at)
            elif mode == "phrase":
                first, span = asked[0][0], asked[-1][0] - asked[0][0]
                n = sum(all(0 <= p + k - first < len(words) and words[p + k - first] == t for k, t in asked) for p, _ in at)
                score = n * 0.1 / (1 + span + 1 - len(asked))
            else:
                score, need = 0.0, {t for _, t in asked}
                for i, j in itertools.combinations_with_replacement(range(len(at)), 2) if len(at) < 200 else ():
                    inside = {w for _, w in at[i : j + 1]}
                    if inside == need and {w for _, w in at[i + 1 : j + 1]} != need and {w for _, w in at[i:j]} != need:
                        score += 0.1 / (1 + at[j][0] - at[i][0] - (j - i))
                if len(at) >= 200:
                    score = {1: 0.1 * len(at), 2: 0.1}.get(len(need), 0.0) if {w for _, w in at} == need else 0.0
            if score:
                hits.append((-round(score, 6), key))
        out += [(q, key, -s, k + 1) for k, (s, key) in enumerate(sorted(hits)[:7])]
    return sorted(out)


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in passages()], "chunk_id bigint, text string, classification string, departments array<string>, mean_confidence double, tf int, term string, bucket int").repartition(3)


@pytest.fixture(scope="module", params=[(True, 500), (False, 1 << 30)])
def index(request, spark, chunks, tmp_path_factory):
    stems, flush = request.param
    return stems, postings.write_index(chunks, str(tmp_path_factory.mktemp("index") / "i"), stems, 16, flush)


@pytest.mark.parametrize("mode", ["any", "all", "phrase"])
def test_search(spark, index, mode):
    stems, rows = index
    queries = spark.createDataFrame(QUERIES, "query_id bigint, text string")
    for who, seen in ((None, lambda c, d: True), (Principal("u", "internal", frozenset({"ops"})), lambda c, d: c == "public" and (not d or "ops" in d))):
        got = postings.search(queries, rows, who, mode, 7)
        assert sorted((r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in got.collect()) == spec(passages(), QUERIES, mode, stems, seen)


def test_many_access_classes_and_repeated_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "CLASSES", 2)
    rows = [(5, "pump valve", "public", [], 1.0), (5, "pump valve", "public", [], 1.0), (6, "pump valve", "restricted", [], 1.0), (-(2**63), "pump", None, None, 1.0), (2**63 - 1, "pump x valve", "public", ["ops"], 1.0), (7, "pump", "public", ["safety"], 1.0)]
    table = spark.createDataFrame(rows, "chunk_id bigint, text string, classification string, departments array<string>, mean_confidence double")
    index, queries = postings.write_index(table, str(tmp_path / "i")), spark.createDataFrame(QUERIES[9:10], "query_id bigint, text string")
    who = Principal("u", "internal", frozenset({"ops"}))
    assert [(r["chunk_id"], r["score"]) for r in postings.search(queries, index, who, "all").orderBy("rank").collect()] == [(5, 0.1), (2**63 - 1, 0.05)]
    assert [(r["chunk_id"], r["score"]) for r in postings.search(queries, index, who).orderBy("rank").collect()] == [(5, 0.4), (2**63 - 1, 0.2)]
    assert [r["chunk_id"] for r in postings.search(queries, index).orderBy("rank").collect()] == [5, 6, 2**63 - 1, -(2**63), 7]


def test_many_terms_are_found_by_bucket(spark, index, monkeypatch):
    stems, rows = index
    queries = spark.createDataFrame(QUERIES, "query_id bigint, text string")
    want = sorted(map(str, postings.search(queries, rows).collect()))
    monkeypatch.setattr(postings, "NAMED", 1)
    assert sorted(map(str, postings.search(queries, rows).collect())) == want


def test_only_the_buckets_of_the_terms_are_read(spark, chunks, tmp_path):
    rows = postings.write_index(chunks, str(tmp_path / "i"), buckets=16)
    query = spark.createDataFrame([(1, "seal")], "query_id bigint, text string")
    want = sorted(map(str, postings.search(query, rows).collect()))
    own = rows.rows.where("term = 'seal'").select("bucket").first()[0]
    others = [p for p in (tmp_path / "i" / "postings").glob("bucket=*/*.parquet") if f"bucket={own}/" not in str(p)]
    for p in others:
        p.write_bytes(b"not a table")
        p.with_name(f".{p.name}.crc").unlink()
    spark.catalog.clearCache()
    assert want and len(others) > 3
    assert sorted(map(str, postings.search(query, postings.Index(spark, str(tmp_path / "i"), buckets=16)).collect())) == want


def test_nothing(spark, chunks, tmp_path):
    rows = postings.write_index(chunks.limit(0), str(tmp_path / "i"))
    assert postings.search(spark.createDataFrame(QUERIES, "query_id bigint, text string"), rows).collect() == []
    assert rows.rows.count() == 0


def test_only_open_queries_are_asked_again(spark):
    from cairn.operators import retrieval

    asked = []

    def by(found):
        def search(queries):
            asked.append(sorted(r["query_id"] for r in queries.select("query_id").collect()))
            rows = [(q, c, s) for q, c, s in found if q in asked[-1]]
            return spark.createDataFrame(rows, "query_id bigint, chunk_id bigint, score double")

        return search

    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "query_id bigint, text string")
    first = by([(1, 10, 0.5), (1, 11, 0.4), (2, 20, 0.3)])
    second = by([(1, 99, 9.0), (2, 20, 0.7), (2, 21, 0.1), (3, 30, 0.2)])
    got = retrieval.until_sufficient(queries, [first, second, by([(3, 30, 0.1), (4, 40, 0.1), (4, 40, 0.6)]), by([])], enough=2)
    assert asked == [[1, 2, 3, 4], [2, 3, 4], [3, 4], [3, 4]]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 10, 0.5, 1), (1, 1, 11, 0.4, 2), (2, 2, 20, 0.7, 1), (2, 2, 21, 0.1, 2), (3, 4, 30, 0.2, 1), (4, 4, 40, 0.6, 1)]
    asked.clear()
    retrieval.until_sufficient(queries.where("query_id < 3"), [first, second, by([])], enough=1)
    assert asked == [[1, 2]]
