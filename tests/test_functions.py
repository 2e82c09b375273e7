"""Column functions against literal behaviours and independent specifications in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import engineering, figures, planning, reports, rules, scores, text
from cairn.functions.access import Principal, clearance_rank, label_rank
from cairn.operators import answers, chunking, evaluation, retrieval, routing
from cairn.operators.code_check import inspected
from cairn.sources import files


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in KINDS(values).items())) if values else spark.range(1)
    return row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def KINDS(values):
    return {k: "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "string" for k, v in values.items()}


def values(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def test_unknown_labels_hide_and_unknown_clearances_see_nothing(spark):
    got = one(spark, label_rank(F.lit("secret")), label_rank(F.lit(None).cast("string")), clearance_rank(F.lit("cosmic")), clearance_rank(F.lit("restricted")))
    assert tuple(got) == (4, 4, -1, 3)


def test_lower_clearance_sees_a_subset(spark):
    rows = spark.createDataFrame([(1, "public", []), (2, "internal", ["ops"]), (3, "restricted", None), (4, "odd", []), (5, None, [])], "id int, classification string, departments array<string>")
    seen = [{r["id"] for r in rows.where(Principal("u", c, frozenset({"ops"})).predicate()).collect()} for c in ("none", "public", "internal", "confidential", "restricted")]
    assert seen == [set(), {1}, {1, 2}, {1, 2}, {1, 2, 3}]


def test_spaces_are_put_back_and_tags_survive(spark):
    cases = {
        "CrudeFeedSurgeDrum": "Crude Feed Surge Drum", "pressure18.0barg": "pressure 18.0 barg", "Drum.Design": "Drum. Design", "survey,down": "survey, down",
        "Equipment:V-1201": "Equipment: V-1201", "U.S.A.": "U.S.A.", "1st 2nd": "1st 2nd", "V-1201 Gr.70 report.pdf": "V-1201 Gr.70 report.pdf", "shortCase": "shortCase",
    }
    assert values(spark, text.restore_spaces, list(cases)) == list(cases.values())


def test_maths_is_plain(spark):
    cases = {r"$\frac{3.3}{6} = 0.55\,\text{mm/year}$": "3.3 / 6 = 0.55 mm/year", r"\( a \times b \)": "a × b", "costs nothing": "costs nothing", r"\sqrt{x} \leq 2": "√(x) ≤ 2"}
    assert values(spark, text.plain_maths, list(cases)) == list(cases.values())


def test_redaction(spark):
    cases = {"mail me at a.b@c.org": "mail me at [REDACTED]", "PAN ABCDE1234F": "PAN [REDACTED]", "1234 5678 9012": "[REDACTED]", "Bearer abcdefghijklmnop123": "Bearer [REDACTED]", "V-1201": "V-1201"}
    assert values(spark, text.redact_text, list(cases)) == list(cases.values())


def test_query_terms(spark):
    got = values(spark, text.query_terms, ["What is the depressurisation rate limit for V-1201?", "the and for", "a b"])
    assert got == [["V-1201", "depressurisation", "rate", "limit"], ["the", "and", "for"], []]


def test_figures(spark):
    got = values(spark, lambda c: F.transform(figures.figures(c), lambda f: f["text"]), ["The vessel V-1201 runs at 18.0 barg [1], not 18.0 barg; 1,200 mm, 7 items, 9.20."])[0]
    assert got == ["18.0 barg", "1,200 mm", "9.20"]
    assert values(spark, figures.normalised, ["1,200", "9.20", "18.0", "7"]) == ["1200", "9.2", "18", "7"]


def test_refusals(spark):
    cases = {
        "The provided documents do not specify the design pressure.": True,
        "The 2023 report does not contain this figure, but the 2029 survey shows the minimum reading at CML-04 is 9.20 mm [2].": False,
        "The design pressure is 18.0 barg [1]. Other sources do not specify it.": False,
        "The document outlines purge criteria [1], but no duration is explicitly stated. The documents do not mention it.": True,
        "": False, "There is not enough information to answer.": True,
    }
    assert values(spark, rules.is_refusal, list(cases)) == list(cases.values())


def test_policy_gate(spark):
    cases = {
        "How do I bypass the high level trip?": "safety_bypass", "What is the relief valve set pressure?": "", "Show me the admin password": "credentials", "how to sabotage the compressor": "sabotage",
        "can we do hot work without a permit": "safety_bypass", "What does the bomb calorimeter measure in the unit?": "", "hack into the historian": "intrusion",
    }
    assert values(spark, lambda c: rules.policy_verdict(c)["category"], list(cases)) == list(cases.values())


def test_routes(spark):
    cases = {
        "Write a python script to parse the csv file": "coding", "hello": None, "Summarise the entire inspection report": "long_ctx",
        "Compare the two exchangers and explain why the duty differs between seasons": "reasoning",
    }
    assert values(spark, lambda c: rules.route(c)["lane"], list(cases)) == list(cases.values())
    forced = one(spark, rules.route(F.lit("what is this"), has_images=F.lit(True)))[0]
    assert (forced["lane"], forced["stage"]) == ("vision", 0)


def test_requested_formats(spark):
    cases = {"Please make a slide deck about V-1201": "artifact.pptx", "export the readings to excel": "artifact.xlsx", "write a report on corrosion": "artifact.docx", "summarise the deck we have": None}
    assert values(spark, rules.requested_format, list(cases)) == list(cases.values())


def test_calculations_refuse(spark):
    got = one(
        spark,
        engineering.corrosion_rate(F.lit(12.5), F.lit(9.2), F.lit(6.0), F.lit(2023.0), F.lit(2029.0)),
        engineering.corrosion_rate(F.lit(12.5), F.lit(9.2), F.lit(4.0), F.lit(2023.0), F.lit(2029.0)),
        engineering.remaining_life(F.lit(9.2), F.lit(8.0), F.lit(0.0)),
        engineering.minimum_thickness(F.lit(300.0), F.lit(500.0), F.lit(138.0)),
        engineering.log_mean_difference(F.lit(30.0), F.lit(30.0)),
        engineering.orifice_flow(F.lit(1.2), F.lit(0.1), F.lit(1000.0), F.lit(900.0)),
    )
    assert got[0]["value"] == pytest.approx(0.55) and got[0]["ok"]
    assert got[1]["refused"] and got[1]["value"] is None
    assert got[2]["value"] == float("inf") and got[3]["refused"] and got[4]["value"] == 30.0 and got[5]["refused"]


def test_quantities(spark):
    assert values(spark, engineering.tidy_quantity, ["3.30 mm/6 year", "6 year(s)", "0.2 mm per year"]) == ["0.55 mm/year", "6 year", "0.2 mm/year"]
    assert one(spark, engineering.convert(F.lit(2.0), F.lit("in"), "mm"), engineering.convert(F.lit(2.0), F.lit("bar"), "mm"))[0:2] == (pytest.approx(50.8), None)


def test_dispatch(spark):
    rows = [
        ("corrosion_rate", {"initial": "12 mm", "Current ": "1 cm", "years": "4 year(s)", "colour": "red"}, (True, False, 0.5, "mm/year")),
        ("corrosion_rate", {"initial": "12 mm"}, (False, False, None, "mm/year")),
        ("remaining_life", {"current": "10 mm", "minimum": "8 mm", "rate": "3.0 mm/6 year"}, (True, False, 4.0, "year")),
        ("minimum_thickness", {"pressure": "900 MPa", "radius": "1 m", "stress": "100 MPa"}, (False, True, None, "mm")),
        ("heat_duty", {"mass_flow": "2 kg/s", "specific_heat": "4.0 kJ/kg/K", "difference": "10 K"}, (True, False, 80.0, "kW")),
        ("heat_duty", {"mass_flow": "2 mm", "specific_heat": "4.0", "difference": "10 K"}, (False, False, None, "kW")),
        ("heat_duty", None, (False, False, None, "kW")),
        ("no such", {"initial": "12 mm"}, (False, False, None, "")),
    ]
    df = spark.createDataFrame([(k, n, raw) for k, (n, raw, _) in enumerate(rows)], "k int, n string, raw map<string,string>").select("k", engineering.dispatch(F.col("n"), F.col("raw")).alias("r"))
    got = {r["k"]: (r["r"]["ok"], r["r"]["refused"], r["r"]["value"] if r["r"]["value"] is None else round(r["r"]["value"], 9), r["r"]["unit"]) for r in df.collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(rows)}


def test_dispatch_names_each_step_once(spark):
    df = spark.createDataFrame([("heat_duty", {"mass_flow": "2 kg/s"})], "n string, raw map<string,string>").select(engineering.dispatch(F.col("n"), F.col("raw")).alias("r"))
    # regular expressions: 73,944 if every step repeats the ones before it
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_") < 1000


def test_readings_beside_a_year(spark):
    lines = F.array(F.lit("V-1201 | CML-04 | 2023 | 12.5"), F.lit("V-1201 | CML-05 | 2023 | 11.0"), F.lit("2023 report"))
    assert one(spark, engineering.readings_beside(lines, F.lit("2023"), F.lit("cml-04")))[0] == ["12.5"]
    r = engineering.readings_beside(lines, F.lit("2023"))
    assert tuple(one(spark, engineering.contradicted(r, F.lit(9.0)), engineering.contradicted(r, F.lit(12.502)))) == (True, False)


def test_signatures(spark):
    rows = [("a.pdf", b"%PDF-1.7 x"), ("b.txt", b"\x89PNG\r\n\x1a\n"), ("c.txt", "plain é".encode()), ("d.csv", b"a,b\n1,2"), ("e", b"\x00\x01"), ("f.docx", b"PK\x03\x04 word/document.xml"), ("g.webp", b"RIFFxxxxWEBP"), ("h.txt", b"")]
    df = spark.createDataFrame(rows, "name string, content binary").select("name", files.sniff(F.col("content"), F.col("name")).alias("s"))
    got = {r["name"]: (r["s"]["mime"], r["s"]["extension_mismatch"]) for r in df.collect()}
    assert got["a.pdf"] == ("application/pdf", False) and got["b.txt"] == ("image/png", True) and got["c.txt"] == ("text/plain", False) and got["d.csv"] == ("text/csv", False)
    assert got["e"][0] == "application/octet-stream" and got["f.docx"][0].endswith("wordprocessingml.document") and got["g.webp"][0] == "image/webp" and got["h.txt"][0] == "application/octet-stream"


def test_heading_stack(spark):
    rnd = random.Random(5)
    rows, expected = [], {}
    for d in range(25):
        stack = []
        for pos in range(20):
            level = rnd.choice([None, None, 1, 2, 3])
            name = f"d{d}p{pos}"
            rows.append((d, pos, "heading" if level else "paragraph", level, name))
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, name))
            else:
                expected[d, pos] = [n for _, n in stack]
    df = spark.createDataFrame(rows, "doc_id bigint, pos bigint, type string, level int, text string")
    got = {(r["doc_id"], r["pos"]): r["section_path"] for r in chunking.section_paths(df, levels=3).collect()}
    assert got == expected


def test_packing_fold(spark):
    est = lambda s: max(1, int(len(s) / 3.6))
    rnd = random.Random(6)
    cases = [[(k, 0, "p", "x" * rnd.randint(1, 30)) for k in range(rnd.randint(1, 25))] for _ in range(20)]

    def spec(blocks, budget, overlap):
        groups, cur = [], []
        for b in blocks:
            if cur and sum(est(x[3]) for x in cur) + est(b[3]) > budget:
                groups.append(cur)
                tail, n = [], 0
                for x in reversed(cur):
                    if n + est(x[3]) > overlap:
                        break
                    tail.insert(0, x)
                    n += est(x[3])
                cur = [*tail, b]
            else:
                cur = [*cur, b]
        return groups + [cur] if cur else groups

    df = spark.createDataFrame(list(enumerate(cases)), "i int, items array<struct<pos:bigint,part:int,type:string,text:string>>")
    for r in df.select("i", chunking.pack(F.col("items"), 12, 4).alias("g")).collect():
        assert [[tuple(b) for b in g] for g in r["g"]] == spec(cases[r["i"]], 12, 4)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_error_rates(spark):
    x, y = text.normalised(F.lit("The surge drum V-1201")), text.normalised(F.lit("the surgedrum v1201"))
    cer, free, f = one(spark, evaluation.character_error_rate(x, y), evaluation.character_error_rate(x, y, False), evaluation.document_errors(x, y))
    assert cer == pytest.approx(1 / 20) and free == 0.0 and f["wer"] == 0.5 and f["cer"] == pytest.approx(1 / 20)
    assert {k: f[k] for k in evaluation.FAULT_KINDS} == {"misread": 0, "one_char": 0, "missing_extra": 0, "spacing": 2, "punctuation": 0} and f["words"] == 4


def test_edit_distance():
    rnd = random.Random(9)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 90))) for _ in "ab")
        if rnd.random() < 0.5:
            b = a[: len(a) // 2] + "x" + a[len(a) // 2 + 1 :]
        assert evaluation.edit_distance(a, b) == plain_distance(a, b) == evaluation.edit_distance(list(b), list(a))


def test_edit_distance_within_a_band(monkeypatch):
    rnd = random.Random(11)
    whole = evaluation.edit_distance
    for n in (200, 700, 2000):
        for edits in (0, 1, 9, n // 20, n // 3):
            a = [rnd.choice("abcdefgh ") for _ in range(n)]
            b = list(a)
            for _ in range(edits):
                k = rnd.randrange(len(b))
                b[k : k + 1] = rnd.choice([[], ["x"], [b[k], "y"]])
            assert whole("".join(a), "".join(b)) == whole(b, a) == plain_distance(a, b)
    # a text with few faults never needs the whole table's columns
    monkeypatch.setattr(evaluation, "_places", lambda a, f=evaluation._places: called.append(len(a)) or f(a))
    called = []
    assert whole("x" + "ab" * 4000 + "y", "z" + "ab" * 2000 + "c" + "ab" * 2000 + "w") == 3 and len(called) == 1


def test_kinds_of_wrong_words(spark):
    cases = [
        ("the pressure was high", "the pressure was hiqh", {"one_char": 1}), ("the pressure was high", "the presure was high", {"misread": 1}), ("pump trip at noon", "pump at noon", {"missing_extra": 1}),
        ("pump at noon", "pump tripped badly at noon", {"missing_extra": 2}), ("re set the relay", "reset the relay", {"spacing": 2}), ("one two three", "four five", {"misread": 3}), ("same words here", "same words here", {}), ("", "words", {}),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string").select("k", evaluation.document_errors("a", "b").alias("f"))
    for r in df.collect():
        assert {n: r["f"][n] for n in evaluation.FAULT_KINDS if r["f"][n]} == cases[r["k"]][2]


def test_validation_report(spark):
    long = "The relief valve was set to twelve bar in the last overhaul"
    cases = {
        1: ("Yes.", 1.0, [], True), 2: (f"{long}.", 0.0, [f"{long}."], False), 3: (f"{long} [1].\n\nThe second claim stands here without any.", 0.5, ["The second claim stands here without any."], False),
        4: ("The documents do not contain the requested figure.", 1.0, [], True), 5: (f"{long}.\n\n[1]", 1.0, [], True), 6: ("", 1.0, [], True), 7: (" ".join([f"{long}."] * 7), 0.0, [f"{long}."] * 5, False),
    }
    df = spark.createDataFrame([(k, c[0], ["chk_x"] if k == 5 else [], ["bad"] if k == 6 else None) for k, c in cases.items()], "answer_id bigint, text string, unresolved array<string>, schema_errors array<string>")
    for r in answers.validate(df).collect():
        _, ratio, unsupported, good = cases[r["answer_id"]]
        assert (r["grounded_ratio"], r["unsupported"]) == (ratio, unsupported)
        assert r["acceptable"] == (good and r["answer_id"] != 6)
        assert r["unresolved_citations"] == (["chk_x"] if r["answer_id"] == 5 else [])


def test_masks_of_every_document(spark, sf):
    import hashlib

    from cairn.plans.catalogue import redacted_documents

    got = {r["doc_id"]: r["redacted"] for r in redacted_documents(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        t = r["text"]
        for pattern, mask in text.MASKS:
            t = re.sub(pattern, mask, t)
        assert got[r["doc_id"]] == hashlib.sha256(t.encode()).hexdigest()


def test_passages_in_texts(spark):
    chunks = spark.createDataFrame([(1, '"foo bar baz qux'), (2, "a foo bar baz"), (3, None), (4, ""), (5, "foo bar bazfoo bar baz")], "chunk_id bigint, text string")
    probes = spark.createDataFrame([(1, "foo bar baz"), (2, "qux"), (3, "foo bar baz"), (4, ""), (5, None)], "probe_id bigint, probe string")
    want = {(1, 1), (1, 3), (1, 2), (2, 1), (2, 3), (5, 1), (5, 3)}
    got = [tuple(r) for r in retrieval.passages(chunks, probes).collect()]
    assert set(got) == want and len(got) == len(want)


def test_breaker(spark):
    events = [(1, k, float(t), ok) for k, (t, ok) in enumerate([(0, False), (10, False), (20, True), (30, False), (200, False), (210, False), (220, False)])]
    got = routing.breaker(spark.createDataFrame(events, "model bigint, seq bigint, at double, ok boolean")).first()
    assert (got["failures"], got["open"]) == (3, True)


def test_markers_are_numbered_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "B first [[cite:CHK_B]]. Then A [1] and (cite:chk_b, chk_x).", ["chk_a", "chk_b"]), (2, "none [9] .", [])], "answer_id bigint, text string, evidence array<string>")
    got = {r["answer_id"]: r for r in answers.resolve_markers(df).collect()}
    assert got[1]["text"] == "B first [1]. Then A [2] and [1]." and got[1]["cited"] == ["chk_b", "chk_a"] and got[1]["unresolved"] == ["chk_x"]
    assert got[2]["text"] == "none." and got[2]["unresolved"] == ["[9]"]


def test_figures_against_sources(spark):
    a = spark.createDataFrame([(1, "It is 9.20 mm and 18 barg.")], "answer_id bigint, text string")
    s = spark.createDataFrame([(1, 1, "reading 9.2 at CML"), (1, 2, "nothing")], "answer_id bigint, n int, text string")
    got = {r["text"]: (r["found"], r["sources"]) for r in answers.verify_figures(a, s).collect()}
    assert got == {"9.20 mm": (True, [1]), "18 barg": (False, [])}


def test_snippets_and_features_match_python(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["compare", "V-1201", "report", "script.py", "18 barg", "why", "numpy", "image"]) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    got = values(spark, rules.prompt_features, texts)
    for t, f in zip(texts, got, strict=True):
        assert f["word_count"] == len(t.split())
        for k, p in rules.FEATURES.items():
            assert f[k] == len(re.findall(p, t)), k
    for t, s in zip(texts, values(spark, text.snippet, texts), strict=True):
        assert s == t or (len(s) <= 241 and s.endswith("…") and t.startswith(s[:-1]))


def test_tiles_cover(spark):
    boxes = one(spark, scores.tiles(F.lit(2200), F.lit(1500)))[0]
    assert {(b["x0"], b["y0"]) for b in boxes} == {(x, y) for x in (0, 896, 1792) for y in (0, 896)}


def test_leaked_json_is_cut_and_its_table_kept(spark):
    body = 'The readings follow:","table":{"headers":["CML","mm"],"rows":[["CML-04",9.2],["CML-05",11]]}'
    got = one(spark, reports.salvage(F.lit(body)), reports.salvage(F.lit("plain prose, with \"quotes\".")))
    assert (got[0]["prose"], got[0]["headers"], got[0]["rows"]) == ("The readings follow:", ["CML", "mm"], [["CML-04", "9.2"], ["CML-05", "11"]])
    assert not got[1]["leaked"] and got[1]["prose"] == 'plain prose, with "quotes".' and got[1]["rows"] == []


def test_report_markers_and_lines(spark):
    got = one(
        spark, reports.checked_markers(F.lit("A [1] and [7] ."), 3), reports.section_trail(F.lit("text"), F.array(F.lit(3), F.lit(1), F.lit(0))),
        reports.reference_line(F.lit(""), F.lit("d1"), F.lit(4), F.array(F.lit("A"), F.lit("B")), F.lit("x" * 150)), text.safe_heading(F.lit("7. Provenance")), text.safe_heading(F.lit("Findings:")),
        reports.slides(F.array(*map(F.lit, range(9)))), reports.cut_rows(F.array(*map(F.lit, range(13)))),
        reports.expectation(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("no data")),
    )
    assert (got[0]["text"], got[0]["cited"], got[0]["unresolved"]) == ("A [1] and.", [1], ["[7]"])
    assert got[1] == "[1][3]" and got[2] == 'd1 — page 4 — A › B. "' + "x" * 140 + '…"'
    assert got[3] == "7. Provenance (as stated in the answer)" and got[4] == "Findings:"
    assert [len(s) for s in got[5]] == [7, 2] and got[6]["omitted"] == 2 and got[7] == "Should refuse — no data"


def test_lines_and_blocks(spark):
    got = values(spark, text.escaped_lines, ['Key:\\n- one\n2. two"}]', ""])
    assert got == [["Key:", "- one", "2. two"], []]
    assert [(b["type"], b["text"]) for b in values(spark, text.body_blocks, ["Key\n- one\n2. two"])[0]] == [("paragraph", "Key"), ("bullet", "one"), ("bullet", "two")]


def test_plans_are_repaired(spark):
    raw = [
        '{"steps":[{"id":"a","intent":"retrieve"},{"intent":"synthesize"},{"intent":"synthesize","tool":"artifact.docx"},{"intent":"tool","tool":"artifact.docx"},{"intent":"tool","tool":"rm"},{"intent":"dance"},{"intent":"synthesize","description":"last"}]}',
        "not json", '{"steps":[{"intent":"retrieve"},{"intent":"synthesize","tool":"null"}]}',
    ]
    ask = ["find it", "x", "write a report on V-1201"]
    df = spark.createDataFrame(list(zip(range(3), raw, ask)), "i int, raw string, ask string")
    got = [r["p"] for r in df.select("i", planning.parse_plan(F.col("raw"), F.array(F.lit("artifact.docx")), F.col("ask")).alias("p")).orderBy("i").collect()]
    assert [(s["intent"], s["tool"]) for s in got[0]["steps"]] == [("retrieve", None), ("tool", "artifact.docx"), ("synthesize", None)] and got[0]["dropped"] == ["rm"] and got[0]["steps"][-1]["description"] == "last"
    assert got[1]["fallback"] and [s["intent"] for s in got[1]["steps"]] == ["retrieve", "synthesize"]
    assert [(s["intent"], s["tool"]) for s in got[2]["steps"]] == [("retrieve", None), ("tool", "artifact.docx"), ("synthesize", None)]


def test_settings_and_hosts(spark):
    env = F.create_map(F.lit("A"), F.lit("x"))
    got = one(spark, planning.expanded(F.lit("${A}"), env), planning.expanded(F.lit("${B:-y}"), env), planning.expanded(F.lit("z"), env), planning.host_of(F.lit("redis://u:p@h:6379/0")), planning.is_private(F.lit("8.8.8.8")), planning.expiry_seconds(F.lit("never")))
    assert tuple(got) == ("x", "y", "z", "h:6379", False, None)


def test_code_is_judged_by_its_syntax():
    assert inspected("import os, json\nos.path.join('a')")[0]
    for bad in ("import socket", "from urllib import request", "exec('x')", "import os\nos.system('x')", "().__class__", "x = ("):
        assert not inspected(bad)[0], bad


def test_coverage_of_answers(spark):
    df = spark.createDataFrame([(1, "The limit is two bar per minute.\n\n[1]\n\nThis one cites nothing at all.\n\n# A heading of many words here"), (2, "Hi [1].")], "answer_id bigint, text string")
    got = {r["answer_id"]: (r["claims"], r["cited"]) for r in answers.coverage(df).collect()}
    assert got == {1: (2, 1)}
    assert {r["answer_id"]: r["grounded_ratio"] for r in answers.validate(df).collect()} == {1: 0.5, 2: 1.0}
