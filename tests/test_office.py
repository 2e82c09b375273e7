"""Office archives: broken ones, odd cells, slides in the order of the deck."""

from cairn.plans.offices import archive, deck, relations, workbook
from cairn.sources import office


def files(spark, contents):
    return spark.createDataFrame([(f"f{k}", bytearray(c) if c is not None else None) for k, c in enumerate(contents)], "path string, content binary").repartition(2)


def test_sheets(spark):
    odd = archive({
        "xl/workbook.xml": '<workbook xmlns:r="x"><sheets><sheet name="a" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations([("worksheet", "/xl/worksheets/s.xml")]),
        "xl/worksheets/s.xml": '<worksheet><sheetData><row><c r="B1" t="inlineStr"><is><t>name</t></is></c></row><row><c r="B2" t="b"><v>1</v></c><c r="AA2" t="str"><v>far</v></c></row><row><c><v>0.5</v></c><c t="s"><v></v></c></row></sheetData></worksheet>',
    })
    broken = archive({"xl/workbook.xml": '<workbook xmlns:r="x"><sheets><sheet name="a" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations([("worksheet", "worksheets/s.xml")]), "xl/worksheets/s.xml": "<worksheet><row>"})
    many = workbook([("m", [["k", "v"], *[[str(k), f"x{k}"] for k in range(120)]]), ("one", [["k"], ["1"]])])
    rows = office.sheet_rows(files(spark, [odd, broken, b"no zip", None, archive({"a": "b"}), many, workbook([])]))
    got = {}
    for r in rows.orderBy("path", "page_no", "row_no").collect():
        got.setdefault(r["path"], []).append(r)
    assert [(r["columns"], r["cells"]) for r in got["f0"]] == [(["Unnamed: 0", "name", "Unnamed: 26"], [None, "TRUE", "far"]), (["Unnamed: 0", "name", "Unnamed: 26"], ["0.5", None, None])]
    assert [r["error"] for r in got["f1"]] == ["part xl/worksheets/s.xml is broken"] and [r["error"] for r in got["f2"]] == ["not an archive"] and [r["error"] for r in got["f4"]] == ["no part xl/workbook.xml"]
    assert set(got) == {"f0", "f1", "f2", "f4", "f5"} and len(got["f5"]) == 121
    blocks = {(r["path"], r["page_no"], r["pos"]): (r["type"], r["text"]) for r in office.sheet_blocks(rows).collect()}
    kind, text = blocks["f5", 1, 1]
    assert kind == "table" and text.split("\n") == ["k | v", *[f"{k} | x{k}" for k in range(50)]]
    assert blocks["f5", 1, 2] == ("caption", "This is a sample of 50 rows from 120 total. Query the dataset for complete results rather than reading figures from this sample.")
    assert ("f5", 2, 2) not in blocks and blocks["f5", 2, 0] == ("heading", "Sheet: one") and blocks["f0", 1, 1][1].split("\n")[1] == " | TRUE | far" and blocks["f2", None, 0] == ("error", "not an archive")


def test_slides(spark):
    slides = deck([("First", "one\ntwo", 250, "say this"), ("Second", " \n ", 0, ""), ("Third & last", "far", 900, "")])
    rows = office.slide_blocks(files(spark, [slides, b"", archive({"ppt/presentation.xml": "<p"}), deck([])]))
    got = [tuple(r)[1:] for r in rows.where("path = 'f0'").orderBy("page_no", "pos").collect()]
    assert got == [
        (1, 0, "heading", 1, "First", 0.0, 0.0, 0.0, 0.0), (1, 1, "paragraph", None, "one\ntwo", 0.25, 0.2, 0.75, 1.0), (1, 2, "caption", None, "say this", 0.0, 0.0, 0.0, 0.0),
        (2, 0, "heading", 1, "Second", 0.0, 0.0, 0.0, 0.0), (3, 0, "heading", 1, "Third & last", 0.0, 0.0, 0.0, 0.0), (3, 1, "paragraph", None, "far", 0.9, 0.2, 1.0, 1.0),
    ]
    assert {(r["path"], r["text"]) for r in rows.where("type = 'error'").collect()} == {("f1", "not an archive"), ("f2", "part ppt/presentation.xml is broken")}
