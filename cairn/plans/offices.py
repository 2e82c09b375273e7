"""Queries of office archives, which are made from tables so that SQL knows what is in them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.registry import query
from cairn.sources import office, tables

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def relations(targets: list[tuple[str, str]]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="{_REL}/{kind}" Target="{t}"/>' for k, (kind, t) in enumerate(targets, 1)) + "</Relationships>"


def workbook(sheets: list[tuple[str, list[list[str | None]]]]) -> bytes:
    """Sheets by name and rows; text is shared, numbers are numbers, a null is no cell."""
    strings: dict[str, int] = {}

    def cell(k: int, r: int, v: str | None) -> str:
        at = f"{chr(65 + k)}{r}"
        if v is None:
            return ""
        if v.replace(".", "", 1).isdigit():
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'

    parts = {"xl/workbook.xml": f'<workbook xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n)}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = relations([("worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)])
    for k, (_, rows) in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{k}.xml"] = "<worksheet><sheetData>" + "".join(f'<row r="{r}">{"".join(cell(c, r, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1)) + "</sheetData></worksheet>"
    parts["xl/sharedStrings.xml"] = "<sst>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>"
    return archive(parts)


def deck(slides: list[tuple[str, str, int, str]]) -> bytes:
    """Slides of title, text, place and notes."""
    ns = f'xmlns:a="a" xmlns:p="p" xmlns:r="{_REL}"'
    words = lambda t: "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in t.split("\n"))
    parts = {"ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst>' + "".join(f'<p:sldId id="{255 + k}" r:id="r{k}"/>' for k in range(1, len(slides) + 1)) + '</p:sldIdLst><p:sldSz cx="1000" cy="500"/></p:presentation>'}
    # numbered from the last, so that the order is the relations'
    number = lambda k: len(slides) + 1 - k
    parts["ppt/_rels/presentation.xml.rels"] = relations([("slide", f"slides/slide{number(k)}.xml") for k in range(1, len(slides) + 1)])
    for k, (title, text, place, notes) in enumerate(slides, 1):
        head = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{words(title)}</p:txBody></p:sp>'
        body = f'<p:sp><p:spPr><a:xfrm><a:off x="{place}" y="100"/><a:ext cx="500" cy="600"/></a:xfrm></p:spPr><p:txBody>{words(text)}</p:txBody></p:sp>'
        parts[f"ppt/slides/slide{number(k)}.xml"] = f"<p:sld {ns}><p:cSld><p:spTree>{head}<p:sp><p:txBody><a:p/></p:txBody></p:sp>{body}</p:spTree></p:cSld></p:sld>"
        if notes:
            parts[f"ppt/slides/_rels/slide{number(k)}.xml.rels"] = relations([("notesSlide", f"../notesSlides/n{k}.xml")])
            parts[f"ppt/notesSlides/n{k}.xml"] = f'<p:notes {ns}><p:sp><p:nvSpPr><p:nvPr><p:ph type="sldNum"/></p:nvPr></p:nvSpPr><p:txBody>{words("7")}</p:txBody></p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><p:txBody>{words(notes)}</p:txBody></p:sp></p:notes>'
    return archive(parts)


def _made(rows: DataFrame, make) -> DataFrame:  # noqa: ANN001
    """path and content of a file for each row of path, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [sorted(([x[k] for k in x] for x in xs), key=lambda x: x[0]) for xs in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([make(x) for x in items], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def _books(spark: SparkSession, d: str) -> DataFrame:
    """A workbook for each customer: a sheet of orders, with a column and a row that are empty, and a sheet of nothing."""
    o = tables.table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus", "o_orderpriority").alias("x"))
    rows = o.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path")).agg(F.collect_list("x").alias("items"))

    def book(items: list[list]) -> bytes:
        lines = [[str(k), None, status if k % 5 else None, priority] for k, status, priority in items]
        return workbook([("orders", [["key", "nothing", "status", "priority & kind"], [None] * 4, *lines]), ("blank", [["head"]])])

    return _made(rows, book)


@query(
    """SELECT 'c' || o_custkey AS path, 1 AS page_no, 'orders' AS sheet, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, CASE WHEN bool_or(o_orderkey % 5 <> 0) OVER (PARTITION BY o_custkey) THEN 'key,status,priority & kind' ELSE 'key,priority & kind' END AS columns,
      CASE WHEN bool_or(o_orderkey % 5 <> 0) OVER (PARTITION BY o_custkey) THEN o_orderkey || ',' || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE '-' END || ',' || o_orderpriority ELSE o_orderkey || ',' || o_orderpriority END AS cells FROM orders"""
)
def workbook_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row of workbooks, empty rows and columns dropped"""
    r = office.sheet_rows(_books(spark, d))
    return r.select("path", "page_no", "sheet", "row_no", F.array_join("columns", ",").alias("columns"), F.array_join("cells", ",", "-").alias("cells"))


@query(
    """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'c' || o_custkey AS path, 0 AS pos, 'heading' AS type, 1 AS lines, 13 AS length FROM g UNION ALL SELECT 'c' || o_custkey, 1, 'table', CAST(1 + least(n, 5) AS INTEGER), NULL FROM g
    UNION ALL SELECT 'c' || o_custkey, 2, 'caption', 1, CAST(length('This is a sample of 5 rows from ' || n || ' total. Query the dataset for complete results rather than reading figures from this sample.') AS INTEGER) FROM g WHERE n > 5"""
)
def workbook_blocks(spark: SparkSession, d: str) -> DataFrame:
    """What is searched of workbooks, with samples of five rows"""
    b = office.sheet_blocks(office.sheet_rows(_books(spark, d)), 5)
    return b.select("path", "pos", "type", F.size(F.split("text", "\n")).alias("lines"), F.when(F.col("type") != "table", F.length("text")).alias("length"))


@query(
    """WITH m AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS page_no FROM conversations)
    SELECT 'v' || conv_id AS path, page_no, 0 AS pos, 'heading' AS type, role || ' & co' AS text, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1 FROM m
    UNION ALL SELECT 'v' || conv_id, page_no, 1, 'paragraph', trim(text, chr(10) || ' '), (turn % 8) / 10.0::DOUBLE, 0.2, least(1, (turn % 8 * 100 + 500) / 1000.0::DOUBLE), 1.0 FROM m
    UNION ALL SELECT 'v' || conv_id, page_no, 2, 'caption', 'said in turn ' || turn, 0, 0, 0, 0 FROM m WHERE turn % 2 = 1"""
)
def deck_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as decks, a slide for each turn, with boxes and speaker's notes"""
    m = tables.messages(spark, d).where("content <> ''")
    rows = m.groupBy(F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("path")).agg(F.collect_list(F.struct("turn", "role", "content")).alias("items"))
    files = _made(rows, lambda items: deck([(f"{role} & co", text, turn % 8 * 100, f"said in turn {turn}" if turn % 2 else "") for turn, role, text in items]))
    return office.slide_blocks(files).select("path", "page_no", "pos", "type", "text", "x0", "y0", "x1", "y1")
