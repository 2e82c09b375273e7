"""Sheets and slides from office archives [A13, A14]: files as rows of (path, content), whatever store Spark read them from.

An archive is read by the task that has it; rows of a sheet leave the task as they are parsed, so a file is bounded by the
size that scan() lets through, and its parts by MOST when unpacked.

sheet_rows() gives every row of every sheet, all cells as text, under the names of the first row; rows and columns without
any cell are left out. sheet_blocks() makes of them what is searched: a heading, a table of the first rows and, if there are
more, a caption that says so. slide_blocks() gives the shapes of slides that have text, with their place as shares of the
slide, and the speaker's notes as a caption.

Cases: a file that is no such archive, or whose parts are broken or too large, gives one row of type error with the reason; a
cell without text is null; a column without a name is called by its place; dates are the serial numbers that sheets
hold; null contents give nothing; an empty sheet has no rows and no blocks.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an archive's part when unpacked.
MOST = 500_000_000
SAMPLE = 50


class _Bad(ValueError):
    pass


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(root: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _local(e) in names)


def _value(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in _all(e, "t"))


class _Archive:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as error:
            raise _Bad("not an archive") from error
        self.names = set(self.zip.namelist())

    def xml(self, name: str) -> ElementTree.Element:
        if name not in self.names:
            raise _Bad(f"no part {name}")
        if self.zip.getinfo(name).file_size > MOST:
            raise _Bad(f"part {name} is too large")
        try:
            return ElementTree.fromstring(self.zip.read(name))
        except (ElementTree.ParseError, zipfile.BadZipFile, OSError, EOFError) as error:
            raise _Bad(f"part {name} is broken") from error

    def related(self, name: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, part) of a part's relations."""
        folder, file = posixpath.split(name)
        rels = f"{folder}/_rels/{file}.rels"
        if rels not in self.names:
            return {}
        return {r.attrib["Id"]: (r.attrib.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join("/" + folder, r.attrib["Target"])).lstrip("/")) for r in _all(self.xml(rels), "Relationship")}


def _cells(row: ElementTree.Element, strings: list[str]) -> dict[int, str]:
    out: dict[int, str] = {}
    at = -1
    for c in (e for e in row if _local(e) == "c"):
        letters = re.match("[A-Z]+", c.attrib.get("r", ""))
        at = at + 1
        if letters:
            at = 0
            for x in letters[0]:
                at = at * 26 + ord(x) - 64
            at -= 1
        kind, v = c.attrib.get("t", "n"), next(_all(c, "v"), None)
        text = _text(c) if kind == "inlineStr" else (v.text or "") if v is not None else ""
        if kind == "s" and text:
            text = strings[int(text)]
        elif kind == "b":
            text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
        if text.strip():
            out[at] = text
    return out


def _sheets(content: bytes) -> Iterator[tuple[int, str, int, list[str], list[str | None]]]:
    a = _Archive(content)
    book, related = a.xml("xl/workbook.xml"), a.related("xl/workbook.xml")
    strings = [_text(e) for e in _all(a.xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in a.names else []
    for page, sheet in enumerate(_all(book, "sheet"), 1):
        _, part = related.get(_value(sheet, "id") or "", ("", ""))
        try:
            rows = [cells for row in _all(a.xml(part), "row") if (cells := _cells(row, strings))]
        except (ValueError, IndexError) as error:
            raise _Bad(str(error) if isinstance(error, _Bad) else f"part {part} is broken") from error
        if not rows:
            continue
        head, body = rows[0], rows[1:]
        columns = sorted({k for r in body for k in r})
        names = [head.get(k, f"Unnamed: {k}") for k in columns]
        for n, r in enumerate(body, 1):
            yield page, sheet.attrib.get("name", ""), n, names, [r.get(k) for k in columns]


_ROWS = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("sheet", pa.string()), ("row_no", pa.int64()), ("columns", pa.list_(pa.string())), ("cells", pa.list_(pa.string())), ("error", pa.string())])
_BATCH = 4096


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    columns = list(zip(*held, strict=True)) or [[]] * len(schema)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            if content.is_valid:
                yield path.as_py(), content.as_py()


def sheet_rows(files: DataFrame) -> DataFrame:
    """path, page_no, sheet, row_no (from 1), columns, cells, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, content in _files(batches):
                try:
                    yield from ((path, *r, None) for r in _sheets(content))
                except _Bad as error:
                    yield path, None, None, None, None, None, str(error)

        yield from _batches(rows(), _ROWS)

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, sheet string, row_no bigint, columns array<string>, cells array<string>, error string")


def sheet_blocks(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """path, page_no, pos, type, text of sheets' rows: the rows beyond the sample are counted, not gathered."""
    line = F.array_join("cells", " | ", "")
    sheets = rows.where("error IS NULL").groupBy("path", "page_no", "sheet").agg(
        F.first("columns").alias("columns"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("row_no") <= sample, F.struct("row_no", line.alias("line"))))).alias("lines")
    )
    table = F.concat_ws("\n", F.array_join("columns", " | "), F.transform("lines", lambda x: x["line"]))
    told = F.concat(F.lit("This is a sample of "), F.size("lines").cast("string"), F.lit(" rows from "), F.col("n").cast("string"), F.lit(" total. Query the dataset for complete results rather than reading figures from this sample."))
    block = lambda pos, kind, text: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.array_compact(F.array(block(0, "heading", F.concat(F.lit("Sheet: "), "sheet")), block(1, "table", table), F.when(F.col("n") > sample, block(2, "caption", told))))
    out = sheets.select("path", "page_no", F.explode(blocks).alias("b")).select("path", "page_no", "b.*")
    return out.union(rows.where("error IS NOT NULL").select("path", "page_no", F.lit(0), F.lit("error"), "error"))


def _number(e: ElementTree.Element | None, name: str) -> float:
    try:
        return float(e.attrib.get(name, 0)) if e is not None else 0.0
    except ValueError:
        return 0.0


def _slides(content: bytes) -> Iterator[tuple]:
    a = _Archive(content)
    deck = a.xml("ppt/presentation.xml")
    related = a.related("ppt/presentation.xml")
    size = next(_all(deck, "sldSz"), None)
    width, height = _number(size, "cx") or 9_144_000.0, _number(size, "cy") or 6_858_000.0
    share = lambda x, of: min(1.0, max(0.0, x / of))
    for page, part in enumerate((related[i][1] for s in _all(deck, "sldId") if (i := _relation(s)) in related), 1):
        pos = 0
        for shape in _all(a.xml(part), "sp"):
            text = _paragraphs(shape)
            if not text:
                continue
            kind = next((p.attrib.get("type", "") for p in _all(shape, "ph")), None)
            form = next(_all(shape, "xfrm"), None)
            off, ext = (next(_all(form, n), None) if form is not None else None for n in ("off", "ext"))
            x, y, w, h = _number(off, "x"), _number(off, "y"), _number(ext, "cx"), _number(ext, "cy")
            title = kind in ("title", "ctrTitle")
            yield page, pos, "heading" if title else "paragraph", 1 if title else None, text, share(x, width), share(y, height), share(x + w, width), share(y + h, height)
            pos += 1
        for notes in (p for k, p in a.related(part).values() if k == "notesSlide"):
            said = "\n".join(t for s in _all(a.xml(notes), "sp") if any(p.attrib.get("type") == "body" for p in _all(s, "ph")) and (t := _paragraphs(s)))
            if said:
                yield page, pos, "caption", None, said, 0.0, 0.0, 0.0, 0.0


def _relation(slide: ElementTree.Element) -> str:
    return next((v for k, v in slide.attrib.items() if k.endswith("}id")), "")


def _paragraphs(shape: ElementTree.Element) -> str:
    return "\n".join(_text(p) for p in _all(shape, "p")).strip()


_BLOCKS = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("pos", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("text", pa.string())] + [(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")])


def slide_blocks(files: DataFrame) -> DataFrame:
    """path, page_no, pos, type (heading, paragraph, caption, error), level, text and the box x0, y0, x1, y1 of 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, content in _files(batches):
                try:
                    yield from ((path, *r) for r in _slides(content))
                except _Bad as error:
                    yield path, None, 0, "error", None, str(error), None, None, None, None

        yield from _batches(rows(), _BLOCKS)

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, pos int, type string, level int, text string, x0 double, y0 double, x1 double, y1 double")
