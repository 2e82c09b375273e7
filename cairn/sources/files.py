"""File scans and sinks [2-A]: binary files by content, text, Markdown, mail, tables, JSON lines; content-addressed blobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (offset, signature in hexadecimal, type), the more specific first.
SIGNATURES = (
    (0, "255044462D", "application/pdf"),
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "49492A00", "image/tiff"),
    (0, "4D4D002A", "image/tiff"),
    (0, "424D", "image/bmp"),
    (0, "474946383761", "image/gif"),
    (0, "474946383961", "image/gif"),
    (8, "57454250", "image/webp"),
    (0, "D0CF11E0A1B11AE1", "application/x-ole-storage"),
)
ZIP_STARTS = ("504B0304", "504B0506", "504B0708")
OFFICE = "application/vnd.openxmlformats-officedocument."
#: Archive members that tell office formats apart, and types by extension.
MEMBERS = (("word/document.xml", OFFICE + "wordprocessingml.document"), ("ppt/presentation.xml", OFFICE + "presentationml.presentation"), ("xl/workbook.xml", OFFICE + "spreadsheetml.sheet"))
EXTENSIONS = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff",
    "docx": OFFICE + "wordprocessingml.document", "pptx": OFFICE + "presentationml.presentation", "xlsx": OFFICE + "spreadsheetml.sheet",
    "csv": "text/csv", "txt": "text/plain", "md": "text/plain", "eml": "message/rfc822",
}


def signature(content: Column) -> Column:
    """Type by magic bytes, null if none [A2]; archives are told apart by the names of their members, which stand in
    clear text in them, whole or cut [A3]."""
    out = F.lit(None).cast("string")
    office = F.lit("application/zip")
    for name, mime in reversed(MEMBERS):
        office = F.when(F.contains(content, F.lit(name.encode())), mime).otherwise(office)
    start = F.hex(F.substring(content, 1, 4))
    out = F.when(start.isin(*ZIP_STARTS), office)
    for offset, sign, mime in reversed(SIGNATURES):
        out = F.when(F.hex(F.substring(content, offset + 1, len(sign) // 2)) == sign, mime).otherwise(out)
    return out


def looks_like_text(content: Column, sample: int = 4096) -> Column:
    """Non-empty, valid UTF-8 without NUL and with less than 1 % control characters in the sample [A4]. A character cut at
    the sample's end does not count against it."""
    head = F.substring(content, 1, sample)
    text = F.try_validate_utf8(head.cast("string"))
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(content, 1, sample - k).cast("string")) for k in range(4)])
    text = F.when(F.length(content) > sample, whole).otherwise(text)
    control = F.length(F.regexp_replace(text, r"[^\x01-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.coalesce((F.length(head) > 0) & ~F.contains(text, F.lit("\x00")) & (control / F.length(text) < 0.01), F.lit(False))


def sniff(content: Column, name: Column) -> Column:
    """struct<mime, extension_mismatch, detail> [A1]."""
    hint = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    text = F.when(looks_like_text(content), F.when(hint.isin("text/csv", "message/rfc822"), hint).otherwise("text/plain"))
    mime = F.coalesce(signature(content), text, F.lit("application/octet-stream"))
    off = F.coalesce((hint != mime) & (mime != "application/octet-stream"), F.lit(False))
    return F.struct(
        mime.alias("mime"), off.alias("extension_mismatch"),
        F.when(mime == "application/octet-stream", "no recognised file signature").when(off, F.concat(F.lit("content is "), mime, F.lit(" but the filename suggests "), hint)).otherwise("").alias("detail"),
    )


def scan(spark: SparkSession, path: str, max_bytes: int = 200_000_000) -> DataFrame:
    """Files by content: path, name, content, sha256 and what they are; larger ones have no content [A1, A5, B26]."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return f.withColumn("too_large", F.col("length") > max_bytes).select("path", name.alias("name"), "length", "too_large", F.when(~F.col("too_large"), F.col("content")).alias("content"), F.sha2("content", 256).alias("sha256")).withColumn("kind", sniff(F.col("content"), F.col("name")))


def _mail(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import email
    from email import policy

    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"], strict=True):
            m = email.message_from_bytes(bytes(content), policy=policy.default)
            body = m.get_body(preferencelist=("plain", "html"))
            rows.append((path, str(m["from"] or ""), str(m["to"] or ""), str(m["subject"] or ""), str(m["date"] or ""), body.get_content() if body else ""))
        yield pd.DataFrame(rows, columns=["path", "sender", "recipient", "subject", "sent", "text"])


def mails(files: DataFrame) -> DataFrame:
    """Headers and the plain body, else the HTML one [A16]."""
    return files.select("path", "content").mapInPandas(_mail, "path string, sender string, recipient string, subject string, sent string, text string")


def _office(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paragraphs and table rows of word documents, and text of slides, from the archive's XML."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    words_of = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
    for f in frames:
        rows = []
        for path, content in zip(f["path"], f["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
                if "word/document.xml" in z.namelist():
                    body = ElementTree.fromstring(z.read("word/document.xml"))
                    k = 0
                    for e in next(iter(body)):
                        if local(e) == "p":
                            style = next((v for s in e.iter() if local(s) == "pStyle" for n, v in s.attrib.items() if n.endswith("val")), "")
                            level = re.search(r"(?i)heading\s*(\d)", style)
                            rows.append((path, 1, k, "heading" if level else "paragraph", int(level[1]) if level else None, words_of(e)))
                            k += 1
                        elif local(e) == "tbl":
                            table = [" | ".join(words_of(c) for c in r if local(c) == "tc") for r in e if local(r) == "tr"]
                            rows.append((path, 1, k, "table", None, "\n".join(table)))
                            k += 1
                for page, n in enumerate(slides, 1):
                    root = ElementTree.fromstring(z.read(n))
                    for k, shape in enumerate(e for e in root.iter() if local(e) == "sp"):
                        rows.append((path, page, k, "paragraph", None, "\n".join(words_of(p) for p in shape.iter() if local(p) == "p")))
        yield pd.DataFrame(rows, columns=["path", "page_no", "pos", "type", "level", "text"]).astype({"level": "Int64"})


def office_blocks(files: DataFrame) -> DataFrame:
    """path, page_no, pos, type, level, text of word documents and slides [A12, A13]."""
    return files.select("path", "content").mapInPandas(_office, "path string, page_no bigint, pos bigint, type string, level bigint, text string").where(F.trim("text") != "")


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A spreadsheet's export, all columns as text, rows that are empty dropped [A14]."""
    rows = spark.read.option("header", "true").option("inferSchema", "false").option("sep", sep).csv(path)
    return rows.dropna("all")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON lines file; blank and broken lines are left out [A25, A26]."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def put_blobs(files: DataFrame, path: str, existing: DataFrame | None = None) -> DataFrame:
    """New contents under their hash, in folders by its first two characters; what is there is not written again
    [A22, A24, G7]. Returns what was new."""
    new = files.dropDuplicates(["sha256"]).select("sha256", "content")
    if existing is not None:
        new = new.join(existing.select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
    return new.select("sha256")


def verify_blobs(blobs: DataFrame) -> DataFrame:
    """sha256 and whether the content still has it [A23]."""
    return blobs.select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("intact"))


def write_log(events: DataFrame, path: str) -> None:
    """Canonical JSON lines in the order of seq [A29]."""
    columns = sorted(events.columns)
    events.orderBy("seq").select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def html_text(html: Column) -> Column:
    """Text of a web page: scripts, styles and comments dropped, blocks on lines of their own, the common entities
    decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer)\b[^>]*>", "\n")
    text = F.regexp_replace(lines, r"<[^>]+>", "")
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n\t\r"))
