"""Pages from extracted spans, recognised lines and transcriptions [A6-A11, A17-A20, P45, C16, C19, F14]. Reading a PDF, an
image or a model stays outside: what it gives comes in as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scores import block_type, clamp_box, heading_level, is_heading

#: A page of fewer words, or of more image than this, has no usable text layer.
LEAST_WORDS, MOST_IMAGE = 12, 0.55
#: What a transcription's confidence is at most, and its share where something could not be read.
VISION_CAP, ILLEGIBLE = 0.75, 0.7


def body_size(spans: DataFrame, *keys: str) -> DataFrame:
    """The size that most characters of a group have, to a tenth of a point; of equal ones the smaller [A8]. spans: keys, size,
    text."""
    sizes = spans.where("size > 0").groupBy(*keys, F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return sizes.groupBy(*keys).agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body_size"))


def image_coverage(images: DataFrame, *keys: str) -> DataFrame:
    """Share of a page that images cover, 1 at most [A7]. images: keys, x0, y0, x1, y1, width, height."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return images.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(area) / F.max(F.col("width") * F.col("height"))).alias("coverage"))


def page_kinds(spans: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, page, words, coverage, native: whether a page's own text is used [A6]."""
    words = F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))
    text = spans.groupBy("doc_id", "page").agg(F.sum(words).alias("words"))
    j = text.join(image_coverage(images, "doc_id", "page"), ["doc_id", "page"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    return j.withColumn("native", (F.col("words") >= LEAST_WORDS) & (F.col("coverage") <= MOST_IMAGE))


def document_pages(kinds: DataFrame) -> DataFrame:
    """Pages with and without a text layer, and the mean confidence to report: 0 as soon as one has to be read [P45]."""
    return kinds.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("native").alias("native_pages"), F.count_if(~F.col("native")).alias("scanned_pages"), F.when(F.bool_and("native"), 1.0).otherwise(0.0).alias("mean_confidence"))


def classified(blocks: DataFrame) -> DataFrame:
    """type and level of each block, by its size over the page's body [A9-A11]. blocks: doc_id, page, text, size, bold, y0, y1."""
    j = blocks.join(body_size(blocks, "doc_id", "page"), ["doc_id", "page"], "left").withColumn("body_size", F.coalesce("body_size", F.lit(10.0)))
    args = [F.col(c) for c in ("text", "size", "body_size", "bold")]
    level = F.when(is_heading(*args), heading_level(F.col("size") / F.col("body_size")))
    return j.withColumns({"type": block_type(*args, F.col("y0"), F.col("y1")), "level": level})


def recognised(lines: DataFrame) -> DataFrame:
    """Lines of a recogniser as blocks in its order, boxes as shares of the page [A18]. lines: doc_id, page, line, text,
    confidence (0 to 1), x0, y0, x1, y1, width, height."""
    at = lambda c, n: F.col(c) / F.col(n)
    box = clamp_box(at("x0", "width"), at("y0", "height"), at("x1", "width"), at("y1", "height"))
    kept = lines.where(F.trim("text") != "")
    return kept.select("doc_id", "page", F.col("line").alias("order"), F.trim("text").alias("text"), "confidence", box.alias("box"), F.lit("paragraph").alias("type"))


def percent_confidence(lines: DataFrame) -> DataFrame:
    """Lines of an engine that gives percents, -1 where it has none: those go [A19]."""
    return lines.where("confidence >= 0").withColumn("confidence", F.col("confidence") / 100)


def transcribed(text: Column, confidence: Column) -> Column:
    """Paragraphs of a page that a model read, as array<struct<text, confidence>> [A20]."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    sure = F.least(confidence, F.lit(VISION_CAP))
    return F.transform(parts, lambda p: F.struct(p.alias("text"), F.when(F.contains(p, F.lit("[illegible]")), sure * ILLEGIBLE).otherwise(sure).alias("confidence")))


def image_pages(files: DataFrame) -> DataFrame:
    """An image is one page without blocks [A17]. files: path, mime."""
    return files.where(F.col("mime").startswith("image/")).select("path", F.lit(1).alias("page"), F.lit(0).alias("blocks"))


def confirmed_tags(found: DataFrame, recognised_: DataFrame, registry: DataFrame) -> DataFrame:
    """Tags that a model read off a drawing, and what else knows them, dashes aside, in the order of the tags [C16, F14]. All
    have tag; found has doc_id as well, and so does recognised_."""
    bare = lambda c: F.replace(F.upper(c), F.lit("-"), F.lit(""))
    f = found.select("doc_id", "tag", bare(F.col("tag")).alias("k")).distinct()
    o = recognised_.select("doc_id", bare(F.col("tag")).alias("k"), F.lit("ocr").alias("ocr")).distinct()
    r = registry.select(bare(F.col("tag")).alias("k"), F.lit("registry").alias("registry")).distinct()
    by = F.array_compact(F.array("ocr", "registry"))
    return f.join(o, ["doc_id", "k"], "left").join(r, "k", "left").select("doc_id", "tag", by.alias("confirmed_by"))
