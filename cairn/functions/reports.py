"""Reports and prompts as Columns: leaked JSON, markers, reference and provenance lines, cells [H18, H25-H29, H32, H33, A36, P29, P35, P37]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEAK = r"""(?i)"\s*,\s*"[a-z_]{2,20}"\s*:"""
_CELL = r'"([^"]*)"|(-?\d+(?:\.\d+)?)'


def _cells(raw: Column) -> Column:
    return F.transform(F.arrays_zip(F.regexp_extract_all(raw, F.lit(_CELL), F.lit(1)).alias("q"), F.regexp_extract_all(raw, F.lit(_CELL), F.lit(2)).alias("n")), lambda c: F.when(c["q"] != "", c["q"]).otherwise(c["n"]))


def salvage(body: Column) -> Column:
    """struct<leaked, prose, headers, rows>: prose cut where the JSON around it leaked in, and the table that leaked with it
    [H25]."""
    text = F.replace(body, F.lit("\\/"), F.lit("/"))
    at = F.regexp_instr(text, F.lit(_LEAK))
    rest = F.substr(text, F.greatest(at, F.lit(1)))
    prose = F.rtrim(F.rtrim(F.rtrim(F.left(text, F.greatest(at - 1, F.lit(0)))), F.lit(",")))
    headers = F.filter(_cells(F.regexp_extract(rest, r'(?s)"headers"\s*:\s*\[(.*?)\]', 1)), lambda c: c != "")
    rows = F.transform(F.regexp_extract_all(F.regexp_extract(rest, r'(?s)"rows"\s*:\s*\[\s*(\[.*?\])\s*\]', 1), F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), _cells)
    none = F.array().cast("array<string>")
    return F.struct(
        (at > 0).alias("leaked"),
        F.when(at > 0, prose).otherwise(body).alias("prose"),
        F.when(at > 0, headers).otherwise(none).alias("headers"),
        F.when(at > 0, F.filter(rows, lambda r: F.size(r) > 0)).otherwise(F.array().cast("array<array<string>>")).alias("rows"),
    )


def section_trail(text: Column, sources: Column) -> Column:
    """The markers for a section that has none of its own [H26]."""
    good = F.array_sort(F.array_distinct(F.filter(sources, lambda n: n > 0)))
    return F.when(text.rlike(r"\[\d{1,2}\]"), "").otherwise(F.array_join(F.transform(good, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))


def checked_markers(text: Column, sources: int) -> Column:
    """struct<text, cited, unresolved>: markers beyond the sources removed and told [H27]."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))
    bad = F.array_distinct(F.filter(numbers, lambda n: ~n.between(1, sources)))
    clean = F.aggregate(bad, text, lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(clean, r"\s+([.,;:!?])", "$1"), r"[ \t]{2,}", " "))
    return F.struct(tidy.alias("text"), F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, sources)))).alias("cited"), F.transform(F.filter(numbers, lambda n: ~n.between(1, sources)), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))).alias("unresolved"))


def reference_line(title: Column, document: Column, page: Column, section_path: Column, snippet: Column) -> Column:
    """Where a cited passage is [H28]."""
    parts = F.array_join(F.array_compact(F.array(F.coalesce(F.nullif(title, F.lit("")), document), F.concat(F.lit("page "), page.cast("string")), F.when(F.size(section_path) > 0, F.array_join(section_path, " › ")))), " — ")
    s = F.trim(F.coalesce(snippet, F.lit("")))
    return F.when(s == "", parts).otherwise(F.concat(parts, F.lit('. "'), F.left(s, F.lit(140)), F.when(F.length(s) > 140, "…").otherwise(""), F.lit('"')))


def prompt_block(index: Column, key: Column, title: Column, first: Column, last: Column, section_path: Column, confidence: Column, text: Column) -> Column:
    """A passage for a prompt, between marks that set it off as quoted matter [H18]."""
    lo, hi = F.least(first, last), F.greatest(first, last)
    where = F.when(lo == hi, F.concat(F.lit("page "), lo.cast("string"))).otherwise(F.concat(F.lit("pages "), lo.cast("string"), F.lit("-"), hi.cast("string")))
    head = F.array_join(
        F.array_compact(F.array(F.concat(F.lit("["), index.cast("string"), F.lit("] "), title), where, F.when(F.size(section_path) > 0, F.array_join(section_path, " > ")), F.when(confidence < 0.8, F.concat(F.lit("OCR confidence "), F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("%"))))), " — "
    )
    return F.concat(F.lit('<source id="'), key.cast("string"), F.lit('">\n'), head, F.lit("\n"), F.trim(text), F.lit("\n</source>"))


def evidence_prompt(hits: DataFrame, cap: int = 8) -> DataFrame:
    """The blocks of each query's best passages, one text [H18, F17, P29]. hits: query_id, chunk_id, rank, title, text,
    mean_confidence."""
    none = F.array().cast("array<string>")
    block = prompt_block(F.col("rank"), F.col("chunk_id"), F.col("title"), F.lit(1), F.lit(1), none, F.col("mean_confidence"), F.col("text"))
    got = hits.where(F.col("rank") <= cap).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return got.select("query_id", F.concat(F.lit("<sources>\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"), F.lit("\n</sources>")).alias("prompt"))


def source_line(title: Column, pages: Column, confidence: Column) -> Column:
    """A provenance line: title, pages, and a warning for text read with little confidence [H29]."""
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    warning = F.when(confidence < 0.85, F.concat(F.lit("  [text recognised from a scan at "), F.bround(confidence * 100, 0).cast("int").cast("string"), F.lit("% confidence — verify against the original]"))).otherwise("")
    return F.concat(title, F.when(F.size(pages) > 1, " — pages ").otherwise(" — page "), listed, warning)


def expectation(answerable: Column, document: Column, phrase: Column, lane: Column, note: Column) -> Column:
    """What an evaluation case should do, in a sentence [H33]."""
    p, d, n = (F.trim(F.coalesce(c, F.lit(""))) for c in (phrase, document, note))
    retrieve = F.concat(F.when(d != "", F.concat(F.lit("Should retrieve "), d)).otherwise("Should retrieve the right passage"), F.when(p != "", F.concat(F.lit(', containing "'), p, F.lit('"'))).otherwise(""))
    return (
        F.when(~answerable, F.when(n != "", F.concat(F.lit("Should refuse — "), n)).otherwise("Should refuse: the corpus cannot support it"))
        .when(answerable, F.when(p != "", F.concat(F.lit('Should answer, mentioning "'), p, F.lit('"'))).otherwise("Should answer from the corpus"))
        .when(document.isNotNull() | phrase.isNotNull(), retrieve)
        .when(lane.isNotNull(), F.concat(F.lit("Should route to the "), lane, F.lit(" lane")))
        .otherwise(F.coalesce(note, F.lit("")))
    )


def cells(rows: DataFrame, key: str, columns: list[str], formulas: dict[str, str] | None = None) -> DataFrame:
    """The cell grid of a workbook [A36, P35, J22]: key, row, col, kind, text, number. Row 1 is the header; numbers written as
    text become numbers; {row} in a formula is the cell's row."""
    w = Window.partitionBy(key).orderBy(*columns)
    made = rows.withColumn("__row", F.row_number().over(w) + 1)

    def cell(k: int, name: str) -> Column:
        raw = F.col(name).cast("string")
        number = F.regexp_replace(F.trim(raw), ",", "").try_cast("double")
        return F.struct(F.lit(k).alias("col"), F.when(number.isNotNull(), "number").otherwise("text").alias("kind"), F.when(number.isNull(), raw).alias("text"), number.alias("number"))

    made_cells = [cell(k, c) for k, c in enumerate(columns, 1)]
    for k, (_, f) in enumerate((formulas or {}).items(), len(columns) + 1):
        made_cells.append(F.struct(F.lit(k).alias("col"), F.lit("formula").alias("kind"), F.replace(F.lit(f), F.lit("{row}"), F.col("__row").cast("string")).alias("text"), F.lit(None).cast("double").alias("number")))
    return made.select(key, F.col("__row").alias("row"), F.explode(F.array(*made_cells)).alias("c")).select(key, "row", "c.*")


def slides(items: Column, per: int = 7) -> Column:
    """Bullets in slides of so many [F16]."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(items)), F.lit(per)), lambda i: i <= F.size(items))
    return F.transform(starts, lambda i: F.slice(items, i, per))


def cut_rows(rows: Column, most: int = 11) -> Column:
    """struct<rows, omitted> [F16]."""
    return F.struct(F.slice(rows, 1, most).alias("rows"), F.greatest(F.lit(0), F.size(rows) - most).alias("omitted"))


def parameter_text(names: Column, units: Column) -> Column:
    """[H32]"""
    return F.array_join(F.zip_with(names, units, lambda n, u: F.concat(n, F.lit(" ("), u, F.lit(")"))), ", ")
