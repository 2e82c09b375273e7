"""Checks of answers against their evidence [2-N6..N10, C11-C14, D28, D29, E14, E17, H16, H27, P32]."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.figures import figures, near_any, numbers
from cairn.functions.rules import is_refusal


def verify_figures(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Each measurement of an answer and the citations whose passage has its value [C14, H14, D29]. answers: answer_id,
    text; sources: answer_id, n, text. Values are joined by equality on the answer and the number."""
    asked = answers.select("answer_id", F.posexplode(figures(F.col("text"))).alias("pos", "f")).select("answer_id", F.col("pos").cast("long").alias("pos"), "f.*")
    held = sources.select("answer_id", "n", F.explode(numbers(F.col("text"))).alias("value")).distinct()
    found = asked.select("answer_id", "value").distinct().join(held, ["answer_id", "value"]).groupBy("answer_id", "value").agg(F.array_sort(F.collect_set("n")).alias("sources"))
    return asked.join(found, ["answer_id", "value"], "left").select("answer_id", "pos", "text", "value", "unit", F.col("sources").isNotNull().alias("found"), F.coalesce("sources", F.array().cast("array<int>")).alias("sources"))


#: Citation markers, what parts the ids in one, and the tags of quoted sources.
_MARKER = r"(?is)[\[\(]{1,2}\s*cite\s*:\s*(?P<ids>.+?)\s*[\]\)]{1,2}|\[{1,2}\s*(?P<ordinal>\d{1,2})\s*\]{1,2}"
_PARTS = r"(?i)[,;\s]+|[\]\)]\s*[\[\(]\s*cite\s*:\s*"
_SOURCE_TAG = r"</?source[^>]*>"
_RESOLVED = "answer_id bigint, text string, cited array<string>, unresolved array<string>"


def resolve_markers(answers: DataFrame) -> DataFrame:
    """Markers rewritten to [n] by first appearance; what names no passage is dropped and told [C12, C13, E14, H16].
    answers: answer_id, text, evidence array<string> of passage ids in order. A rewriting by a function of the match is
    beyond regexp_replace, so it runs over Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        marker, cut = re.compile(_MARKER), re.compile(_PARTS)
        for f in frames:
            rows = []
            for answer_id, text, evidence in zip(f["answer_id"], f["text"], f["evidence"], strict=True):
                ids = [] if evidence is None else list(evidence)
                known, order, lost = {i.casefold(): i for i in ids}, {}, []

                def number(i: str) -> str:
                    return f"[{order.setdefault(i, len(order) + 1)}]"  # noqa: B023

                def one(m: re.Match) -> str:
                    if m["ordinal"]:
                        at = int(m["ordinal"])
                        if 1 <= at <= len(ids):  # noqa: B023
                            return number(ids[at - 1])  # noqa: B023
                        lost.append(m[0])  # noqa: B023
                        return ""
                    out = ""
                    for t in cut.split(m["ids"]):
                        t = re.sub(r"(?i)^cite:\s*", "", t.strip().strip("[]()"))
                        if t and t.casefold() in known:  # noqa: B023
                            out += number(known[t.casefold()])  # noqa: B023
                        elif t:
                            lost.append(t)  # noqa: B023
                    return out

                done = re.sub(r"[ \t]{2,}", " ", re.sub(r"\s+([.,;:!?])", r"\1", marker.sub(one, re.sub(_SOURCE_TAG, "", text or "")))).strip()
                rows.append((answer_id, done, list(order), lost))
            yield pd.DataFrame(rows, columns=["answer_id", "text", "cited", "unresolved"])

    return answers.select("answer_id", "text", "evidence").mapInPandas(run, _RESOLVED)


def _claims(answers: DataFrame) -> DataFrame:
    """answer_id, g, claim, cited: an answer's claims in order. Paragraphs of four words or more are claims, headings are
    not; a paragraph of markers alone belongs to the one before it [E17]."""
    parts = answers.select("answer_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "p")).where(F.trim("p") != "")
    bare = F.trim(F.regexp_replace("p", r"\[\d+\]", ""))
    w = Window.partitionBy("answer_id").orderBy("pos")
    runs = parts.withColumn("g", F.sum(F.when((bare != "") | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))
    claims = runs.groupBy("answer_id", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: F.trim(x["p"])), " ").alias("claim"))
    body = F.trim(F.regexp_replace("claim", r"\[\d+\]", ""))
    return claims.where(~body.startswith("#") & (F.regexp_count(body, F.lit("[A-Za-z][A-Za-z'-]*")) >= 4)).withColumn("cited", F.col("claim").rlike(r"\[\d+\]"))


def coverage(answers: DataFrame) -> DataFrame:
    """Share of an answer's claims that carry a citation, and the first five that don't, cut to 200 characters [D28]. Answers
    without a claim are no rows."""
    bare = F.array_sort(F.collect_list(F.when(~F.col("cited"), F.struct("g", F.substring("claim", 1, 200).alias("claim")))))
    out = _claims(answers).groupBy("answer_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("cited").alias("cited"), F.transform(F.slice(bare, 1, 5), lambda x: x["claim"]).alias("uncited"))
    return out.withColumn("ratio", F.round(F.col("cited") / F.col("claims"), 10))


def validate(answers: DataFrame) -> DataFrame:
    """The report on each answer [N9, N10]. answers: answer_id, text, and optionally unresolved and schema_errors (arrays of
    strings). A refusal is grounded; so is an answer without a sentence of more than 25 characters, which asserts nothing; an
    answer of substance without a citation is not, and its first five sentences are unsupported; others by their coverage.
    Acceptable: no schema errors, and a refusal or a ratio from 0.8 on."""
    none = F.array().cast("array<string>")
    has = lambda c: F.coalesce(F.col(c), none) if c in answers.columns else none
    long = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 25)
    features = answers.select("answer_id", is_refusal(F.col("text")).alias("refusal"), long.alias("long"), F.col("text").rlike(r"\[\d+\]").alias("cites"), has("unresolved").alias("unresolved_citations"), has("schema_errors").alias("schema_errors"))
    j = features.join(coverage(answers).select("answer_id", "ratio", "uncited"), "answer_id", "left")
    easy, bare = F.col("refusal") | (F.size("long") == 0), ~F.col("cites")
    out = j.withColumns(
        {
            "grounded_ratio": F.when(easy, 1.0).when(bare, 0.0).otherwise(F.coalesce("ratio", F.lit(1.0))),
            "unsupported": F.when(easy, none).when(bare, F.slice("long", 1, 5)).otherwise(F.coalesce("uncited", none)),
        }
    )
    return out.select("answer_id", "refusal", "grounded_ratio", "unsupported", "unresolved_citations", "schema_errors", ((F.size("schema_errors") == 0) & (F.col("refusal") | (F.col("grounded_ratio") >= 0.8))).alias("acceptable"))


def overridden(answers: DataFrame, calculated: DataFrame) -> DataFrame:
    """Calculated values that no measurement of an answer is within 2 % of [J23]. calculated: answer_id, name, value."""
    said = answers.select("answer_id", F.transform(figures(F.col("text")), lambda f: f["value"].cast("double")).alias("said"))
    return calculated.join(said, "answer_id").where(~near_any(F.col("value"), F.col("said"))).select("answer_id", "name", "value")


def calculated(results: DataFrame) -> DataFrame:
    """Each number that a run's tools gave, and the first calculation that gave it [K13]. results: answer_id, pos, name, output."""
    each = results.select("answer_id", "pos", "name", F.explode(numbers(F.col("output"))).alias("value"))
    return each.groupBy("answer_id", "value").agg(F.min_by("name", "pos").alias("name"))
