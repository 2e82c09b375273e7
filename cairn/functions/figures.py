"""Figures in answers and their sources [H12-H14, C14, K13, J23, P32]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
#: Units that make a number a measurement.
UNITS = (
    "mm/year mm/yr mm/s m/s km/h m3/h l/min barg bar psig psi kpa mpa kgf/cm2 degc degf °c °f celsius mm cm km µm um nm inch inches in ft m years year yr months "
    "month weeks week days day hours hour hrs hr minutes minute mins min seconds second secs sec tonnes tonne kg g lb litres litre liters liter l m3 rpm hz ppm "
    "ppb % kw mw kv v a crore lakh inr usd rs"
).split()
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
#: A measurement, and the rules of tables, which hold none.
FIGURE = rf"(?i)(?<![A-Za-z0-9_.\-/])(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+\.\d+|\d+)(?:\s*({_UNIT})\b)?"


_RULES = r"(?m)^\s*\|?[\s:|-]+\|?\s*$"


def normalised(number: Column) -> Column:
    """"1,200" as "1200", "9.20" as "9.2", "18.0" as "18" [H12]."""
    bare = F.replace(number, F.lit(","), F.lit(""))
    return F.when(bare.contains("."), F.rtrim(F.rtrim(bare, F.lit("0")), F.lit("."))).otherwise(bare)


def numbers(text: Column) -> Column:
    """All numbers of a passage, normalised, each once [H13]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), normalised))


def figures(text: Column) -> Column:
    """The measurements of a text in order: number with a unit, or decimal; markers and table rules are none; each
    (value, unit) once [H14]. Array of struct<text, value, unit>."""
    body = F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", " "), _RULES, " ")
    found = F.arrays_zip(F.regexp_extract_all(body, F.lit(FIGURE), F.lit(1)).alias("n"), F.regexp_extract_all(body, F.lit(FIGURE), F.lit(2)).alias("u"))
    kept = F.filter(found, lambda x: (x["u"] != "") | x["n"].contains("."))
    out = F.transform(kept, lambda x: F.struct(F.trim(F.concat(x["n"], F.lit(" "), x["u"])).alias("text"), normalised(x["n"]).alias("value"), x["u"].alias("unit")))
    keys = F.transform(out, lambda x: F.concat(x["value"], F.lit("|"), F.lower(x["unit"])))
    return F.filter(out, lambda x, i: F.array_position(keys, F.concat(x["value"], F.lit("|"), F.lower(x["unit"]))) == i + 1)


def near_any(value: Column, values: Column, share: float = 0.02) -> Column:
    """Whether some value is within a share of the given one [J23]."""
    return F.exists(values, lambda v: F.abs(v - value) <= F.greatest(F.abs(value) * share, F.lit(1e-9)))
