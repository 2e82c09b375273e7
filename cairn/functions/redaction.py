"""Redaction of nested JSON [H10, K10]: sensitive keys masked at every level, texts cleaned, depth, lists and strings bounded."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import MASKS, SENSITIVE_KEYS

REDACTED = "[REDACTED]"
#: How deep, how many items of a list and how many characters of a text are kept.
DEPTH, ITEMS, CHARACTERS = 8, 100, 512
_MASKS = [(re.compile(p), m) for p, m in MASKS]


def clean(value: object, depth: int = 0) -> object:
    """A value as it may be stored; what lies deeper than DEPTH is told, not kept."""
    if depth > DEPTH:
        return "[TRUNCATED: max depth]"
    if isinstance(value, dict):
        return {k: REDACTED if any(s in k.lower() for s in SENSITIVE_KEYS) else clean(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        more = [f"[TRUNCATED: {len(value) - ITEMS} more items]"] if len(value) > ITEMS else []
        return [clean(v, depth + 1) for v in value[:ITEMS]] + more
    if isinstance(value, str):
        for pattern, mask in _MASKS:
            value = pattern.sub(mask, value)
        return f"{value[:CHARACTERS]}... [TRUNCATED: {len(value)} chars]" if len(value) > CHARACTERS else value
    return value


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except RecursionError:
        return "[TRUNCATED: max depth]"
    except ValueError:
        return text


def redact_json(column: Column) -> Column:
    """Redacted JSON, keys in order and compact. A text that is no JSON is redacted as a text; null stays null; numbers are
    written as they were read, of repeated keys the last counts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) else json.dumps(clean(_parsed(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts], dtype=object)

    return run(column)
