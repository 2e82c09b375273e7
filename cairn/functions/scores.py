"""Scores and measures as Columns [J11-J24, D1-D7, A7-A11, A21, B19, B22]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_fusion(rank: Column, weight: Column | float = 1.0, k: int = 60) -> Column:
    """One list's share of the fused score [J11]."""
    return (weight if isinstance(weight, Column) else F.lit(weight)) / (F.lit(k) + rank)


def confidence_penalty(score: Column, confidence: Column, penalty: float = 0.15, floor: float = 0.8) -> Column:
    """A score lowered for text that was read with little confidence [J12]."""
    return F.when(confidence < floor, score * (1 - F.lit(penalty) * (F.lit(floor) - confidence) / F.lit(floor))).otherwise(score)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 where either has no length [L2]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def gain(rank: Column) -> Column:
    """Discounted gain of a relevant hit [J16]."""
    return 1 / F.log2(rank + 1)


def weighted_confidence(confidence: str = "confidence", words: str = "words", default: float = 1.0) -> Column:
    """Mean confidence weighted by words, for a group [D1-D4]."""
    w = F.when(F.col(words) > 0, F.col(words))
    return F.coalesce(F.sum(F.col(confidence) * w) / F.sum(w), F.lit(default))


def clamp_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners within 0..1 and in order [J21]."""
    c = [F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in (x0, y0, x1, y1)]
    return F.struct(F.least(c[0], c[2]).alias("x0"), F.least(c[1], c[3]).alias("y0"), F.greatest(c[0], c[2]).alias("x1"), F.greatest(c[1], c[3]).alias("y1"))


def fold_angle(angle: Column) -> Column:
    """An angle in degrees within -45..45 [J20]."""
    a = F.pmod(angle, F.lit(90.0))
    return F.when(a > 45, a - 90).otherwise(a)


def heading_level(ratio: Column) -> Column:
    """From the size over the body's [A10]."""
    return F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).otherwise(3)


def is_heading(text: Column, size: Column, body: Column, bold: Column) -> Column:
    """[A9]"""
    return (F.length(text) <= 160) & ~text.rlike(r"[.;]$") & text.rlike(r"[\p{L}\p{N}]") & ((size > body * 1.15) | (bold & text.rlike(r"^\d+(\.\d+)*\s+\S")))


def block_type(text: Column, size: Column, body: Column, bold: Column, y0: Column, y1: Column) -> Column:
    """Heading, header (top 6 %), footer (bottom 6 %), list or paragraph [A11]. y0, y1: shares of the page's height."""
    return (
        F.when(is_heading(text, size, body, bold), "heading")
        .when(y1 < 0.06, "header")
        .when(y0 > 0.94, "footer")
        .when(text.rlike(r"^\s*[-•*]\s+|^\s*\(?[a-z0-9]\)\s+"), "list")
        .otherwise("paragraph")
    )


def page_verdict(words: Column, confidence: Column, alpha: Column, drawing: Column, handwriting: Column, blank: Column) -> Column:
    """Reasons to read a page again, in order; none for a blank one [B22]."""
    reasons = F.array(
        F.when(drawing, "drawing"),
        F.when(handwriting, "handwriting"),
        F.when(words < 30, "too_few_words"),
        F.when((words > 0) & (confidence < 0.72), "low_confidence"),
        F.when((words > 0) & (alpha < 0.55), "garbled"),
    )
    return F.when(blank & (words == 0), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(reasons)))


def tiles(width: Column, height: Column, size: int = 1024, overlap: int = 128, least: int = 64) -> Column:
    """Boxes that cover an image with overlap, slivers dropped [A21]."""
    step = size - overlap
    at = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), F.lit(step))
    boxes = F.flatten(
        F.transform(
            at(height),
            lambda y: F.transform(at(width), lambda x: F.struct(x.alias("x0"), y.alias("y0"), F.least(x + size, width).alias("x1"), F.least(y + size, height).alias("y1"))),
        )
    )
    return F.filter(boxes, lambda b: (b["x1"] - b["x0"] >= least) & (b["y1"] - b["y0"] >= least))


def edge_weight(score: Column, top: Column) -> Column:
    """[J24]"""
    return F.least(F.greatest(score / top, F.lit(0.15)), F.lit(1.0))


def swap_cost(ram_gb: Column) -> Column:
    """Seconds to load a model, by its size [J14]."""
    return 6.0 * F.greatest(F.lit(0.5), ram_gb / 6)


def candidate_score(quality_tier: Column, speed_tier: Column, resident: Column, swap_s: Column, prefer: str = "loaded_then_quality", per_second: float = 0.15) -> Column:
    """[J13]"""
    q, s = 5.0 - quality_tier, 5.0 - speed_tier
    if prefer == "quality_tier":
        return q * 2.0 + s * 0.25
    if prefer == "speed_tier":
        return s * 2.0 + q * 0.25
    return q + s * 0.5 - swap_s * per_second + F.when(resident, 1.0).otherwise(0.0)
