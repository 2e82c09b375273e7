"""Who may see what, as Columns [B1-B7, B27, D15, D16, G6, P22]: a Principal builds predicates, never filters rows itself."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.sources.tables import LADDER


def label_rank(label: Column) -> Column:
    """Place on the ladder from 0; an unknown or missing label ranks above all, so that it hides [B6]."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LADDER)), label), F.lit(0)) - 1, F.lit(len(LADDER))).cast("int")


def clearance_rank(clearance: Column) -> Column:
    """Place on the ladder from 0; an unknown or missing clearance ranks below all [B6]."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LADDER)), clearance), F.lit(0)) - 1, F.lit(-1)).cast("int")


def outranks(label: Column, clearance: Column) -> Column:
    return label_rank(label) > clearance_rank(clearance)


def at_or_below(clearance: str) -> list[str]:
    """The labels that a clearance sees: a prefix of the ladder [B5]."""
    return list(LADDER[: LADDER.index(clearance) + 1]) if clearance in LADDER else []


@dataclass(frozen=True)
class Principal:
    user_id: str
    clearance: str = "public"
    departments: frozenset[str] = frozenset()
    permissions: frozenset[str] = frozenset()
    excluded_documents: frozenset[int] = field(default_factory=frozenset)

    def may(self, permission: str) -> bool:
        return permission in self.permissions or "admin:*" in self.permissions

    def predicate(self, classification: str = "classification", departments: str = "departments", document: str | None = None) -> Column:
        """The rows this principal may read [B1, B2, B4]: label on the visible prefix, and departments that overlap, or
        none on either side, and no excluded document. It goes inside the scan, before any ranking."""
        visible = at_or_below(self.clearance)
        out = F.coalesce(F.col(classification).isin(visible), F.lit(False)) if visible else F.lit(False)
        if self.departments:
            own = F.coalesce(F.col(departments), F.array().cast("array<string>"))
            out &= (F.size(own) == 0) | F.arrays_overlap(own, F.array(*map(F.lit, sorted(self.departments))))
        if self.excluded_documents and document:
            out &= ~F.col(document).isin(sorted(self.excluded_documents))
        return out

    def describe(self) -> str:
        """The filter in words [B7]."""
        parts = [f"classification in {', '.join(at_or_below(self.clearance)) or 'none'}"]
        if self.departments:
            parts.append(f"departments {', '.join(sorted(self.departments))} or unrestricted")
        if self.excluded_documents:
            parts.append(f"{len(self.excluded_documents)} documents excluded")
        return "; ".join(parts)


def tree(spec: dict) -> Column:
    """A predicate from nested must, should, must_not lists and leaves {field, any | value | empty} [B3]."""
    if "field" in spec:
        c = F.col(spec["field"])
        if spec.get("empty"):
            return F.coalesce(F.size(c) == 0, F.lit(True))
        if "any" in spec:
            return c.isin(spec["any"]) if not spec.get("array") else F.arrays_overlap(c, F.array(*map(F.lit, spec["any"])))
        return c == F.lit(spec["value"])
    out = reduce(lambda a, b: a & b, map(tree, spec.get("must", [])), F.lit(True))
    if spec.get("should"):
        out &= reduce(lambda a, b: a | b, map(tree, spec["should"]))
    return out & reduce(lambda a, b: a & b, (~tree(x) for x in spec.get("must_not", [])), F.lit(True))


def granted(required: Column, held: Column) -> Column:
    """Whether all required permissions are held, or the wildcard is [B27, D16]."""
    return F.array_contains(held, "admin:*") | (F.size(F.array_except(required, held)) == 0)


def missing(required: Column, held: Column) -> Column:
    """The required permissions not held, in order [G4]."""
    return F.when(F.array_contains(held, "admin:*"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(required, held)))
