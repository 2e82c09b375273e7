"""Connected components by alternating large and small stars, each round a written table in the shared folder.

A star's centre may have as many edges as there are vertices; its edges are spread over SALTS keys, so that no task holds
all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialise, release, unused

SALTS = 32


def with_totals(rows: DataFrame, key: str, by: str, totals: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """rows with aggregates over their key, a key's rows spread by column by. totals: name -> the aggregate of a part, and
    what makes the whole of the parts' column of that name."""
    salt = unused(rows, "salt")
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = spread.groupBy(key, salt).agg(*(part.alias(name) for name, (part, _) in totals.items()))
    whole = parts.groupBy(key).agg(*(fold(name).alias(name) for name, (_, fold) in totals.items()), F.collect_set(salt).alias(salt))
    return spread.join(whole.withColumn(salt, F.explode(salt)), [key, salt]).drop(salt)


def spread_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows joined to few (one row for each of a small number of keys), a key's rows spread by column by: few's rows are
    repeated for each part."""
    salt = unused(rows, "salt")
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return spread.join(few.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, salt]).drop(salt)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Large: every larger neighbour of a vertex is linked to the vertex's least neighbour (or itself).
    Small: a vertex and its smaller neighbours are linked to the least of these."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = with_totals(sides, "a", "b", {"m": (F.min("b"), F.min)})
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        out = joined.select("b", "m").union(joined.where("b = m").select("a", "m")).toDF("a", "b")
    return out.where("a <> b").distinct()


def components(edges: DataFrame, tag: str = "links") -> DataFrame:
    """edges (a, b) of any ordered type -> v, c: each vertex of an edge and the least vertex it reaches. The number of
    rounds grows with the logarithm of the longest path; only a count and a checksum of a round reach the driver."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, before = mark, now
        now = materialise(_stars(_stars(before, True), False), tag)
        release(before)
    return now.select(F.col("a").alias("v"), F.col("b").alias("c")).union(now.select("b", "b")).distinct()
