"""Documents to blocks, sections and chunks [A15, B19, B20, E1-E7, L8, L9, D3].

Heading paths are windows; packing is a fold over one section's blocks, so a task holds one section at a time, never a
corpus. Long blocks are split before, tables by rows under their header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import estimated_tokens, words

PARENT, CHILD, OVERLAP = 900, 256, 32


def blocks_of(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blank-line-separated blocks of plain or Markdown text, in order; # headings have their level [A15]."""
    parts = documents.select(key, F.posexplode(F.split(text, r"\n[ \t\r]*\n|\n(?=#{1,6}\s)|(?<=\n|^)(?=#{1,6}\s)")).alias("pos", "raw"))
    level = F.length(F.regexp_extract("raw", r"^\s*(#{1,6})\s", 1))
    head = F.trim(F.regexp_replace("raw", r"^\s*#{1,6}\s+", ""))
    return parts.where(F.trim("raw") != "").select(
        key, F.col("pos").cast("long").alias("pos"), F.when(level > 0, "heading").when(F.trim("raw").startswith("|"), "table").otherwise("paragraph").alias("type"), F.when(level > 0, level).alias("level"), F.when(level > 0, head).otherwise(F.trim("raw")).alias("text")
    )


def reading_order(blocks: DataFrame, key: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """Empty blocks dropped, the rest by rounded place, renumbered [B19]."""
    w = Window.partitionBy(*key).orderBy(F.bround("y0", 3), F.bround("x0", 3), "ord")
    return blocks.where(F.trim("text") != "").withColumn("ord", F.row_number().over(w) - 1)


def section_paths(blocks: DataFrame, key: str = "doc_id", levels: int = 6) -> DataFrame:
    """Adds section_path and section to each block that is no heading [E1]. A heading of level n closes all of n and
    deeper: the last heading of a level counts if it comes after every last one of a shallower level."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = {n: F.max(F.when(F.col("level") == n, F.col("pos"))).over(w) for n in range(1, levels + 1)}
    name = {n: F.max_by(F.when(F.col("level") == n, F.col("text")), F.when(F.col("level") == n, F.col("pos"))).over(w) for n in range(1, levels + 1)}
    marked = blocks.withColumns({f"__at{n}": at[n] for n in at} | {f"__name{n}": name[n] for n in name})
    path = []
    for n in range(1, levels + 1):
        above = [F.col(f"__at{m}") for m in range(1, n)]
        alive = F.col(f"__at{n}").isNotNull()
        for a in above:
            alive &= a.isNull() | (F.col(f"__at{n}") > a)
        path.append(F.when(alive, F.col(f"__name{n}")))
    last = F.greatest(F.lit(-1).cast("long"), *[F.coalesce(F.col(f"__at{n}"), F.lit(-1)) for n in range(1, levels + 1)])
    out = marked.withColumns({"section_path": F.array_compact(F.array(*path)), "section": last})
    return out.where("type NOT IN ('heading', 'header', 'footer')").drop(*[c for c in out.columns if c.startswith("__")])


def _fold(items: Column, budget: Column | int, join: str) -> Column:
    """Strings put together, in order, up to a budget of tokens: array<string>. A string's tokens are estimated by itself."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    step = lambda s, x: F.when(
        (s["n"] > 0) & (s["n"] + estimated_tokens(x) > budget),
        F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), x.alias("cur"), estimated_tokens(x).alias("n")),
    ).otherwise(F.struct(s["done"].alias("done"), F.when(s["n"] > 0, F.concat(s["cur"], F.lit(join), x)).otherwise(x).alias("cur"), (s["n"] + estimated_tokens(x)).alias("n")))
    return F.aggregate(items, start, step, lambda s: F.when(s["cur"] != "", F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def split_prose(text: Column, budget: int) -> Column:
    """Sentences packed to the budget; one that is longer is cut by words [E7]."""
    per = max(1, int(budget * 3.6 / 6))
    hard = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words(s))), F.lit(per)), lambda i: F.array_join(F.slice(words(s), i, per), " "))
    parts = F.flatten(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.when(estimated_tokens(s) > budget, hard(s)).otherwise(F.array(s))))
    return _fold(parts, budget, " ")


def split_table(text: Column, budget: int) -> Column:
    """Rows packed to the budget, the header row on top of each piece [E6]."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.trim(r) != "")
    body = _fold(F.slice(rows, 2, 1_000_000), F.lit(budget) - F.coalesce(estimated_tokens(F.get(rows, 0)), F.lit(0)), "\n")
    return F.when(F.size(rows) <= 1, F.array(text)).otherwise(F.transform(body, lambda p: F.concat(rows[0], F.lit("\n"), p)))


def pieces(kind: Column, text: Column, budget: int) -> Column:
    """The parts of a block: itself, if it is within the budget [E6, E7]."""
    return F.when(estimated_tokens(text) <= budget, F.array(text)).when(kind == "table", split_table(text, budget)).otherwise(split_prose(text, budget))


def split_long(blocks: DataFrame, budget: int) -> DataFrame:
    """Blocks above the budget become several."""
    parts = blocks.withColumn("__p", pieces(F.col("type"), F.col("text"), budget))
    return parts.select(*[c for c in blocks.columns if c != "text"], F.posexplode("__p").alias("part", "text"))


def pack(items: Column, budget: int, overlap: int = OVERLAP) -> Column:
    """array<struct<pos, part, type, text>> -> array of runs within the budget; the tail of a run, up to overlap tokens, opens
    the next [E2, E3]."""
    kind = "array<struct<pos:bigint,part:int,type:string,text:string>>"
    tokens = lambda xs: F.aggregate(xs, F.lit(0), lambda n, b: n + estimated_tokens(b["text"]))

    def tail(xs: Column) -> Column:
        first = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        take = lambda s, b: F.when(
            s["full"] | (s["n"] + estimated_tokens(b["text"]) > overlap), F.struct(s["kept"].alias("kept"), s["n"].alias("n"), F.lit(True).alias("full"))
        ).otherwise(F.struct(F.concat(F.array(b), s["kept"]).alias("kept"), (s["n"] + estimated_tokens(b["text"])).alias("n"), F.lit(False).alias("full")))
        return F.aggregate(F.reverse(xs), first, take, lambda s: s["kept"])

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("cur"), F.lit(0).alias("n"))

    def step(s: Column, b: Column) -> Column:
        grown = F.concat(tail(s["cur"]), F.array(b))
        return F.when(
            (F.size(s["cur"]) > 0) & (s["n"] + estimated_tokens(b["text"]) > budget),
            F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), grown.alias("cur"), tokens(grown).alias("n")),
        ).otherwise(F.struct(s["done"].alias("done"), F.concat(s["cur"], F.array(b)).alias("cur"), (s["n"] + estimated_tokens(b["text"])).alias("n")))

    return F.aggregate(items, start, step, lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))


def chunk(blocks: DataFrame, key: str = "doc_id", parent: int = PARENT, child: int = CHILD, overlap: int = OVERLAP) -> DataFrame:
    """Parents and their children, numbered over the document: key, ordinal, parent_ordinal, is_parent, section_path,
    text, tokens [E4, E5, L8]. A parent that is its only child stands alone. blocks: key, pos, type, level, text."""
    if child > parent:
        raise ValueError("a child may not be larger than its parent")  # [L9]
    one = split_long(section_paths(blocks, key), parent)
    runs = one.groupBy(key, "section", "section_path").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "type", "text"))).alias("items"))
    parents = runs.select(key, "section", "section_path", F.posexplode(pack(F.col("items"), parent, overlap)).alias("p", "of"))
    text = lambda xs: F.trim(F.array_join(F.transform(xs, lambda b: b["text"]), "\n"))
    fine = lambda b: F.transform(pieces(b["type"], b["text"], child), lambda t, i: F.struct(b["pos"].alias("pos"), i.alias("part"), b["type"].alias("type"), t.alias("text")))
    made = parents.select(key, "section", "section_path", "p", text(F.col("of")).alias("text"), pack(F.flatten(F.transform("of", fine)), child, overlap).alias("children"))
    alone = (F.size("children") == 1) & (estimated_tokens(F.col("text")) <= child)
    rows = F.when(alone, F.array(F.struct(F.lit(-1).alias("c"), F.col("text").alias("text")))).otherwise(
        F.concat(F.array(F.struct(F.lit(-1).alias("c"), F.col("text").alias("text"))), F.transform("children", lambda xs, i: F.struct(i.alias("c"), text(xs).alias("text"))))
    )
    flat = made.where(F.col("text") != "").select(key, "section", "section_path", "p", (~alone).alias("has"), F.explode(rows).alias("r")).select(key, "section", "section_path", "p", "has", "r.c", "r.text")
    w = Window.partitionBy(key).orderBy("section", "p", "c")
    numbered = flat.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))
    over = Window.partitionBy(key, "section", "p")
    return numbered.select(
        key, "ordinal", F.when(F.col("c") >= 0, F.min("ordinal").over(over)).alias("parent_ordinal"), ((F.col("c") < 0) & F.col("has")).alias("is_parent"), "section_path", "text", estimated_tokens(F.col("text")).alias("tokens")
    )
