"""Agent plans, requests and providers as Columns [E16, F15, K16, N8, N15, P5-P14, A28, O3, K14]: what models return comes in as
text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.rules import requested_format

STEP = "struct<id:string,intent:string,description:string,tool:string>"
PLAN = f"struct<rationale:string,steps:array<{STEP}>>"
INTENTS = ("retrieve", "tool", "synthesize")


def _step(key: str, intent: str, text: str, tool: Column | None = None) -> Column:
    return F.struct(F.lit(key).alias("id"), F.lit(intent).alias("intent"), F.lit(text).alias("description"), (tool if tool is not None else F.lit(None).cast("string")).alias("tool"))


def parse_plan(raw: Column, available: Column, request: Column, most: int = 6) -> Column:
    """struct<steps, dropped, fallback> of a planner's JSON [K16, N8, E16, F15, O3]: steps of unknown intent go, a step that
    names a tool is a tool step, tools not on offer are dropped and told, a file that was asked for gets its step, one artifact
    step for each tool, the answer once and last, and so many steps in all. Unusable JSON gives retrieval and an answer."""
    plan = F.from_json(raw, PLAN)
    none_tool = lambda t: F.when(F.lower(F.trim(t)).isin("", "null", "none"), None).otherwise(F.trim(t))

    def relabelled(s: Column, i: Column) -> Column:
        tool = none_tool(s["tool"])
        intent = F.coalesce(s["intent"], F.lit("retrieve"))
        return F.struct(
            F.coalesce(s["id"], F.concat(F.lit("s"), (i + 1).cast("string"))).alias("id"), F.when(tool.isNotNull() & (intent != "retrieve"), "tool").otherwise(intent).alias("intent"), F.coalesce(s["description"], F.lit("")).alias("description"), tool.alias("tool")
        )

    known = F.filter(F.coalesce(plan["steps"], F.array().cast(f"array<{STEP}>")), lambda s: F.coalesce(s["intent"], F.lit("retrieve")).isin(*INTENTS))
    steps = F.transform(known, relabelled)
    offered = lambda s: (s["intent"] != "tool") | F.coalesce(F.array_contains(available, s["tool"]), F.lit(False))
    good = F.filter(steps, offered)
    dropped = F.transform(F.filter(steps, lambda s: ~offered(s)), lambda s: F.coalesce(s["tool"], F.lit("")))
    wanted = requested_format(request)
    add = F.coalesce(wanted.isNotNull() & F.array_contains(available, wanted) & ~F.exists(good, lambda s: F.coalesce(s["tool"] == wanted, F.lit(False))), F.lit(False))
    actions = F.concat(F.filter(good, lambda s: s["intent"] != "synthesize"), F.when(add, F.array(_step("artifact", "tool", "Produce the requested document", wanted))).otherwise(F.array().cast(f"array<{STEP}>")))
    tools = F.transform(actions, lambda s: F.coalesce(s["tool"], F.lit("")))
    once = F.filter(actions, lambda s, i: ~F.coalesce(s["tool"], F.lit("")).startswith("artifact.") | (F.array_position(tools, s["tool"]) == i + 1))
    answers = F.filter(good, lambda s: s["intent"] == "synthesize")
    final = F.when(F.size(answers) > 0, F.slice(answers, -1, 1)).otherwise(F.array(_step("final", "synthesize", "Write the answer")))
    fallback = F.size(good) == 0
    default = F.array(_step("s1", "retrieve", "Search the documents"), _step("s2", "synthesize", "Write the answer"))
    return F.struct(F.when(fallback, default).otherwise(F.slice(F.concat(once, final), 1, most)).alias("steps"), dropped.alias("dropped"), fallback.alias("fallback"))


def prompt_tokens(characters: Column, images: Column) -> Column:
    """[P5]"""
    return F.floor(characters / 4).cast("long") + 800 * images


def host_of(url: Column) -> Column:
    """host[:port] of an address, with or without a scheme [P14]."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    place = F.regexp_replace(F.regexp_extract(rest, r"^/{0,2}([^/?#]*)", 1), "^.*@", "")
    return F.nullif(F.lower(place), F.lit(""))


def is_private(host: Column) -> Column:
    """Whether an address is local or of a private range [B33]."""
    return host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|\[?::1\]?|[a-z0-9-]+(:\d+)?$)")


def expiry_seconds(text: Column) -> Column:
    """Seconds since the epoch, null for what is no time [P8]."""
    return F.unix_seconds(F.try_to_timestamp(text))


def stale(missing: Column, age_s: Column, ttl_s: float = 60.0) -> Column:
    """[P10]"""
    return (missing > 0) & (age_s >= ttl_s)


def expanded(value: Column, environment: Column) -> Column:
    """${VAR} and ${VAR:-default} in a setting, by a map of the environment [A28, K10]. A value of one reference only."""
    name, default = F.regexp_extract(value, r"^\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}$", 1), F.regexp_extract(value, r"^\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}$", 2)
    return F.when(name != "", F.coalesce(F.nullif(F.try_element_at(environment, name), F.lit("")), default)).otherwise(value)


def compact(value: Column, limit: int = 2000) -> Column:
    """A tool's payload for a prompt [K14]."""
    return F.left(value, F.lit(limit))


def total_tokens(prompt: Column, answer: Column) -> Column:
    """[P6]"""
    return prompt + answer


def remaining_seconds(deadline: Column, now: Column) -> Column:
    """[P34]"""
    return F.greatest(F.lit(0.0), deadline - now)


def outcome(ok: Column, refused: Column) -> Column:
    """A tool's refusal is neither a success nor a failure [P33]."""
    return F.when(ok, "ok").when(refused, "refused").otherwise("failed")
