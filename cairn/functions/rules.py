"""Rule engines and classifiers as Columns [2-N, H20, J15]: ladders in which the first match wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import EQUIPMENT_TAG, sentences

# --- fixed values: vocabulary of the request policy -----------------------------------------------------------------
PROTECTIONS = (
    r"interlock|trip|shutdown\s+system|sis\b|esd\b|safety\s+system|relief\s+(?:valve|device)|psv|rupture\s+disc|alarm|permit(?:\s+to\s+work)?|"
    r"lockout|tagout|loto|gas\s+detect\w*|fire\s+(?:and\s+gas|suppression)|safeguard"
)
DEFEAT = r"bypass|by-pass|defeat|disable|deactivate|override|circumvent|inhibit|force|jumper|suppress"
INTENT = (
    r"can\s+(?:i|we)|could\s+(?:i|we)|may\s+(?:i|we)|how\s+(?:do|can|would)\s+(?:i|we)|is\s+it\s+(?:ok|okay|fine|alright|acceptable)|"
    r"any\s+way\s+to|way\s+(?:to|around)|let\s+me|help\s+me|show\s+me\s+how"
)
TARGETS = r"unit|plant|refinery|vessel|tank|pipeline|facility|column|reactor|site|terminal|storage|line|cdu|compressor|furnace|system"
ATTACK = (
    r"bomb(?!\s*calorimeter)|blow\s+up|detonate|sabotage|torch\b|set\s+fire\s+to|deliberately\s+(?:rupture|overpressur\w+|damage)|poison|"
    r"contaminate\s+the|cause\s+an?\s+(?:explosion|fire|leak|release|rupture)|start\s+a\s+fire"
)
HOWTO = r"how\s+(?:to|do\s+i|can\s+i|would\s+i|do\s+we|can\s+we)|ways?\s+to|best\s+way\s+to|help\s+me\s+to|steps?\s+to|guide\s+to"
SECRETS = r"(?:password|passwd|credential|api[\s_-]?key|private\s+key|secret\s+key|access\s+token|ssh\s+key)s?"
LEAVE = r"(?:permit|approval|authorisation|authorization|sign[- ]?off)"
POLICY = (
    ("sabotage", rf"\b(?:{ATTACK})\b[^.?!]{{0,30}}\b(?:the\s+)?(?:{TARGETS})\b"),
    ("sabotage", rf"\b(?:{HOWTO})\b[^.?!]{{0,25}}\b(?:{ATTACK})\b"),
    ("safety_bypass", rf"\b(?:{DEFEAT})\b[^.?!]{{0,40}}\b(?:{PROTECTIONS})\b"),
    ("safety_bypass", rf"\b(?:{PROTECTIONS})\b[^.?!]{{0,30}}\bwithout\b[^.?!]{{0,30}}\b{LEAVE}\b"),
    ("safety_bypass", rf"\b(?:{INTENT})\b[^.?!]{{0,60}}\bwithout\b[^.?!]{{0,30}}\b(?:a\s+)?{LEAVE}\b"),
    (
        "credentials",
        rf"\b{SECRETS}\b[^.?!]{{0,40}}\b(?:what|give|tell|show|list|find|get|need|share|send|reveal|dump)\b"
        rf"|\b(?:what|give|tell|show|list|find|get|share|reveal|dump)\b[^.?!]{{0,40}}\b{SECRETS}\b",
    ),
    (
        "intrusion",
        rf"\bhack(?:ing|s|ed)?\b[^.?!]{{0,30}}\b(?:into|the\s+)?(?:{TARGETS}|network|scada|plc|dcs|hmi|server|control|account|database|historian)\b"
        rf"|\b(?:{HOWTO})\b[^.?!]{{0,20}}\bhack(?:ing|s)?\b|\b(?:hack|break)\s+into\b|\bgain\s+(?:unauthorised|unauthorized|admin|root)\s+access\b"
        r"|\b(?:exploit|attack|breach|penetrate|compromise)\b[^.?!]{0,40}\b(?:scada|plc|dcs|hmi|historian|network|server|system|control\s+system)\b"
        r"|\b(?:escalate\s+privileg|brute[\s-]?force|sql\s+inject)\w*",
    ),
    (
        "exfiltration",
        r"\b(?:ignore|bypass|disable|get\s+around|work\s+around)\b[^.?!]{0,30}\b(?:clearance|classification|access\s+control|permission|rbac|restriction)s?\b"
        r"|\b(?:show|list|give|read)\b[^.?!]{0,40}\bdocuments?\b[^.?!]{0,30}\b(?:not\s+cleared|no\s+clearance|above\s+my|beyond\s+my|restricted\s+to\s+others)\b",
    ),
    (
        "injection",
        r"\bignore\s+(?:all\s+)?(?:the\s+)?(?:previous|prior|above|earlier)\s+(?:instruction|prompt|rule|direction)s?\b"
        r"|\b(?:reveal|show|print|repeat|output)\b[^.?!]{0,25}\b(?:system\s+prompt|initial\s+instruction|your\s+instructions)\b"
        r"|\byou\s+are\s+now\s+(?:a|an|in)\b[^.?!]{0,30}\b(?:mode|assistant|model|dan)\b",
    ),
)

# --- fixed values: vocabulary of prompt features -----------------------------------------------------------------------
FEATURES = {
    "code_verb_hits": r"(?i)\b(write|implement|refactor|debug|fix|script|function|class|compile|unit test|parse|regex|algorithm|code)\b",
    "file_extension_hits": r"(?i)\.(py|js|ts|sql|sh|json|ya?ml|csv|xlsx?|docx?|pptx?|pdf|ipynb)\b",
    "library_hits": r"(?i)\b(pandas|numpy|scipy|matplotlib|openpyxl|sqlalchemy|fastapi|django|flask|pytorch|tensorflow|sklearn)\b",
    "comparison_verb_hits": r"(?i)\b(compare|contrast|why|evaluate|assess|analyse|analyze|explain|difference|trade-?off|recommend|should we)\b",
    "drawing_noun_hits": r"(?i)\b(p&?id|pid|drawing|diagram|schematic|photo|photograph|image|picture|sketch|isometric|blueprint|scan|nameplate|gauge|screenshot)\b",
    "spatial_verb_hits": r"(?i)\b(which valve|where (is|on|does)|point to|locate|upstream|downstream|connected to|isolate|highlight|circled|marked|handwritten)\b",
    "unit_hits": r"(?i)\b\d+(\.\d+)?\s*(bar|barg|psi|psig|kpa|mpa|°?[cf]\b|deg\s?[cf]|mm/?y(ea)?r|mm|cm|m3/h|m³/h|kg/cm2|kg/cm²|t/h|tph|kw|mw|rpm|cst|ppm|wt%|%)\b",
    "equipment_tag_hits": EQUIPMENT_TAG,
}
FLAGS = {
    "has_code_fence": r"```|~~~",
    "summarise_document": r"(?i)\b(summari[sz]e|summary of|overview of|go through|read through|walk through)\b(\s+\w+){0,4}?\s+(document|report|manual|sop|procedure|file|deck|book|correspondence)s?\b",
    "multi_document": r"(?i)\b(across|between|all)\s+(the\s+)?(documents|reports|manuals|files|sops)\b",
    "artifact_request": r"(?i)\b(generate|create|build|produce|draft|make)\s+(me\s+)?(an?|the)?\s*(report|deck|presentation|spreadsheet|workbook|memo|letter|document|chart|table)\b",
    "artifact_code_request": r"(?i)\b(generate|write|create)\s+(me\s+)?(a\s+)?(script|program|code|notebook)\b",
}
#: Weights of the lexical lanes, the margin, and the lanes of agent steps.
WEIGHTS = {"code_fence": 3.0, "code_verb": 2.0, "file_extension": 1.5, "library": 1.5, "artifact_code": 2.5, "long_question": 0.5, "comparison": 1.0, "multi_clause": 0.8, "bias": 1.0, "whole_document": 2.5, "multi_document": 1.5, "drawing": 2.5, "spatial": 1.2, "very_short": 1.0}
MARGIN, LONG_TOKENS = 0.25, 12000
STEP_LANES = {"intake": "utility", "plan": "reasoning", "synthesize": "reasoning", "sufficiency": "utility", "query_rewrite": "utility", "grounding_judge": "utility", "validate": "utility", "replan": "reasoning"}
LANES = ("coding", "reasoning", "long_ctx", "vision", "utility")

# --- fixed values: vocabulary of refusals ------------------------------------------------------------------------------
_SUBJECT = (
    r"(?:indexed |provided |available |retrieved |supplied |given |cited |attached |referenced )*"
    r"(?:document|source|corpus|record|material|evidence|context|excerpt|passage|report|sop|procedure|log|register|manual|datasheet|file)s?"
)
_NEGATION = (
    r"(?:do(?:es)?\s+not|do(?:es)?n['`]t|did\s+not|didn['`]t|cannot|can['`]t|could\s+not|couldn['`]t|is\s+not|are\s+not|isn['`]t|aren['`]t|was\s+not|"
    r"were\s+not|fails?\s+to|failed\s+to|lacks?|lacked|contains?\s+no|have\s+no|has\s+no|had\s+no|include\s+no|omits?)"
)
_VERB = (
    r"(?:contain|cover|specify|mention|include|state|record|provide|address|list|indicate|document|report|show|give|describe|detail|define|reference|capture|"
    r"available|present|found|specified|mentioned|stated|recorded|documented|listed|covered|included|indicated|provided|described|captured|referenced|information|data)"
)
REFUSALS = (
    rf"(?i)\b{_SUBJECT}\b[^.!?]{{0,60}}?\b{_NEGATION}\b[^.!?]{{0,40}}?\b{_VERB}\b",
    rf"(?i)\b{_NEGATION}\b[^.!?]{{0,40}}?\b{_VERB}\b[^.!?]{{0,40}}?\b(?:in|within|among|across|from)\b[^.!?]{{0,40}}?\b{_SUBJECT}\b",
    r"(?i)\b(?:no\s+(?:record|mention|reference|information|data|evidence|details?)\s+(?:of|on|about|regarding|for)"
    r"|(?:i\s+)?(?:cannot|can['`]t|am\s+unable\s+to|was\s+unable\s+to)\s+(?:answer|determine|find|locate|confirm|verify|establish)"
    r"|(?:cannot|can['`]t|could\s+not|couldn['`]t)\s+be\s+(?:answered|determined|found|located|established|confirmed|verified)"
    r"|(?:could\s+not|couldn['`]t)\s+(?:find|locate|determine|identify)|not\s+enough\s+(?:information|evidence|data)|insufficient\s+(?:information|evidence|data))\b",
)
_CONTRAST = r"\b(?:but|however|although|though|whereas|nevertheless|nonetheless|that\s+said|on\s+the\s+other\s+hand)\b"
_ANY_NEGATION = rf"\b(?:{_NEGATION}|no|none|neither|nor|without|absent|unavailable|unclear|unknown|unspecified|unstated|silent|nothing|lacking)\b"

# --- fixed values: vocabulary of artifact requests ---------------------------------------------------------------------
_PRODUCE = (
    r"(?:produce|generate|create|make|build|write|draft|prepare|compile|assemble|put\s+together|export|give\s+me|send\s+me|i\s+(?:want|need)|"
    r"can\s+you\s+(?:make|write|produce|create|prepare))"
)
FORMATS = (
    ("artifact.pptx", r"(?:power\s?point|pptx?|slide\s?deck|slides?|deck|presentation|briefing\s+deck)"),
    ("artifact.xlsx", r"(?:excel|xlsx?|spread\s?sheet|work\s?book|csv|table\s+of\s+figures)"),
    ("artifact.docx", r"(?:word\s+(?:doc\w*|report|file)?|docx?|document|report|memo|write-?up|summary\s+doc\w*)"),
    ("artifact.docx", r"(?:report|write-?up|document|summary|minutes|note)"),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first(tests: list[Column]) -> Column:
    """The place of the first test that holds, from 1 on, one past the last if none; later ones are not evaluated."""
    return reduce(lambda out, kt: F.when(kt[1], kt[0]).otherwise(out), reversed(list(enumerate(tests, 1))), F.lit(len(tests) + 1))


def policy_verdict(text: Column) -> Column:
    """struct<allowed, category, matched>: the first rule that matches refuses; 120 characters of evidence [N1]."""
    names, patterns = F.array(*(F.lit(n) for n, _ in POLICY), F.lit("")), F.array(*(F.lit(f"(?i){p}") for _, p in POLICY), F.lit("$^"))

    def verdict(k: Column) -> Column:
        evidence = F.substring(F.call_function("regexp_extract", text, F.element_at(patterns, k), F.lit(0)), 1, 120)
        return F.struct((k > len(POLICY)).alias("allowed"), F.element_at(names, k).alias("category"), evidence.alias("matched"))

    return bound(_first([text.rlike(f"(?i){p}") for _, p in POLICY]), verdict)


def prompt_features(text: Column) -> Column:
    """The lexical features of a prompt [H20]."""
    n = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long").alias("word_count")
    hits = [F.regexp_count(text, F.lit(p)).cast("long").alias(k) for k, p in FEATURES.items()]
    flags = [text.rlike(p).alias(k) for k, p in FLAGS.items()]
    return F.struct(n, *hits, *flags)


def lane_scores(f: Column, has_images: Column | None = None) -> Column:
    """array<struct<score, order, lane>> from best to worst [J15, F12]: vision scores only with an image."""
    w = WEIGHTS
    flag = lambda c: c.cast("double")
    hits = lambda c, most: F.least(c, F.lit(most)).cast("double")
    long_ = flag(f["word_count"] > 40)
    seen = has_images if has_images is not None else F.lit(False)
    scores = {
        "coding": w["code_fence"] * flag(f["has_code_fence"]) + w["code_verb"] * hits(f["code_verb_hits"], 3) + w["file_extension"] * hits(f["file_extension_hits"], 2) + w["library"] * hits(f["library_hits"], 2) + w["artifact_code"] * flag(f["artifact_code_request"]),
        "reasoning": F.lit(w["bias"]) + w["comparison"] * hits(f["comparison_verb_hits"], 3) + (w["multi_clause"] + w["long_question"]) * long_,
        "long_ctx": w["whole_document"] * flag(f["summarise_document"]) + w["multi_document"] * flag(f["multi_document"]),
        "vision": F.when(seen, w["drawing"] * hits(f["drawing_noun_hits"], 2) + w["spatial"] * hits(f["spatial_verb_hits"], 2)).otherwise(0.0),
        "utility": w["very_short"] * flag(f["word_count"] < 5),
    }
    rows = F.array(*(F.struct((-F.bround(s, 9)).alias("score"), F.lit(k).alias("order"), F.lit(name).alias("lane")) for k, (name, s) in enumerate(scores.items())))
    return F.transform(F.array_sort(rows), lambda x: F.struct((-x["score"]).alias("score"), x["lane"].alias("lane")))


def route(text: Column, has_images: Column | None = None, tokens: Column | None = None, step: Column | None = None, hint: Column | None = None) -> Column:
    """struct<lane, stage, confidence>: hint, image, step and size decide first, then a clear lexical winner; lane is null
    where only a model could say [N2]."""
    none = F.lit(None).cast("string")
    hint = hint if hint is not None else none
    images = has_images if has_images is not None else F.lit(False)
    step_lane = F.element_at(F.create_map(*[F.lit(x) for kv in STEP_LANES.items() for x in kv]), step) if step is not None else none
    first = F.coalesce(F.when(hint.isin(*LANES), hint), F.when(images, "vision"), step_lane, F.when((tokens if tokens is not None else F.lit(0)) > LONG_TOKENS, "long_ctx"))

    def verdict(ranked: Column) -> Column:
        top, second = ranked[0]["score"], ranked[1]["score"]
        clear = (top > 0) & (top - second >= MARGIN)
        return F.struct(
            F.coalesce(first, F.when(clear, ranked[0]["lane"])).alias("lane"),
            F.when(first.isNotNull(), 0).when(clear, 1).otherwise(2).alias("stage"),
            F.when(first.isNotNull(), 1.0).when(clear, F.least(F.lit(1.0), (top - second) / F.greatest(top, F.lit(1.0)))).otherwise(0.0).alias("confidence"),
        )

    return bound(prompt_features(text), lambda f: bound(lane_scores(f, images), verdict))


def is_refusal(text: Column, leading: int = 3) -> Column:
    """Whether an answer declines for lack of evidence [N6]: one of its first sentences has the form of a refusal and no
    contrast in it goes on to assert something, and no sentence before it makes a cited claim."""
    head = F.slice(sentences(text), 1, leading)
    shaped = lambda s: reduce(lambda a, b: a | b, (s.rlike(p) for p in REFUSALS))
    # what follows a contrast, to the end of the sentence or the next contrast
    clauses = lambda s: F.filter(F.transform(F.slice(F.split(s, f"(?i){_CONTRAST}"), 2, 1000), lambda c: F.regexp_extract(c, r"(?s)^([^.!?]*)", 1)), lambda c: F.trim(c) != "")
    asserts = lambda s: F.exists(clauses(s), lambda c: ~c.rlike(f"(?i){_ANY_NEGATION}"))
    refuses = F.transform(head, lambda s: shaped(s) & ~asserts(s))
    claims = F.transform(head, lambda s: s.rlike(r"\[\d+\]") & ~s.rlike(f"(?i){_ANY_NEGATION}"))
    at = F.array_position(refuses, True)
    # array_position of a boolean array gives the first that refuses; claims before it undo it
    return F.coalesce((at > 0) & ~F.exists(F.slice(claims, 1, F.greatest(F.lit(0), at - 1).cast("int")), lambda x: x), F.lit(False))


def requested_format(text: Column) -> Column:
    """The kind of file asked for, null if none: a verb of making within 60 characters before the word [N7]."""
    low = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    tools = F.array(*(F.lit(tool) for tool, _ in FORMATS), F.lit(None).cast("string"))
    return bound(low, lambda t: F.element_at(tools, _first([t.rlike(rf"\b{_PRODUCE}\b.{{0,60}}?\b{words}\b") for _, words in FORMATS])))


def failure_message(kind: Column) -> Column:
    """[P30]"""
    return (
        F.when(kind.isin("timeout", "deadline"), "The request took too long and was stopped.")
        .when(kind.isin("unreachable", "connection"), "The model service could not be reached.")
        .when(kind == "permission", "This account may not do that.")
        .when(kind == "budget", "The run used up its budget.")
        .otherwise("The run failed.")
    )


def retryable(kind: Column) -> Column:
    """[P7]"""
    return kind.isin("timeout", "unreachable", "rate_limited", "overloaded")
