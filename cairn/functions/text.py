"""String functions over Columns [2-H, K1-K3, K9]. Word and white space classes are Unicode's where they meet free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common to search for.
STOP_WORDS = (
    "the and for what which with from that this are was were has have does did how why when where who whom into onto about any all"
).split()
TAG = r"[A-Za-z]{1,4}-\d{1,5}[A-Za-z]?"
EQUIPMENT_TAG = r"\b[A-Z]{1,3}-\d{3,5}[A-Z]?\b"
#: Masks of sensitive text, in order.
MASKS = (
    (r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}", "Bearer [REDACTED]"),
    (r"\beyJ[A-Za-z0-9._\-]{20,}", "[REDACTED]"),
    (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[REDACTED]"),
    (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[REDACTED]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "[REDACTED]"),
    (r"\b\d{12,19}\b", "[REDACTED]"),
)
#: Keys whose values are never recorded, as parts of lower-cased names.
SENSITIVE_KEYS = (
    "password passwd secret token api_key apikey authorization auth cookie session_key refresh_token access_token private_key jwt credential salt password_hash"
).split()
#: Places where a recogniser lost a space, in order.
LOST_SPACES = (
    r"(?<=[a-z])(?=\d)|(?<=\d)(?=[A-Z][a-z])",
    r"(?<=[.:;,])(?=[A-Z][a-z])",
    r"(?<=[:.])(?=[A-Z]{1,4}-\d)",
    r"(?<=,)(?=[a-z])",
    r"(?<=\d)(?=(?!st\b|nd\b|rd\b|th\b)[a-z]{2,})",
)
#: Typeset symbols and their plain readings, in order.
SYMBOLS = (
    ("\\approx", "≈"),
    ("\\times", "×"),
    ("\\cdot", "·"),
    ("\\div", "÷"),
    ("\\pm", "±"),
    ("\\leq", "≤"),
    ("\\geq", "≥"),
    ("\\neq", "≠"),
    ("\\rightarrow", "→"),
    ("\\to", "→"),
    ("\\degree", "°"),
    ("\\%", "%"),
    ("\\,", " "),
    ("\\;", " "),
    ("\\:", " "),
    ("\\!", ""),
    ("\\\\", " "),
)


#: Typeset fractions, wrappers, roots and delimiters.
FRACTION = (r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "$1 / $2")
WRAPPERS = ((r"\\(?:text|mathrm|mathit|mathbf|operatorname)\s*\{([^{}]*)\}", "$1"), (r"\\sqrt\s*\{([^{}]*)\}", "√($1)"))
DELIMITERS = (r"(?s)\\\[\s*(.+?)\s*\\\]", r"(?s)\\\(\s*(.+?)\s*\\\)", r"(?s)\$\$?\s*(.+?)\s*\$\$?")


def words(text: Column) -> Column:
    """White-space-separated words, Unicode white space [D6]."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def query_terms(query: Column) -> Column:
    """Search terms of a question: tags whole and first, then words of three letters or digits or more that are not
    stop words; all words if nothing else is left; each once [H1]."""
    tags = F.regexp_extract_all(query, F.lit(TAG), F.lit(0))
    rest = F.regexp_extract_all(F.regexp_replace(query, TAG, " "), F.lit("[A-Za-z0-9]{3,}"), F.lit(0))
    kept = F.filter(rest, lambda w: ~F.lower(w).isin(STOP_WORDS))
    terms = F.concat(tags, kept)
    return F.array_distinct(F.when(F.size(terms) > 0, terms).otherwise(rest))


def estimated_tokens(text: Column) -> Column:
    """At least one, 3.6 characters each [H3]."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(3.6)).cast("int"))


def contextualised(section_path: Column, text: Column) -> Column:
    """[A > B] before the text, where there is a section [H4]."""
    return F.when(F.size(section_path) > 0, F.concat(F.lit("["), F.array_join(section_path, " > "), F.lit("]\n"), text)).otherwise(text)


def fit(text: Column, limit: int) -> Column:
    """Cut to limit characters, back to the last space if that keeps over 80 % [H5]."""
    cut = F.substring(text, 1, limit)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))
    fitted = F.when((F.locate(" ", F.reverse(cut)) > 0) & (last > F.lit(0.8 * limit)), F.left(cut, last)).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(fitted)


def slug(name: Column, mark: str = "_") -> Column:
    """Lower case, runs of other characters to one mark, none at the ends [H6, H30]."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", mark), F.lit(mark))


def sheet_name(name: Column) -> Column:
    """A worksheet's name: a dash for each character it may not have, 31 at most, never empty [H30]."""
    clean = F.trim(F.regexp_replace(name, r"[\[\]:*?/\\]", "-"))
    return F.substring(F.when(clean == "", "Sheet").otherwise(clean), 1, 31)


def restore_spaces(text: Column) -> Column:
    """Spaces that a recogniser lost, put back; nothing else is changed [H7]. A run of letters of twelve or more with
    capitals inside is opened at each capital: Java's lookarounds find these places from within the run (of 120 letters at most)."""
    inside = r"(?<=[a-z])(?=[A-Z])(?<=\b(?=[A-Za-z]{12,120}\b)[A-Za-z]{1,119})"
    out = F.regexp_replace(text, inside, " ")
    for place in LOST_SPACES:
        out = F.regexp_replace(out, place, " ")
    return out


def plain_maths(text: Column) -> Column:
    """Typeset notation as the same expression in plain text [H8]."""
    out = text
    for _ in range(4):
        out = F.regexp_replace(out, *FRACTION)
    for form in WRAPPERS:
        out = F.regexp_replace(out, *form)
    for symbol, plain in SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(plain))
    for form in DELIMITERS:
        out = F.regexp_replace(out, form, "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r" +([,.;:)])", "$1")
    return F.when(text.contains("\\") | text.contains("$"), out).otherwise(text)


def redact_text(text: Column) -> Column:
    """Bearer tokens, keys, account and identity numbers and addresses masked, in order, with Unicode's word classes [H9]."""
    out = text
    for pattern, mask in MASKS:
        out = F.regexp_replace(out, f"(?U){pattern}", mask)
    return out


def is_sensitive_key(name: Column) -> Column:
    """Whether a key's name holds one of the sensitive parts [P40]."""
    return F.exists(F.array(*map(F.lit, SENSITIVE_KEYS)), lambda k: F.contains(F.lower(name), k))


def redact_map(values: Column, limit: int = 512) -> Column:
    """A flat map of strings, sensitive keys masked whole, others as text, long ones cut [H10]."""

    def one(k: Column, v: Column) -> Column:
        clean = redact_text(v)
        cut = F.concat(F.substring(clean, 1, limit), F.lit("... [TRUNCATED: "), F.length(clean).cast("string"), F.lit(" chars]"))
        return F.when(is_sensitive_key(k), F.lit("[REDACTED]")).when(F.length(clean) > limit, cut).otherwise(clean)

    return F.transform_values(values, one)


def normalised(text: Column) -> Column:
    """Text for error rates: lower case, white space single, letters, digits and spaces only [H11]."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), "[^a-z0-9 ]", ""))


def alpha_ratio(text: Column) -> Column:
    """Share of letters, digits and white space [D5]."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", "")) / F.length(text))


def equipment_tags(text: Column) -> Column:
    """Equipment tags in order, each once [H19, E15]."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(EQUIPMENT_TAG), F.lit(0)))


def strip_markers(text: Column) -> Column:
    """Without citation markers, and no space left before punctuation [H17]."""
    bare = F.regexp_replace(text, r"(?is)[\[\(]{1,2}\s*cite\s*:\s*(.+?)\s*[\]\)]{1,2}", "")
    return F.trim(F.regexp_replace(bare, r"\s+([.,;:!?])", "$1"))


def marker_ids(text: Column) -> Column:
    """The ids that citation markers name, in order [H16]."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?is)[\[\(]{1,2}\s*cite\s*:\s*(.+?)\s*[\]\)]{1,2}"), F.lit(1))
    ids = F.flatten(F.transform(bodies, lambda b: F.split(b, r"(?i)[,;\s]+|[\]\)]\s*[\[\(]\s*cite\s*:\s*")))
    clean = F.transform(ids, lambda t: F.regexp_replace(F.btrim(F.trim(t), F.lit("[]()")), r"(?i)^cite:\s*", ""))
    return F.filter(clean, lambda t: t != "")


def ordinals(text: Column) -> Column:
    """Numbers of [n] references, in order [H16]."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[{1,2}\s*(\d{1,2})\s*\]{1,2}"), F.lit(1)), lambda n: n.cast("int"))


def sentences(text: Column) -> Column:
    """Sentences, with line ends as breaks; table rows, rules and headings dropped [H15]."""
    parts = F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: ~s.startswith("|") & ~s.startswith("#") & ~s.startswith("---") & (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) >= 3))


def snippet(text: Column, limit: int = 240) -> Column:
    """One line of at most limit characters, cut at the last space, with an ellipsis [B36]."""
    line = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(F.substring(line, 1, limit), r"\s\S*$", ""), F.lit("…")))


def summarised(text: Column, limit: int = 160) -> Column:
    """An argument for a log: cut with an ellipsis beyond limit [B38]."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def escaped_lines(text: Column) -> Column:
    """Lines of text whose line ends may be written as backslash n, without a trailing piece of the JSON around it [H22]."""
    broken = text
    for written, mark in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", " ")):
        broken = F.replace(broken, F.lit(written), F.lit(mark))

    def bare(line: Column) -> Column:
        cut = F.regexp_replace(F.trim(line), r"""["'`]\s*[}\])][\s"'`,;:}\])]*$""", "")
        return F.when(F.trim(cut) != "", cut).otherwise(F.trim(line))

    return F.filter(F.transform(F.split(broken, r"\r?\n"), bare), lambda s: s != "")


def body_blocks(text: Column) -> Column:
    """array<struct<type, text>>: list items by their marks, paragraphs otherwise [H23]."""
    mark = r"^\s*(?:[-*\u2022]|\d+[.)])\s+"
    return F.transform(escaped_lines(text), lambda s: F.struct(F.when(s.rlike(mark), "bullet").otherwise("paragraph").alias("type"), F.regexp_replace(s, mark, "").alias("text")))


#: Headings that only the report itself may have.
RESERVED_HEADINGS = ("provenance", "sources", "source", "references", "citations")


def safe_heading(heading: Column) -> Column:
    """A heading that does not pass for one of the report's own [H24]."""
    bare = F.lower(F.rtrim(F.regexp_replace(F.trim(heading), r"^\s*\d+[.)]?\s*", ""), F.lit(":")))
    return F.when(bare.isin(*RESERVED_HEADINGS), F.concat(F.rtrim(F.trim(heading), F.lit(":")), F.lit(" (as stated in the answer)"))).otherwise(heading)


def quantity_text(value: Column, places: int = 4) -> Column:
    """A number as an engineer writes it: rounded half to even, no trailing zeros [H31]."""
    s = F.bround(value, places).cast(f"decimal(38,{places})").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def canonical_json(*columns: str) -> Column:
    """Keys in order, compact, nulls written [K1]; for fixed columns."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def digest(json: Column) -> Column:
    return F.sha2(json, 256)


def name_uuid(namespace: str, name: Column) -> Column:
    """The UUID of version 5 of a name in a namespace, the same wherever it is computed [K5]."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def sortable_id(time: Column, content: Column, prefix: str = "") -> Column:
    """An id that sorts by time, and by content within a millisecond: 12 hexadecimal digits of time, 16 of a digest [I10]."""
    return F.concat(F.lit(prefix), F.lpad(F.lower(F.hex(F.unix_millis(time))), 12, "0"), F.substring(F.sha2(content, 256), 1, 16))


def stamp_of(name: Column, otherwise: Column) -> Column:
    """The time that a file's name gives (20290131T120000), or otherwise [I7]."""
    return F.coalesce(F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{8}T\d{6})", 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss")), otherwise)
