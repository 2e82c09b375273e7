"""Secret scans with corpus-wide ownership frequency [operator 10].

Candidates are found in every whole text; the hash of each candidate's value is aggregated over the corpus by distinct
owners and distinct repositories. A value that several owners hold is a copied example; one that stays with one owner,
looks random and is no placeholder looks live. Only the hashes of candidates are shuffled, partly aggregated, never texts.

Base kinds are assign, access and hex; the method adds spans of the kinds jwt, pem and vendor. Offsets are code points,
ends exclusive. A pem span goes through its END line, or without one to the end of the base64 after the header, and its
value is the key's body without white space, so each key has an ownership of its own. A value hash is the 128-bit start of SHA-256, so secrets are not copied about.

Cases: a null text counts as empty; a null owner is one owner of its own; texts are read whole, very long ones and very
long keys too; spans of one start are in the order of the kinds; ids may be null or repeated (a repository is a
document here, known by its id: repeated rows count once in the frequencies, and each row has its result); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batch, frugal, materialise, unused

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_SPACE = re.compile(r"(?:\s|\\[nr])+")
_BLOCK = re.compile(r"(?:(?:\s|\\[nr])*+(?:(?:Proc-Type|DEK-Info):[^\n\\]*|[A-Za-z0-9+/]{16,}+={0,2}))*+(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{1,15}={1,2})?")
VENDOR = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35})")
KINDS = ("assign", "access", "hex", "jwt", "pem", "vendor")
_PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|redacted|your|xxxx|test|0123456789|abcdef0", re.I)
#: Owners from which on a value is a copied example, and bits a character of a random-looking value.
MIN_OWNERS, MIN_BITS = 3, 2.5
#: Characters of base64 alone from which on a value is no placeholder.
LONG = 256
_FOUND = "doc_id bigint, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, hashes array<binary>, random array<boolean>"
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("hashes", pa.list_(pa.binary())), ("random", pa.list_(pa.bool_()))]
)


def _key(text: str, header: re.Match) -> tuple[int, str]:
    """End and value of the private key that the header opens: the END line's end, if it comes before another header, or that of
    the base64 block. Headers share the text out among them, so many of them take no longer than one."""
    at = header.end()
    other = text.find("-----BEGIN ", at)
    stop = text.find(line := header[0].replace("BEGIN", "END", 1), at, other if other >= 0 else len(text))
    end = stop + len(line) if stop >= 0 else _BLOCK.match(text, at).end()
    return end, _SPACE.sub("", text[at : stop if stop >= 0 else end]) or header[0]


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of every span, by start, then kind."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, pattern, hint in ((1, ACCESS, "AKIA"), (2, HEX, ""), (3, JWT, "eyJ"), (5, VENDOR, "")):
        if not hint or hint in text:
            out += [(m.start(), kind, m.end(), m[0]) for m in pattern.finditer(text)]
    if "PRIVATE KEY" in text:
        out += [(m.start(), 4, *_key(text, m)) for m in PEM.finditer(text)]
    return sorted(out)


def looks_random(value: str) -> bool:
    """Whether the value's characters are spread as a generated secret's are, and it names no placeholder."""
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    # in a long key's base64 a placeholder's few letters come up by chance
    return bits >= MIN_BITS and (len(value) > LONG and value.isascii() and _BLOCK.fullmatch(value) is not None or not _PLACEHOLDER.search(value))


def spans_text(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found)


def value_hash(value: str) -> bytes:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:16]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, owner, text in zip(b.column("doc_id").to_pylist(), b.column("owner").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = find(text)
            n = Counter(k for _, k, _, _ in found)
            of_base = spans_text([x for x in found if x[1] < 3])
            rows.append((i, owner, n[0], n[1], n[2], hashlib.sha256(of_base.encode()).hexdigest(), spans_text(found), [value_hash(x[3]) for x in found], [looks_random(x[3]) for x in found]))
        yield batch(_OUT, list(zip(*rows, strict=True)) or [[]] * 9)


def candidates(docs: DataFrame, owner_col: str = "source") -> DataFrame:
    """Each document's spans with their values' hashes, written to the shared folder: the texts are scanned once."""
    rows = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(_scan, _FOUND).withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories, copied: one row for each candidate value. Distinct owners and repositories are
    reduced by key before the counts, so a value that a third of the corpus holds is summed in parts."""
    one = found.where(F.size("hashes") > 0).select("doc_id", F.coalesce(F.concat(F.lit("o"), "owner"), F.lit("")).alias("owner"), F.explode(F.array_distinct("hashes")).alias("hash"))
    repositories = one.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
    owners = repositories.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")).withColumn("copied", F.col("n_owners") >= MIN_OWNERS)


def scan(docs: DataFrame, owner_col: str = "source") -> DataFrame:
    """doc_id, the base columns, spans, and how many spans are copied examples (n_copied) or look live (n_live)."""
    found = candidates(docs, owner_col)
    marks = (
        found.where(F.size("hashes") > 0)
        .select("row", F.posexplode(F.arrays_zip("hashes", "random")).alias("k", "x"))
        .select("row", F.col("x.hashes").alias("hash"), F.col("x.random").alias("random"))
        .join(ownership(found), "hash")
        .groupBy("row")
        .agg(F.sum(F.col("copied").cast("long")).alias("n_copied"), F.sum((~F.col("copied") & F.col("random")).cast("long")).alias("n_live"))
    )
    zero = F.lit(0).cast("long")
    return found.join(marks, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.coalesce("n_copied", zero).alias("n_copied"), F.coalesce("n_live", zero).alias("n_live"))


def redact(docs: DataFrame, owner_col: str = "source") -> DataFrame:
    """The documents, each span that looks live replaced by [kind]; copied examples stay. All columns are kept; n_chars,
    where there is one, follows the text. The copied values met in several owners are looked up by a join on each
    span's hash, and come back to the documents by their id and text hash."""
    small = frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col(owner_col).cast("string").alias("owner"), "text")
    spans = "doc_id bigint, th bigint, owner string, hashes array<binary>"
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("owner", pa.string()), ("hashes", pa.list_(pa.binary()))])

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                got = {value_hash(x[3]) for x in find(r["text"]) if looks_random(x[3])}
                if got:
                    rows.append((r["doc_id"], r["th"], r["owner"], sorted(got)))
            yield batch(out, list(zip(*rows, strict=True)) or [[]] * 4)

    found = materialise(small.mapInArrow(live, spans), "redact")
    i, t, of, th, gone = (unused(docs, n) for n in ("id_", "text_hash", "of_id", "of_text", "gone"))
    hashes = (
        found.select("doc_id", "th", F.explode("hashes").alias("hash"))
        .join(ownership(found).where("not copied").select("hash"), "hash")
        .groupBy(F.col("doc_id").alias(of), F.col("th").alias(th))
        .agg(F.collect_set("hash").alias(gone))
    )
    keyed = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.xxhash64("text")})
    joined = keyed.join(hashes.hint("shuffle_hash"), F.col(i).eqNullSafe(F.col(of)) & (F.col(t) == F.col(th)), "left")

    @F.pandas_udf("string")
    def clean(text, hashes):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([t if h is None else _without(t, {bytes(x) for x in h}) for t, h in zip(text, hashes, strict=True)])

    columns = [F.col(c) if c != "text" else F.when(F.col(gone).isNull(), F.col("text")).otherwise(clean("text", gone)).alias("text") for c in docs.columns]
    out_docs = joined.select(*columns)
    return out_docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out_docs


def _without(text: str, live: set[bytes]) -> str:
    """The text with each span whose value is in live replaced; overlapping spans are replaced as one."""
    out, at, end = [], 0, 0
    for a, k, b, v in find(text):
        if value_hash(v) not in live:
            continue
        if a >= end:
            out += [text[at:a], f"[{KINDS[k]}]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])
