"""Scalar functions of the engine as Column expressions (ids, paths, redaction, text measures)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT = "\u001f"
#: White space as ECMAScript counts it (fixed values), for trims and squeezes.
SPACE = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def truthy(*cols: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c if isinstance(c, Column) else F.col(c), F.lit("")) for c in cols])


def json_text(value: Column) -> Column:
    """A string as a JSON string; null as null."""
    return F.coalesce(F.regexp_replace(F.substring(F.to_json(F.struct(value.alias("v"))), 6, 1 << 30), "\\}$", ""), F.lit("null"))


def stable_hash(fields: dict[str, Column], numbers: tuple[str, ...] = (), length: int = 64) -> Column:
    """sha256 of the key-sorted compact JSON of fields, cut to length hex digits; numbers names those written bare."""
    parts: list[Column] = []
    for name in sorted(fields):
        value = F.coalesce(fields[name].cast("string"), F.lit("null")) if name in numbers else F.when(fields[name].isNull(), F.lit("null")).otherwise(json_text(fields[name]))
        parts += [F.lit(f'"{name}":'), value, F.lit(",")]
    return F.substring(F.sha2(F.concat(F.lit("{"), *parts[:-1], F.lit("}")), 256), 1, length)


def short_name(name: Column | str) -> Column:
    """The last dotted segment; unknown if there is none."""
    n = name if isinstance(name, Column) else F.col(name)
    return F.coalesce(F.nullif(F.substring_index(n, ".", -1), F.lit("")), F.lit("unknown"))


def same_name(actual: Column, expected: Column) -> Column:
    """Equal, or equal last dotted segments; an empty name equals nothing."""
    last = lambda c: F.substring_index(c, ".", -1)
    return F.coalesce((actual != "") & (expected != "") & ((actual == expected) | (last(actual) == last(expected))), F.lit(False))


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def nfkd(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def normalized_term(value: Column) -> Column:
    """NFC, trimmed."""
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")
    return trimmed(nfc(value))


def squeeze(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]+", " "))


def compact_snippet(text: Column, most: int) -> Column:
    """White space squeezed; over most characters, cut to most - 1 and an ellipsis."""
    s = squeeze(text)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def path_key(path: Column, case_sensitive: Column | bool = True) -> Column:
    p = F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "^(\\./)+", "")
    keep = case_sensitive if isinstance(case_sensitive, Column) else F.lit(case_sensitive)
    return F.when(keep, p).otherwise(F.lower(p))


def identity_key(*cols: Column) -> Column:
    return F.concat_ws(UNIT, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def slug(value: Column) -> Column:
    """NFKD, runs of what is no ASCII letter or digit to -, no - at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(nfkd(value), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def text_hash(text: Column) -> Column:
    """sha256 with line ends as \\n."""
    return F.sha2(F.regexp_replace(text, "\\r\\n?", "\n"), 256)


def safe_id(value: Column) -> Column:
    """A slug of the value, or twelve digits of its hash if none is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.when(s == "", F.substring(F.sha2(value, 256), 1, 12)).otherwise(s)


def estimate_tokens(size: Column, ratio: float = 4.0) -> Column:
    return F.ceil(F.greatest(size, F.lit(0)) / ratio)


def task_id(branch: Column) -> Column:
    return F.nullif(F.regexp_extract(branch, "[A-Z][A-Z0-9]+-\\d+", 0), F.lit(""))


#: What makes a line a secret, and what is put in its place.
SECRET_LINE = r"""-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:\b(api[_-]?key|access[_-]?token|client[_-]?secret|password)\b\s*[:=]\s*["'][^"']+)"""
SECRET_MARK = "[REDACTED: potential secret]"
#: Keys whose values are never shown, and the mark.
SENSITIVE_KEY = r"(?i)(?:authorization|cookie|credential|password|passwd|private[_-]?key|secret|session|token|api[_-]?key)"
MARK = "[REDACTED]"
#: How many characters of a text and how many entries of a map an event keeps.
MOST_TEXT, MOST_ENTRIES = 1000, 100


def sanitize_lines(text: Column) -> Column:
    """Each line that holds a private key or a quoted credential, as SECRET_MARK."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(SECRET_LINE), F.lit(SECRET_MARK)).otherwise(x)), "\n")


def redact(value: Column, most: int = MOST_TEXT) -> Column:
    """Bearer tokens, sk- keys, assignments to names of secrets (in any case) and URL user parts out; a longer value is cut to most, with an ellipsis as its last."""
    begin = "(?<![A-Za-z0-9_])"  # a word's, whatever the letters that are no ASCII
    out = F.regexp_replace(value, f"(?i){begin}Bearer[ \\t-\\r]+[A-Z0-9._~+/=-]+", f"Bearer {MARK}")
    out = F.regexp_replace(out, f"{begin}sk-[A-Za-z0-9_-]{{8,}}(?![A-Za-z0-9_])", MARK)
    out = F.regexp_replace(out, f"(?i){begin}([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|API_KEY|PRIVATE_KEY)[A-Z0-9_]*)=([^ \\t-\\r]+)", f"$1={MARK}")
    out = F.regexp_replace(out, "(?i)(https?://)[^ \\t-\\r/@:]+:[^ \\t-\\r/@]+@", f"$1{MARK}@")
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 1), F.lit("…"))).otherwise(out)


def redact_map(props: Column) -> Column:
    """A string map's first MOST_ENTRIES, with the values of sensitive keys out and the others redacted."""
    some = F.map_from_entries(F.slice(F.map_entries(props), 1, MOST_ENTRIES))
    return F.transform_values(some, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit(MARK)).otherwise(redact(v)))


def wildcard(pattern: str) -> str:
    """An anchored case-insensitive regex of a pattern whose * stands for anything; commas separate alternatives."""
    import re

    return "(?i)^(?:" + "|".join(".*".join(re.escape(x) for x in p.strip().split("*")) for p in pattern.split(",") if p.strip()) + ")$"


def anchor_ok(content_hash: Column, expected_hash: Column, lines: Column, start: Column, end: Column, fragment: Column) -> Column:
    """Whether a source anchor holds: hash, 1-based inclusive range, and the fragment's exact text."""
    inside = (start >= 1) & (end >= start) & (end <= F.size(lines))
    piece = F.when(inside, F.array_join(F.slice(lines, F.when(inside, start).otherwise(1), F.when(inside, end - start + 1).otherwise(0)), "\n"))
    return F.coalesce((content_hash == F.lower(expected_hash)) & inside & (piece == F.regexp_replace(fragment, "\\r\\n?", "\n")), F.lit(False))


#: Proof statuses that stay as they are, and what the others count as.
KEPT_STATUSES = ("confirmed", "checked-no-usage", "not-applicable", "reference-only", "noise", "partial", "unknown", "candidate")
CANDIDATE_STATUSES = ("matched", "candidate-empty")
UNKNOWN_STATUSES = ("closed", "unverified", "unchecked", "unresolved", "tool-unavailable", "pending", "not-checked")
#: Decisions about a product, which prove nothing.
DECISIONS = ("product-gap", "implementation-gap", "open-product-decision", "known", "requires-change", "requires-implementation", "design-decision", "reference-pattern", "existing", "missing", "blocked", "implementation-required")


def normalize_status(status: Column) -> Column:
    """A planning fact's status as a proof status; none, an open state or a decision is unknown, a value outside the sets an error."""
    known = F.when(status.isNull() | status.isin("", *UNKNOWN_STATUSES, *DECISIONS), "unknown").when(status.isin(*KEPT_STATUSES), status).when(status == "source-confirmed", "confirmed")
    return known.when(status.isin(*CANDIDATE_STATUSES), "candidate").otherwise(F.raise_error(F.concat(F.lit("unsupported planning status: "), status)))


def expected_resolution(scope: Column, availability: Column) -> Column:
    """What becomes of a source: out of scope, to be reviewed, to be asked for, or a finding that blocks."""
    asked = availability.isin("NOT_PROVIDED_TO_AGENT", "TECHNICALLY_UNREADABLE")
    return F.when(scope.startswith("OUT_OF_SCOPE_"), "EXCLUDED_WITH_REASON").when(availability == "AVAILABLE", "PENDING_REVIEW").when(asked, "INPUT_REQUIRED").otherwise("BLOCKING_FINDING_CREATED")


def rule_statement(text: Column) -> Column:
    """name: value pairs and const formulas in a text, distinct, joined by semicolons."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\w+: ?(?:-?\d+(?:\.\d+)?|\[[^\]]*\]))"), F.lit(1))
    consts = F.regexp_extract_all(text, F.lit(r"(const \w+ = [^;]+;)"), F.lit(1))
    return F.array_join(F.array_distinct(F.concat(pairs, consts)), "; ")
