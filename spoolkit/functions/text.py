"""Caps, redaction, token sets, content ids and other text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoolkit.functions.errors import normalize_error_text, rewritten

MARKER = " …[truncated]… "
CAP = 2048

# What is cut out of texts that are shown, in order: in reports and briefs, in exemplars of the long tail, and in captured calls.
_HOME = (r"(?i)\$HOME\b", "<HOME>")
_EMAIL = (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "<EMAIL>")
_HEX = (r"\b(?=[A-Fa-f0-9]{32,}\b)(?=[A-Fa-f0-9]*[A-Fa-f])(?=[A-Fa-f0-9]*\d)[A-Fa-f0-9]+\b", "<SECRET>")
_BASE64 = (r"\b(?=[A-Za-z0-9+/]{40,}={0,2}\b)(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*\d)[A-Za-z0-9+/]+={0,2}\b", "<SECRET>")
REPORT_REDACTIONS = (
    _HOME,
    _EMAIL,
    (r"\b(?:sk-[A-Za-z0-9_-]{8,}|hf_[A-Za-z0-9_-]{8,})\b", "<SECRET>"),
    _HEX,
    _BASE64,
    (r"""(?:^|(?<=\s|["'=(]))/(?:[^\s"'`,;:)]+/?)+""", "<PATH>"),
)
EXEMPLAR_REDACTIONS = (
    _HOME,
    (r"""~/(?:[^\s"'`,;:)]+/?)+""", "<PATH>"),
    _EMAIL,
    (r"\b(?:(?:sk|rk|pk)-[A-Za-z0-9_-]{8,}|hf_[A-Za-z0-9_-]{8,})\b", "<SECRET>"),
    (r"(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*[^\s,;]+", "$1=<SECRET>"),
    _HEX,
    _BASE64,
)
CAPTURE_REDACTIONS = (
    (r"\b(?:sk|rk|pk)-[A-Za-z0-9_-]{8,}\b", "<SECRET>"),
    (r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*[^\s,;]+", r"\$1=<SECRET>"),
    (r"(?:/[A-Za-z0-9_.@%+,:=~-]+)+", "<PATH>"),
)


def cap_middle(text: Column, size: int = CAP) -> Column:
    """Head and tail of a long text around a marker; null is empty."""
    text = F.coalesce(text, F.lit(""))
    rest = size - len(MARKER)
    head = -(-rest // 2)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(MARKER), F.right(text, F.lit(rest - head))))


def cap_head(text: Column, size: int = CAP) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def shorten(text: Column, size: int = 240) -> Column:
    """The text, or its beginning without trailing blanks and an ellipsis."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, size - 1), r"\s+\z", ""), F.lit("…")))


def redact(text: Column, rules: tuple[tuple[str, str], ...] = REPORT_REDACTIONS) -> Column:
    return rewritten(F.coalesce(text, F.lit("")), rules)


def redact_exemplar(text: Column) -> Column:
    """Redaction of the normal form, 240 characters."""
    return F.substring(redact(normalize_error_text(text), EXEMPLAR_REDACTIONS), 1, 240)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three or more letters or digits, placeholders left out."""
    bare = F.lower(F.regexp_replace(normalize_error_text(text), "(?i)<[A-Z][A-Z0-9_]*>", " "))
    return F.array_distinct(F.filter(F.split(bare, "[^a-z0-9]+"), lambda x: F.length(x) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def content_id(prefix: str, fields: dict[str, Column]) -> Column:
    """prefix_sha256: and 16 hex digits over the JSON of the fields, sorted by name."""
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}_sha256:"), F.substring(F.sha2(body, 256), 1, 16))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sparkline(values: Column) -> Column:
    """Eight heights between the least and the largest value."""
    bars = F.array(*map(F.lit, "▁▂▃▄▅▆▇█"))
    low, high = F.array_min(values), F.array_max(values)
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.array_join(F.transform(values, lambda v: F.element_at(bars, F.least(F.lit(8), F.floor((v - low) / span * 7 + 0.5).cast("int") + 1))), "")


def changed_lines(before: Column, after: Column) -> Column:
    """Lines left on both sides once a common beginning and end are taken off."""
    a, b = F.split(before, "\n", -1), F.split(after, "\n", -1)
    n = F.least(F.size(a), F.size(b))
    same = lambda x, y, m: F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: (i <= m) & (F.try_element_at(x, i) == F.try_element_at(y, i))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    head = same(a, b, n)
    tail = same(F.reverse(a), F.reverse(b), n - head)
    return F.size(a) + F.size(b) - 2 * (head + tail)


def first_of(column: Column, allowed: Sequence[str], otherwise: str = "unknown") -> Column:
    """``column`` where it is one of ``allowed``."""
    return F.when(column.isin(*allowed), column).otherwise(F.lit(otherwise))
