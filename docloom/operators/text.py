"""Text expressions: normalising, estimating, previews, links and forced windows. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW = 512
# Words in the names of metadata that must not be shown, and the metadata kept inside.
SECRET = ("api_key", "authorization", "credential", "password", "private_key", "secret", "token")
CLIP = 2000


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def normalize_text(col: Column) -> Column:
    """Line ends as LF, inline style attributes taken out, at most one empty line together, no white space around."""
    col = F.regexp_replace(col, r"""(?i)\s+style=("[^"]*"|'[^']*')""", "")
    lines = F.regexp_replace(F.regexp_replace(col, "\r\n?", "\n"), "\n{3,}", "\n\n")
    return strip(lines)


def collapsed(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", " "), "^ | $", "")


def estimate_tokens(col: Column) -> Column:
    """The offline estimate: a token for each four characters begun, white space collapsed; 0 for empty and null."""
    return F.coalesce(F.ceil(F.length(collapsed(col)) / 4), F.lit(0)).cast("long")


def preview(col: Column) -> Column:
    s = strip(col)
    return F.when(F.length(s) <= PREVIEW, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, PREVIEW - 1), r"(?U)\s+$", ""), F.lit("…")))


def image_urls(col: Column) -> Column:
    """Targets of Markdown images in order of first appearance, each once, without angle brackets and titles."""
    found = F.regexp_extract_all(col, F.lit(r"!\[[^\]]*\]\(\s*([^)\s]+)[^)]*\)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^<|>$", "")))


def rewrite_links(text: Column, links: Column) -> Column:
    """text with each key of the map links replaced by its value, longer keys first."""
    order = lambda a, b: F.when(F.length(a["key"]) > F.length(b["key"]), -1).when(F.length(a["key"]) < F.length(b["key"]), 1).otherwise(F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    entries = F.array_sort(F.map_entries(links), order)
    return F.aggregate(entries, text, lambda s, e: F.replace(s, e["key"], e["value"]))


def forced_windows(col: Column, chars: int) -> Column:
    """The text in windows of so many characters, stripped, empty ones left out."""
    n = F.ceil(F.length(col) / chars)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: strip(F.substring(col, ((i - 1) * chars + 1).cast("int"), F.lit(chars))))
    return F.filter(windows, lambda w: w != "")


def redact(metadata: Column) -> Column:
    """Values under names that hold a secret word replaced, other long ones clipped."""
    secret = F.lit("|".join(SECRET))
    return F.transform_values(metadata, lambda k, v: F.when(F.rlike(F.lower(k), secret), F.lit("[redacted]")).otherwise(F.substring(v, 1, CLIP)))


def drop_empty(metadata: Column) -> Column:
    """A map without null and blank values."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (strip(v) != ""))


def allowed_host(url: Column, rules: list[str]) -> Column:
    """Whether an https address is on the list: '*' any, '*.suffix' below the suffix but not it, else the host itself."""
    host = F.lower(F.regexp_extract(url, r"^https://(?:[^/@]*@)?([^/:?#]+)", 1))
    tests = [F.lit(r == "*") if r == "*" else host.endswith(r[1:].lower()) if r.startswith("*.") else host == r.lower() for r in rules]
    any_rule = F.lit(False)
    for t in tests:
        any_rule = any_rule | t
    return F.coalesce((host != "") & any_rule, F.lit(False))
