"""Text expressions: header names, redaction, truncation, mentions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Assigned secrets, bearer headers, and bare keys.
ASSIGNED = r"""(?i)\b((?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret|token))(["']?\s*[:=]\s*["']?)[^\s"',;]{6,}"""
BEARER, BARE = r"(?i)\b(bearer\s+)[A-Za-z0-9._\-]{12,}", r"\bsk-[A-Za-z0-9_\-]{12,}"


def snake_case(name: str) -> str:
    out = name.strip().lower().replace("%", " percent ").replace("#", " number ")
    return re.sub(r"[^a-z0-9]+", "_", out).strip("_")


def redacted(c: Column) -> Column:
    out = F.regexp_replace(c, ASSIGNED, "$1$2[REDACTED]")
    return F.regexp_replace(F.regexp_replace(out, BEARER, "$1[REDACTED]"), BARE, "[REDACTED]")


def truncated(c: Column, n: int) -> Column:
    more = F.char_length(c) - n
    return F.when(more > 0, F.concat(F.left(c, F.lit(n)), F.lit("…[truncated "), more.cast("string"), F.lit(" chars]"))).otherwise(c)


def has_text(c: Column) -> Column:
    """Whether anything but white space, of any script, is there."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def mentioned(c: Column, pattern: str) -> Column:
    """Distinct matches in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0), F.lower)))


def short_id(*parts: Column, n: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, n)


def matches_any(c: Column, markers: list[str]) -> Column:
    return F.lower(c).rlike("|".join(re.escape(m.lower()) for m in markers))


def without_fence(c: Column) -> Column:
    """Text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?i:json)?", ""), r"```$", ""))
