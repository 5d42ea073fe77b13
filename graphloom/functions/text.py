"""Column helpers for the scalar functions that cross-reference queries use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column | str) -> Column:
    """JSON text as a variant; null for malformed text."""
    return F.try_parse_json(c)


def json_field(c: Column | str, path: str, kind: str = "string") -> Column:
    """The value at ``path`` of JSON text; null where the text is malformed, the path absent or the value of another kind. Truth values read as true/false."""
    return F.try_variant_get(parsed(c), path, kind)


def like_ci(c: Column, pattern: str) -> Column:
    """LIKE without regard to case; ``\\`` escapes."""
    return F.ilike(c, F.lit(pattern))


def glob(c: Column, pattern: str) -> Column:
    """Case-sensitive glob over the whole text: ``*`` any text, ``?`` one character, ``[...]`` a set."""
    out = "".join(".*" if p == "*" else "." if p == "?" else p if p.startswith("[") else re.escape(p) for p in re.findall(r"\*|\?|\[[^\]]+\]|[^*?\[]+|\[", pattern))
    return F.rlike(c, F.lit(f"(?s)^{out}$"))


def to_part(raw: Column) -> Column:
    """The part before the first ``::``, null without one."""
    return F.when(raw.contains("::"), F.substring_index(raw, "::", 1))


def leaf_part(raw: Column) -> Column:
    """The part after the first ``::``, the whole without one."""
    return F.when(raw.contains("::"), F.regexp_replace(raw, r"^(?s).*?::", "")).otherwise(raw)


def int_flag(c: Column) -> Column:
    """A truth value as 0 or 1."""
    return c.cast("int")
