"""Scalar column expressions: LIKE patterns, token estimate, prompt lines, tag ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora import schemas


def contains_pattern(value: str) -> str:
    """``%value%`` for a case-insensitive LIKE.

    ``%`` and ``_`` typed by the user stay live wildcards (as in the source);
    a backslash is doubled so Spark's default escape character matches it
    literally instead of raising on an unknown escape.
    """
    return "%" + value.replace("\\", "\\\\") + "%"


def ilike_contains(col: Column | str, value: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.ilike(contains_pattern(value))


def has_wildcard(value: str) -> bool:
    """Whether ``contains_pattern`` leaves a live wildcard in the value."""
    return "%" in value or "_" in value


def token_estimate(text: Column) -> Column:
    """``len(text) // 4 + 100`` with ``len`` in code points; NULL text counts as ''."""
    n = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    return (n / F.lit(schemas.TOKEN_CHARS_PER_TOKEN)).cast("bigint") + F.lit(schemas.TOKEN_OVERHEAD)


def tagged_line(tag: str, id_col: Column, text_col: Column) -> Column:
    """``[<TAG><id>: <text>]`` followed by a newline."""
    return F.format_string("[" + tag + "%s: %s]\n", id_col.cast("string"), text_col)


def try_bigint(c: Column) -> Column:
    """String to BIGINT; out-of-range or non-numeric gives NULL (ANSI mode safe)."""
    return c.try_cast("bigint")


def lenient_tag_id(value: Column, tag: str) -> Column:
    """``<TAG>`` then digits; text after the digits is tolerated."""
    digits = F.regexp_extract(value, "^" + tag + r"(\d+)", 1)
    return try_bigint(F.nullif(digits, F.lit("")))


def strict_tag_id(value: Column, tag: str) -> Column:
    """Exactly ``<TAG><digits>``; anything else is no id."""
    digits = F.regexp_extract(value, "^" + tag + r"(\d+)$", 1)
    return try_bigint(F.nullif(digits, F.lit("")))


def generated_group_name(name: Column, url: Column) -> Column:
    """A group created from a url without a name is called ``Group from <url>``."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Group from "), url))
