"""Presence rules. What counts as absent differs per operator, so each rule has its own helper."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Every white space character a text library strips, as a regex class: ASCII and Unicode white space
# and the four information separators. Spelled out, it matches far faster than the Unicode mode.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same characters one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(SPACE, c, re.ASCII))
# Any other character.
SOLID = SPACE.replace("[", "[^", 1)
# An inner run is tried once, at its first character, and never given back, so that long runs take linear time; what lies before is
# looked at only where a blank was met.
ENDS = rf"\A{SPACE}++|{SPACE}(?<!{SPACE}{{2}}){SPACE}*+\z"


def strip(c: Column) -> Column:
    """Trim every kind of white space at both ends.

    One regex pass: trimming by a list of characters allocates per character, which costs
    hundreds of microseconds on a whole text.
    """
    return F.regexp_replace(c, ENDS, "")


def strip_value(c: Column) -> Column:
    """As ``strip``, for a line or less: it trims by a list of characters, which takes less time on short texts."""
    return F.btrim(c, F.lit(SPACES))


def long_enough(c: Column, chars: int) -> Column:
    """Whether the stripped text has at least ``chars`` characters (two or more)."""
    return F.coalesce(c.rlike(rf"(?s){SOLID}.{{{chars - 2},}}{SOLID}"), F.lit(False))


def field(df: DataFrame, name: str) -> Column:
    """The named column, or a null string where the frame lacks it (an absent key)."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def present_truthy(df: DataFrame, name: str) -> Column:
    """Present unless null, empty text, zero or false."""
    if name not in df.columns:
        return F.lit(False)
    c, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        test = c != ""
    elif isinstance(dtype, T.BooleanType):
        test = c
    elif isinstance(dtype, T.NumericType):
        test = c != 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def present_trimmed(df: DataFrame, name: str) -> Column:
    """Present unless null or blank text; 0 and false are present."""
    if name not in df.columns:
        return F.lit(False)
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(strip(c) != "", F.lit(False))
    return c.isNotNull()


def present_notnull(df: DataFrame, name: str) -> Column:
    return F.col(name).isNotNull() if name in df.columns else F.lit(False)


def default_if_blank(c: Column, value: str) -> Column:
    """``c`` unless it is null or empty text, else ``value``."""
    return F.when(c != "", c).otherwise(F.lit(value))


def as_int(c: Column) -> Column:
    """Whole number in text, or null. Digits that do not fit a bigint become the largest one."""
    text = strip(c.cast("string"))
    whole = text.rlike(r"^[+-]?[0-9]+$")
    limit = F.when(text.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return F.when(whole, F.coalesce(text.try_cast("bigint"), limit))
