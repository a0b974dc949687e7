"""Small helpers for expressions written as Spark SQL text.

A rule set compiles to hundreds of nested expressions. Written as text, each rule reaches the
parser in one call instead of one call per node.
"""

from __future__ import annotations

import re

from caselight.functions.presence import ENDS, SPACE


def quote(text: str | None) -> str:
    """A text literal; None gives a null string."""
    if text is None:
        return "CAST(NULL AS STRING)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex(pattern: str, flags: str = "d") -> str:
    """A regex as a raw literal, ``\\s`` outside brackets meaning Unicode white space."""
    spaced = re.sub(r"\[[^\]]*\]|\\s", lambda m: SPACE if m.group(0) == r"\s" else m.group(0), pattern)
    return f'r"(?{flags}){spaced}"'


def strip(value: str) -> str:
    return f'regexp_replace({value}, r"{ENDS}", "")'


def column(names, name: str) -> str:
    """A column by name, or a null string where the frame lacks it."""
    return f"`{name}`" if name in names else "CAST(NULL AS STRING)"


def options(values: list[str]) -> str:
    return ", ".join(quote(v) for v in values)


def integer(value: str) -> str:
    """Whole number in text, or null. Digits that do not fit a bigint become the largest one."""
    text = strip(f"CAST({value} AS STRING)")
    limit = f"CASE WHEN startswith({text}, '-') THEN -9223372036854775807L ELSE 9223372036854775807L END"
    return f"CASE WHEN {text} rlike '^[+-]?[0-9]+$' THEN coalesce(try_cast({text} AS BIGINT), {limit}) END"
