"""Text quality checks on whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caselight.functions.presence import strip
from caselight.schemas import MIN_TEXT_CHARS

PUNCTUATION = ".,;:!?-()[]{}"


def _count(c: Column, char_class: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, f"(?U){char_class}", ""))


def is_binary_junk(c: Column) -> Column:
    """Too short, starting like a binary file, or with over a fifth control characters."""
    head = F.substring(c, 1, 200)
    marker = head.rlike("(?iu)^(?:%PDF|\\x00{4,}|\\u00ff\\u00d8\\u00ff|\\u0089PNG)")
    control = F.length(c) - F.length(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))
    junk = (
        (F.length(strip(c)) < 10)
        | marker
        | strip(c).startswith("%PDF")
        | (control * 5 > F.length(c))
    )
    return F.coalesce(junk, F.lit(True))


def clean_text(c: Column) -> Column:
    """Drop unprintable characters, squeeze runs of space, drop lines that are mostly symbols.

    Tabs and characters beyond the basic plane go first; a run of three or more white space
    characters, line ends included, becomes two blanks.
    """
    printable = F.regexp_replace(c, "[^\\x20-\\x7E\\n\\r\\u0080-\\uFFFF]|[\\x{10000}-\\x{10FFFF}]", "")
    squeezed = strip(F.regexp_replace(printable, r"(?U)\s{3,}", "  "))
    keep = F.filter(
        F.split(squeezed, "\n"),
        lambda line: (line == "") | (_count(line, r"[\p{L}\p{N}\s]") * 2 > F.length(line)),
    )
    return F.coalesce(F.array_join(keep, "\n"), F.lit(""))


def text_confidence(c: Column) -> Column:
    """Score 0..1 from the shares of letters and digits, white space and punctuation."""
    total = F.nullif(F.length(c), F.lit(0))
    alnum = _count(c, r"[\p{L}\p{N}]") / total
    space = _count(c, r"\s") / total
    punct = (total - F.length(F.translate(c, PUNCTUATION, ""))) / total

    def inside(x: Column, low: float, high: float) -> Column:
        return (x > low) & (x < high)

    tenths = (
        F.when(inside(alnum, 0.5, 0.8), 4).when(inside(alnum, 0.4, 0.9), 3).otherwise(1)
        + F.when(inside(space, 0.15, 0.35), 3).when(inside(space, 0.1, 0.4), 2).otherwise(1)
        + F.when(inside(punct, 0.01, 0.2), 3).otherwise(1)
    )
    return F.when(total > 0, F.least(tenths / 10, F.lit(1.0))).otherwise(F.lit(0.0))


def rate_quality(text: Column, pages: Column, total_pages: Column, confidence: Column, error: Column) -> Column:
    """high / medium / low from the page rate and the confidence."""
    rate = F.when(total_pages > 0, pages / F.nullif(total_pages, F.lit(0))).otherwise(0.0)
    short = F.length(strip(F.coalesce(text, F.lit("")))) < MIN_TEXT_CHARS
    return (
        F.when(error.isNotNull() | short, "low")
        .when((rate > 0.9) & (confidence > 0.85), "high")
        .when((rate > 0.75) | (confidence > 0.7), "medium")
        .otherwise("low")
    )


def extraction_warnings(text: Column, pages: Column, total_pages: Column) -> Column:
    size = F.length(strip(text))
    percent = F.format_string("%.0f", F.bround(pages / F.nullif(total_pages, F.lit(0)) * 100))
    return F.array_compact(
        F.array(
            F.when(size < 100, F.format_string("Very short extraction (%d chars)", size)).when(
                size < 500, F.format_string("Short extraction (%d chars)", size)
            ),
            F.when(
                (size > 0) & (total_pages > 0) & (pages / F.nullif(total_pages, F.lit(0)) < 0.5),
                F.format_string("Low page extraction rate (%s%%)", percent),
            ),
        )
    )


def checked_quality(text: Column, quality: Column) -> Column:
    """Quality after the length check."""
    size = F.length(strip(F.coalesce(text, F.lit(""))))
    return F.when(size < 100, "low").when((size < 500) & (quality == "unknown"), "medium").otherwise(quality)


def standardize_table(c: Column) -> Column:
    """Rows of cells to pipe-separated lines with a rule under the header."""
    rows = F.transform(
        c,
        lambda row: F.transform(
            row, lambda cell: strip(F.regexp_replace(F.coalesce(cell, F.lit("")), "[\n\r]", " "))
        ),
    )
    lines = F.transform(rows, lambda row: F.array_join(row, " | "))
    rule = F.array_join(F.transform(F.get(rows, 0), lambda _: F.lit("---")), " | ")
    ruled = F.concat(
        F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    )
    return F.when(F.size(c) > 1, F.array_join(ruled, "\n")).otherwise(
        F.coalesce(F.array_join(lines, "\n"), F.lit(""))
    )
