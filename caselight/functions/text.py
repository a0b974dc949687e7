"""Text and code cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caselight.functions import sql
from caselight.functions.presence import strip
from caselight.schemas import VALUE_LABELS


def clean_text_sql(value: str) -> str:
    """SQL text of ``clean_text_field``.

    Labels are tried once each in their listed order, so a chain of optional groups in that
    order removes exactly what one pass per label would, with a single regex.
    """
    chain = "".join(rf"(?:{label}:\s*)?" for label in VALUE_LABELS)
    unlabelled = f"regexp_replace({sql.strip(value)}, {sql.regex('^' + chain, 'i')}, '')"
    squeezed = f"regexp_replace({unlabelled}, {sql.regex(r'\s+')}, ' ')"
    return f"coalesce(trim({squeezed}), '')"  # only single blanks are left


def clean_text_field(value: str) -> Column:
    """Strip leading value labels of a column and squeeze white space; null becomes empty text."""
    return F.expr(clean_text_sql(value))


def normalize_text(c: Column) -> Column:
    """Comparison form: lower case, trimmed, no punctuation, single spaces.

    There is no second trim, so ``"- a"`` becomes ``" a"``. Null becomes empty text.
    """
    bare = F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s]", "")
    return F.coalesce(F.regexp_replace(bare, r"(?U)\s+", " "), F.lit(""))


def code_to_bool(c: Column) -> Column:
    """yes / true / y in any case is true, other text false."""
    return F.lower(c).isin("yes", "true", "y")


def normalize_gender(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.isin("m", "male"), "M").when(low.isin("f", "female"), "F").otherwise("Other")
    )


def normalize_status(c: Column) -> Column:
    """Old status words pass / fail to their present names."""
    return F.when(c == "pass", "completed").when(c == "fail", "failed").otherwise(c)


def status_label(c: Column) -> Column:
    """Status shown to a reader; an unknown status shows as Pending."""
    norm = normalize_status(c)
    known = norm.isin("completed", "processing", "failed", "pending", "uploaded")
    return F.when(known, F.initcap(norm)).otherwise("Pending")


def bucket(c: Column, vocabulary: list[str]) -> Column:
    """Exact vocabulary match, anything else Unknown."""
    return F.when(c.isin(vocabulary), c).otherwise("Unknown")


def progress_percentage(c: Column, stages: list[str]) -> Column:
    """Percent done from a stage name; failed is 80 and an unknown stage counts as the first."""
    position = F.array_position(F.array(*[F.lit(s) for s in stages]), c)
    before = F.greatest(F.coalesce(position, F.lit(0)) - 1, F.lit(0))
    return (
        F.when(c.isin("completed", "pass"), F.lit(100.0))
        .when(c.isin("failed", "fail"), F.lit(80.0))
        .otherwise(before / F.lit(len(stages)) * 100)
    )


def enum_sql(value: str, options: list[str]) -> str:
    """SQL text of ``normalize_enum``."""
    text = sql.strip(value)
    listed, lowered = sql.options(options), sql.options([o.lower() for o in options])

    def option_for(word: str) -> str:
        return f"get(array({listed}), CAST(array_position(array({lowered}), {word}) AS INT) - 1)"

    word = f"get(filter(split(lower({text}), {sql.regex(r'\s+')}), w -> w IN ({lowered})), 0)"
    exact = f"CASE WHEN {text} IN ({listed}) THEN {text} END"
    return f"coalesce({exact}, {option_for(f'lower({text})')}, {option_for(word)})"


def normalize_enum(value: str, options: list[str]) -> Column:
    """Match a vocabulary exactly, then in any case, then by the first word that is an option."""
    return F.expr(enum_sql(value, options))


def postal_codes(c: Column) -> Column:
    """Every five or six digit word."""
    return F.regexp_extract_all(c, F.lit(r"\b(\d{5,6})\b"), F.lit(1))
