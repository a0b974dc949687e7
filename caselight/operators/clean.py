"""Cleaning, renaming and classifying form rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from caselight.functions.dates import clean_date_sql, normalize_date_format
from caselight.functions.presence import default_if_blank, field, present_truthy
from caselight.functions.sql import strip
from caselight.functions.text import clean_text_sql
from caselight.schemas import (
    ADR_INDICATORS,
    BATCH_REPORTER,
    DATE_FIELDS,
    DMF_INDICATORS,
    SINGLE_REPORTER,
    TEXT_FIELDS,
)


def clean_forms(df: DataFrame, key: str = "id", is_batch: Column | None = None) -> DataFrame:
    """Clean every text column of a form table by its field class.

    Absent values (null, empty text) become null. ``reporter_name`` is filled when blank or
    ``MISSING``, except on a row where no field at all is present. Columns whose name starts with
    an underscore are carried along. One projection, no shuffle.
    """
    batch = F.lit(False) if is_batch is None else F.coalesce(is_batch, F.lit(False))
    fields = [f for f in df.schema.fields if f.name != key and not f.name.startswith("_")]
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]

    def cleaned(name: str) -> str:
        c = f"`{name}`"
        if name in TEXT_FIELDS:
            value = clean_text_sql(c)
        elif name in DATE_FIELDS:
            value = clean_date_sql(c)
        else:
            value = strip(c)
        return f"CASE WHEN {c} <> '' THEN {value} END"

    cleaned_name = "_cleaned_reporter"
    while cleaned_name in df.columns:
        cleaned_name += "_"
    empty_form = ~_any([present_truthy(df, f.name) for f in fields])
    # A column of its own, so that it is cleaned once for the three places that read it.
    source = F.expr(cleaned("reporter_name")) if "reporter_name" in texts else F.lit(None).cast("string")
    name = F.col(cleaned_name)
    auto = F.when(batch, BATCH_REPORTER).otherwise(SINGLE_REPORTER)
    # No text gets shorter in upper case, so longer names need not be converted.
    blank = F.coalesce((F.length(name) <= len("MISSING")) & F.upper(name).isin("", "MISSING"), F.lit(True))
    reporter = F.when(empty_form, F.lit(None)).when(blank, auto).otherwise(name)

    columns = [
        F.expr(cleaned(f.name)).alias(f.name) if f.name in texts and f.name != "reporter_name" else F.col(f.name)
        for f in df.schema.fields
        if f.name != "reporter_name"
    ]
    return df.withColumn(cleaned_name, source).select(*columns, reporter.alias("reporter_name"))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def cases_as_reports(df: DataFrame) -> DataFrame:
    """Give line listing rows the report field names, keeping the originals.

    A target is filled only where it is absent (null); dates are normalised afterwards.
    """
    pairs = {
        "adverse_event_term": "adverse_reaction",
        "event_onset_date": "onset_date",
        "event_severity": "severity",
    }
    new = {
        target: F.coalesce(field(df, target), F.col(source))
        for source, target in pairs.items()
        if source in df.columns
    }
    out = df.withColumns(new) if new else df
    dates = [c for c in ("onset_date", "report_date", "event_onset_date") if c in out.columns]
    return out.withColumns(
        {c: F.when(F.col(c) != "", normalize_date_format(c)).otherwise(F.col(c)) for c in dates}
    )


def detect_form_type(df: DataFrame) -> Column:
    """ADR when two of its four indicators are present, else DMF by the same rule, else unknown."""

    def hits(names: list[str]) -> Column:
        return sum((present_truthy(df, n).cast("int") for n in names), F.lit(0))

    return (
        F.when(hits(ADR_INDICATORS) >= 2, "ADR")
        .when(hits(DMF_INDICATORS) >= 2, "DMF")
        .otherwise("unknown")
    )


def analytics_columns(df: DataFrame) -> dict[str, Column]:
    """The four descriptive columns a submission carries, from its form fields."""

    def truthy(name: str) -> Column:
        return F.nullif(field(df, name), F.lit(""))

    return {
        "severity": F.coalesce(truthy("event_severity"), field(df, "severity"), F.lit("Unknown")),
        "outcome": F.coalesce(field(df, "outcome"), F.lit("Unknown")),
        "adverse_event": F.coalesce(truthy("adverse_reaction"), field(df, "adverse_event"), F.lit("")),
        "drug_name": F.coalesce(field(df, "drug_name"), F.lit("")),
    }


def display_defaults(df: DataFrame) -> dict[str, Column]:
    """What a listing shows for null or empty descriptive columns."""
    defaults = {"severity": "Unknown", "outcome": "Unknown", "adverse_event": "", "drug_name": ""}
    return {name: default_if_blank(field(df, name), text) for name, text in defaults.items()}


def unwrap_form(df: DataFrame, payload: str = "submission_data", nested: str = "form_data") -> Column:
    """The nested form where the payload has one, else the payload itself (same-typed structs)."""
    form_type = df.schema[payload].dataType[nested].dataType
    outer = F.col(payload)
    own = F.struct(*[outer[f.name].cast(f.dataType).alias(f.name) for f in form_type.fields])
    return F.coalesce(outer[nested], own)


def processing_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def compression_ratio(summary_length: Column, original_length: Column) -> Column:
    return summary_length / F.nullif(original_length, F.lit(0))
