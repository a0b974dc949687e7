"""Queries over cleaning, rules, consistency and causality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from caselight.functions.registered import register
from caselight.functions import dates, text
from caselight.operators import causality as N
from caselight.operators import clean as P
from caselight.operators import consistency as C
from caselight.operators import rules as V
from caselight.plans.registry import CATALOG
from caselight.schemas import (
    AGE_UNITS,
    CASE_OUTCOMES,
    CASE_SEVERITIES,
    FREQUENCIES,
    GENDERS,
    NARRATIVE_WORDS,
    OUTCOME_BUCKETS,
    PRIORITY_ACTIONS,
    PROCESSING_STAGES,
    SEVERITY_BUCKETS,
    VALUE_LABELS,
)

add = CATALOG.add
AS_OF = dt.date(2026, 6, 30)


def _list(names: list[str]) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


def clean_text_sql(c: str) -> str:
    """One replacement per label, in order."""
    out = f"trim({c})"
    for label in VALUE_LABELS:
        out = f"regexp_replace({out}, '^{label}:\\s*', '', 'i')"
    return f"coalesce(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '')"


def ambiguous_sql(c: str) -> str:
    v = f"trim({c})"

    def part(i: int) -> str:
        return f"try_cast(split_part({v}, '-', {i}) AS INT)"

    return f"""CASE WHEN regexp_matches({v}, '^\\d{{2}}-\\d{{1,2}}-\\d{{2}}$') AND {part(2)} BETWEEN 1 AND 12 AND {part(3)} BETWEEN 1 AND 31
      THEN printf('%d-%02d-%02d', CASE WHEN {part(1)} <= 30 THEN 2000 + {part(1)} ELSE 1900 + {part(1)} END, {part(2)}, {part(3)})
      WHEN regexp_matches({v}, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') THEN replace({v}, '-', '/') ELSE coalesce({v}, '') END"""


def normal_date_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$') THEN replace(trim({c}), '-', '/') ELSE coalesce(trim({c}), '') END"


@add("p1_clean_text", ["adr_forms"], f"SELECT id, {clean_text_sql('adverse_reaction')} AS reaction, {clean_text_sql('drug_name')} AS drug FROM adr_forms")
def _(t):
    return t.view("adr_forms", wide=True).select(
        "id", text.clean_text_field("adverse_reaction").alias("reaction"),
        text.clean_text_field("drug_name").alias("drug"),
    )


@add("p2_ambiguous_dates", ["adr_forms"], f"SELECT id, {ambiguous_sql('onset_date')} AS onset_date FROM adr_forms")
def _(t):
    return t.view("adr_forms", wide=True).select("id", dates.parse_ambiguous_date("onset_date").alias("onset_date"))


@add("p3_normal_dates", ["adr_forms"], f"SELECT id, {normal_date_sql('onset_date')} AS onset_date FROM adr_forms")
def _(t):
    return t.view("adr_forms", wide=True).select("id", dates.normalize_date_format("onset_date").alias("onset_date"))


_TEXTS = ["adverse_reaction", "adverse_event_term", "drug_name", "outcome"]
_DATES = ["onset_date", "event_onset_date", "report_date"]
_OTHERS = ["patient_age", "severity", "duration", "concomitant_medications", "patient_gender", "event_severity"]
_CLEANED = (
    "SELECT id, is_batch, "
    + ", ".join(f"CASE WHEN {c} <> '' THEN {clean_text_sql(c)} END AS {c}" for c in _TEXTS)
    + ", "
    + ", ".join(f"CASE WHEN {c} <> '' THEN {normal_date_sql('(' + ambiguous_sql(c) + ')')} END AS {c}" for c in _DATES)
    + ", "
    + ", ".join(f"CASE WHEN {c} <> '' THEN trim({c}) END AS {c}" for c in _OTHERS)
    + f""", CASE WHEN coalesce({clean_text_sql("reporter_name")}, '') = '' OR upper({clean_text_sql("reporter_name")}) = 'MISSING'
    THEN CASE WHEN is_batch THEN 'Batch Submission - Auto-reported' ELSE 'Auto-reported (Extracted)' END
    ELSE {clean_text_sql("reporter_name")} END AS reporter_name FROM adr_forms"""
)


def _cleaned(t):
    forms = t.view("adr_forms", wide=True).withColumnRenamed("is_batch", "_batch")
    return P.clean_forms(forms, "id", F.col("_batch")).withColumnRenamed("_batch", "is_batch")


@add("p4_clean_forms", ["adr_forms"], _CLEANED)
def _(t):
    return _cleaned(t)


@add("p5_cases_as_reports", ["cases"], f"""
SELECT case_id, adverse_event_term AS adverse_reaction, event_severity AS severity, {normal_date_sql("event_onset_date")} AS onset_date,
  {normal_date_sql("event_onset_date")} AS event_onset_date, {normal_date_sql("report_date")} AS report_date FROM cases""")
def _(t):
    return P.cases_as_reports(t.view("cases", wide=True)).select(
        "case_id", "adverse_reaction", "severity", "onset_date", "event_onset_date", "report_date"
    )


@add("p6_analytics_columns", ["adr_forms"], """
SELECT id, coalesce(nullif(event_severity, ''), severity, 'Unknown') AS severity, coalesce(outcome, 'Unknown') AS outcome,
  coalesce(nullif(adverse_reaction, ''), '') AS adverse_event, coalesce(drug_name, '') AS drug_name FROM adr_forms""")
def _(t):
    forms = t.view("adr_forms", wide=True)
    return forms.select("id", *[c.alias(n) for n, c in P.analytics_columns(forms).items()])


@add("p7_codes", ["cases"], """
SELECT case_id, patient_gender, CASE WHEN lower(patient_gender) IN ('m', 'male') THEN 'M' WHEN lower(patient_gender) IN ('f', 'female') THEN 'F' ELSE 'Other' END AS gender,
  coalesce(lower(dechallenge_response) IN ('yes', 'true', 'y'), FALSE) AS answered FROM cases""")
def _(t):
    return t.view("cases", wide=True).select(
        "case_id", "patient_gender", text.normalize_gender(F.col("patient_gender")).alias("gender"),
        F.coalesce(text.code_to_bool(F.col("dechallenge_response")), F.lit(False)).alias("answered"),
    )


@add("p8_status_labels", ["submissions"], """
SELECT id, status AS normal, CASE WHEN status IN ('completed', 'processing', 'failed', 'pending', 'uploaded')
  THEN upper(substr(status, 1, 1)) || substr(status, 2) ELSE 'Pending' END AS label FROM submissions""")
def _(t):
    old = F.when(F.col("status") == "completed", "pass").when(F.col("status") == "failed", "fail").otherwise(F.col("status"))
    return t.view("submissions").select(
        "id", text.normalize_status(old).alias("normal"), text.status_label(old).alias("label")
    )


@add("p9_buckets", ["submissions"], f"""
SELECT id, CASE WHEN severity IN ({_list(SEVERITY_BUCKETS)}) THEN severity ELSE 'Unknown' END AS severity,
  CASE WHEN outcome IN ({_list(OUTCOME_BUCKETS)}) THEN outcome ELSE 'Unknown' END AS outcome FROM submissions""")
def _(t):
    return t.view("submissions").select(
        "id", text.bucket(F.col("severity"), SEVERITY_BUCKETS).alias("severity"),
        text.bucket(F.col("outcome"), OUTCOME_BUCKETS).alias("outcome"),
    )


@add("p10_progress", ["submissions"], """
SELECT id, CASE WHEN status = 'completed' THEN 100.0 WHEN status = 'failed' THEN 80.0
  WHEN status = 'validating_form' THEN 3.0 / 5.0 * 100 ELSE 0.0 END::DOUBLE AS progress FROM submissions""")
def _(t):
    return t.view("submissions").select(
        "id", F.coalesce(text.progress_percentage(F.col("status"), PROCESSING_STAGES), F.lit(0.0)).alias("progress")
    )


@add("p11_unwrap_form", ["submissions"], """
SELECT id, coalesce(CASE WHEN id::BIGINT % 2 = 0 THEN 'nested ' || drug_name ELSE drug_name END, '') AS drug_name FROM submissions""")
def _(t):
    nested = F.when(
        F.col("id").cast("bigint") % 2 == 0, F.struct(F.concat(F.lit("nested "), F.col("drug_name")).alias("drug_name"))
    )
    wrapped = t.view("submissions").select("id", F.struct("drug_name", nested.alias("form_data")).alias("submission_data"))
    return wrapped.select("id", F.coalesce(P.unwrap_form(wrapped)["drug_name"], F.lit("")).alias("drug_name"))


def normal_text_sql(c: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace(trim(lower({c})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'), '')"


@add("p12_normalize_text", ["drugs"], f"SELECT pos, {normal_text_sql('drug')} AS form FROM drugs")
def _(t):
    return t.view("drugs").select("pos", text.normalize_text(F.col("drug")).alias("form"))


@add("p13_form_type", ["adr_forms", "dmf_forms"], """
SELECT id, CASE WHEN (coalesce(patient_age <> '', FALSE)::INT + coalesce(adverse_reaction <> '', FALSE)::INT + coalesce(onset_date <> '', FALSE)::INT + coalesce(patient_gender <> '', FALSE)::INT) >= 2 THEN 'ADR' ELSE 'unknown' END AS form_type FROM adr_forms
UNION ALL SELECT id, CASE WHEN (coalesce(applicant_name <> '', FALSE)::INT + coalesce(manufacturing_process <> '', FALSE)::INT + coalesce(drug_code <> '', FALSE)::INT + coalesce(clinical_data_available, FALSE)::INT) >= 2 THEN 'DMF' ELSE 'unknown' END FROM dmf_forms""")
def _(t):
    adr, dmf = t.view("adr_forms", wide=True), t.view("dmf_forms", wide=True)
    return adr.select("id", P.detect_form_type(adr).alias("form_type")).unionByName(
        dmf.select("id", P.detect_form_type(dmf).alias("form_type"))
    )


@add("p14_display_defaults", ["submissions"], """
SELECT id, CASE WHEN severity <> '' THEN severity ELSE 'Unknown' END AS severity, CASE WHEN outcome <> '' THEN outcome ELSE 'Unknown' END AS outcome,
  coalesce(adverse_event, '') AS adverse_event, coalesce(drug_name, '') AS drug_name FROM submissions""")
def _(t):
    subs = t.view("submissions")
    return subs.select("id", *[c.alias(n) for n, c in P.display_defaults(subs).items()])


@add("p15_durations", [], """
SELECT event_id, (event_id % 977)::DOUBLE AS seconds, length(props) / nullif(event_id % 5, 0) AS ratio FROM events""")
def _(t):
    ev = t.table("events")
    end = F.col("ts") + F.make_interval(secs=(F.col("event_id") % 977).cast("decimal(18,6)"))
    return ev.select(
        "event_id", P.processing_seconds(F.col("ts").cast("timestamp"), end.cast("timestamp")).alias("seconds"),
        P.compression_ratio(F.length("props"), F.col("event_id") % 5).alias("ratio"),
    )


# ---------------------------------------------------------------- drug master file rules

_ENUMS = {
    "dosage_form": "'Tablet', 'Capsule', 'Solution', 'Suspension', 'Powder', 'Injection', 'Other'",
    "route_of_administration": "'Oral', 'IV', 'IM', 'SC', 'Topical', 'Inhalation', 'Other'",
    "stability_data": "'12 months', '18 months', '24 months', '36 months'",
}


def _field(name: str, section: int, kind: str, limit: int = 0) -> str:
    """One struct per field: (section, pos, field, status, severity, message, suggestion)."""
    absent = f"{name} IS NULL" if kind in ("bool", "int") else f"({name} IS NULL OR trim({name}) = '')"

    def row(status, severity, message, suggestion):
        return f"{{'section': {section}, 'field_name': '{name}', 'status': '{status}', 'severity': '{severity}', 'message': '{message}', 'suggestion': {suggestion}}}"

    whens = [f"WHEN {absent} THEN " + row("missing", "critical", f"Mandatory field missing: {name}", f"'Provide {name}'")]
    if kind == "len":
        whens.append(f"WHEN length({name}) < {limit} THEN " + row(
            "incomplete", "medium", f"{name} too short (min: {limit} chars)", f"'Expand description to at least {limit} characters'"))
    if kind == "enum":
        opts = _ENUMS[name].replace("'", "")
        whens.append(f"WHEN {name} NOT IN ({_ENUMS[name]}) THEN " + row("invalid", "high", f"{name} must be one of: {opts}", f"'Select from: {opts}'"))
    if kind in ("phone", "email"):
        rx = "^[0-9]{10}$" if kind == "phone" else "^[\\w.-]+@[\\w.-]+\\.\\w+$"
        whens.append(f"WHEN NOT regexp_matches({name}, '{rx}') THEN " + row("invalid", "high", f"{name} format incorrect", f"'Check {name} format'"))
    if kind == "int":
        whens.append(f"WHEN {name} < 0 THEN " + row("invalid", "high", f"{name} must be >= 0", "NULL"))
    return f"CASE {' '.join(whens)} ELSE {row('pass', 'none', f'{name} validated', 'NULL')} END"


_DMF = [
    _field("applicant_name", 1, "len", 5), _field("applicant_address", 1, "len", 10), _field("applicant_phone", 1, "phone"),
    _field("applicant_email", 1, "email"), _field("drug_name", 1, "len", 3), _field("drug_code", 1, "len", 3),
    _field("drug_strength", 2, "any"), _field("dosage_form", 2, "enum"), _field("route_of_administration", 2, "enum"),
    _field("manufacturing_process", 2, "len", 50),
    _field("clinical_data_available", 3, "bool"), _field("animal_toxicity_data", 3, "bool"), _field("stability_data", 3, "enum"),
    _field("retest_period", 3, "len", 5),
    _field("adverse_events_reported", 4, "bool"), _field("safety_database_size", 4, "int"), _field("serious_adverse_events", 4, "int"),
    _field("contraindications", 4, "len", 10), _field("precautions", 4, "len", 10),
]
_DMF_CTE = f"WITH fields AS (SELECT id, row_number() OVER () AS rid, [{', '.join(_DMF)}] AS fs FROM dmf_forms), long AS (SELECT rid, id, generate_subscripts(fs, 1) AS pos, unnest(fs) AS f FROM fields)\n"


def _section_sql(n: int) -> str:
    return f"""coalesce(CASE arg_max(f.severity, pos) FILTER (f.section = {n} AND f.severity IN ('critical', 'high')) WHEN 'critical' THEN 'FAIL' WHEN 'high' THEN 'INCOMPLETE' END, 'PASS')"""


@add("v1_field_findings", ["dmf_forms"], _DMF_CTE + """
SELECT id, (pos - 1)::INT AS pos, 'Section ' || f.section AS section, f.field_name AS field_name, f.status AS status, f.severity AS severity, f.message AS message, f.suggestion AS suggestion FROM long""")
def _(t):
    return V.field_findings(V.check_forms(t.view("dmf_forms", wide=True)), "id").withColumn("section", F.substring("section", 1, 9))


@add("v2_check_forms", ["dmf_forms"], _DMF_CTE + f"""
, agg AS (SELECT rid, any_value(id) AS id, round(count(*) FILTER (f.status = 'pass') / 19 * 100, 1) AS completeness_score,
  count(*) FILTER (f.severity = 'critical') AS n_critical, count(*) FILTER (f.severity = 'high') AS n_high,
  coalesce(string_agg(f.message, '|' ORDER BY pos) FILTER (f.severity = 'critical'), '') AS critical_issues,
  coalesce(string_agg(f.message, '|' ORDER BY pos) FILTER (f.severity = 'high'), '') AS high_priority_issues,
  coalesce(string_agg(f.message, '|' ORDER BY pos) FILTER (f.severity = 'medium'), '') AS medium_priority_issues,
  coalesce(string_agg(f.field_name || '=' || f.suggestion, '|' ORDER BY pos) FILTER (f.suggestion IS NOT NULL), '') AS recommendations,
  {_section_sql(1)} || ',' || {_section_sql(2)} || ',' || {_section_sql(3)} || ',' || {_section_sql(4)} AS sections FROM long GROUP BY rid)
SELECT id, completeness_score, critical_issues, high_priority_issues, medium_priority_issues, recommendations, sections,
  CASE WHEN n_critical > 0 THEN 'FAIL' WHEN completeness_score < 80 THEN 'INCOMPLETE' WHEN n_high > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS overall_status FROM agg""")
def _(t):
    out = V.check_forms(t.view("dmf_forms", wide=True))
    joined = {c: F.array_join(c, "|") for c in ("critical_issues", "high_priority_issues", "medium_priority_issues")}
    return out.select(
        "id", "completeness_score", "overall_status", *[c.alias(n) for n, c in joined.items()],
        F.array_join(F.transform("recommendations", lambda r: F.concat_ws("=", r["field"], r["action"])), "|").alias("recommendations"),
        F.array_join(F.transform("sections", lambda s: s["status"]), ",").alias("sections"),
    )


# ---------------------------------------------------------------- reaction reports

_INT = "(CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+$') THEN trim({c})::BIGINT END)"


def _int(c: str) -> str:
    return _INT.format(c=c)


def _adr_issue(name: str, limit: int) -> str:
    req = "NOT is_batch" if name == "reporter_name" else "TRUE"
    head = f"CASE WHEN {name} IS NULL OR trim({name}) = '' THEN CASE WHEN {req} THEN 'Mandatory field missing: {name}' END"
    if name == "patient_age":
        n = _int(name)
        return f"{head} WHEN {n} IS NULL THEN '{name} must be a number' WHEN {n} < 1 THEN '{name} must be >= 1' WHEN {n} > 150 THEN '{name} must be <= 150' END"
    if limit:
        return f"{head} WHEN length({name}) < {limit} THEN '{name} must be at least {limit} characters' END"
    return f"{head} END"


_ADR_FIELDS = [("drug_name", 2), ("adverse_reaction", 5), ("patient_age", 0), ("onset_date", 0), ("reporter_name", 3), ("report_date", 0)]


def adr_sql(source: str) -> str:
    issues = "list_filter([" + ", ".join(_adr_issue(n, k) for n, k in _ADR_FIELDS) + "], lambda x: x IS NOT NULL)"
    warnings = "list_filter([" + ", ".join(
        f"CASE WHEN {n} IS NULL OR trim({n}) = '' THEN 'Optional field empty: {n}' END"
        for n in ("severity", "outcome", "duration", "concomitant_medications")) + "], lambda x: x IS NOT NULL)"
    filled = " + ".join(f"coalesce({n} <> '', FALSE)::INT" for n, _ in _ADR_FIELDS)
    return f"""SELECT id, array_to_string(issues, '|') AS critical_issues, array_to_string(warnings, '|') AS warnings, completeness_score,
  CASE WHEN len(issues) > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status,
  CASE WHEN len(issues) > 0 THEN 'Please provide all mandatory fields' ELSE 'ADR report is valid (' || completeness_score || '% complete)' END AS recommendation
FROM (SELECT id, {issues} AS issues, {warnings} AS warnings, round(({filled}) / 6 * 100, 1) AS completeness_score FROM {source})"""


def _flat_reports(df):
    return df.select(
        "id", F.array_join("critical_issues", "|").alias("critical_issues"), F.array_join("warnings", "|").alias("warnings"),
        "completeness_score", "overall_status", "recommendation",
    )


@add("v4_check_reports", ["adr_forms"], adr_sql("adr_forms"))
def _(t):
    return _flat_reports(V.check_reports(t.view("adr_forms", wide=True), F.col("is_batch")))


@add("v4_check_cleaned_reports", ["adr_forms"], f"WITH cleaned AS ({_CLEANED}) " + adr_sql("cleaned"))
def _(t):
    return _flat_reports(V.check_reports(_cleaned(t), F.col("is_batch")))


# ---------------------------------------------------------------- line listing cases

_DATE_OK = "(regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR regexp_matches(trim({c}), '^[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}$'))"


def enum_sql(c: str, options: list[str]) -> str:
    """Exact, any case, then the first word equal to an option."""
    pairs = ", ".join(f"'{o.lower()}': '{o}'" for o in options)
    return f"""coalesce(CASE WHEN trim({c}) IN ({_list(options)}) THEN trim({c}) END, map_extract_value(MAP {{{pairs}}}, lower(trim({c}))),
    map_extract_value(MAP {{{pairs}}}, list_filter(regexp_split_to_array(lower(trim({c})), '\\s+'), lambda w: w IN ({_list([o.lower() for o in options])}))[1]))"""


@add("v5_date_shapes", ["adr_forms"], f"SELECT id, coalesce({_DATE_OK.format(c='onset_date')}, FALSE) AS ok FROM adr_forms")
def _(t):
    return t.view("adr_forms", wide=True).select("id", dates.is_date_shape(F.col("onset_date")).alias("ok"))


@add("v6_enum_values", ["cases"], f"""
SELECT report_date, event_severity, {enum_sql("event_severity", CASE_SEVERITIES)} AS severity, {enum_sql("outcome", CASE_OUTCOMES)} AS outcome FROM cases""")
def _(t):
    return t.view("cases", wide=True).select(
        "report_date", "event_severity", text.normalize_enum("event_severity", CASE_SEVERITIES).alias("severity"),
        text.normalize_enum("outcome", CASE_OUTCOMES).alias("outcome"),
    )


def _case_error(name: str) -> str:
    if name == "dechallenge_performed":
        return f"CASE WHEN {name} IS NULL THEN 'Missing mandatory field: {name}' END"
    head = f"CASE WHEN {name} IS NULL OR {name} = '' THEN 'Missing mandatory field: {name}'"
    if name == "patient_age":
        n = _int(name)
        return f"{head} WHEN {n} IS NULL THEN '{name} must be a number (got: ' || {name} || ')' WHEN {n} < 0 THEN '{name} must be >= 0' WHEN {n} > 150 THEN '{name} must be <= 150' END"
    enums = {"patient_gender": ["M", "F", "Other"], "event_severity": CASE_SEVERITIES, "outcome": CASE_OUTCOMES}
    if name in enums:
        return f"{head} WHEN {enum_sql(name, enums[name])} IS NULL THEN '{name} must be one of: {', '.join(enums[name])} (got: ' || {name} || ')' END"
    if name in ("event_onset_date", "report_date"):
        return f"{head} WHEN NOT {_DATE_OK.format(c=name)} THEN '{name} must be a valid date format (got: ' || {name} || ')' END"
    return f"{head} END"


_CASE_FIELDS = [
    "case_id", "patient_age", "patient_gender", "adverse_event_term", "event_onset_date", "event_severity", "outcome",
    "drug_name", "dose", "dechallenge_performed", "report_date",
]
CHECKED_CASES = f"""SELECT *, len(errors) = 0 AS valid, round((11 - len(errors)) / 11 * 100, 1) AS data_quality_score FROM (
  SELECT *, list_filter([{", ".join(_case_error(n) for n in _CASE_FIELDS)}], lambda x: x IS NOT NULL) AS errors,
    list_filter([CASE WHEN event_severity = 'Fatal' AND outcome IS DISTINCT FROM 'Fatal' THEN 'Fatal severity recorded but outcome is not Fatal - verify consistency' END,
      CASE WHEN dechallenge_performed AND coalesce(dechallenge_response, '') = '' THEN 'Dechallenge performed but no response documented' END], lambda x: x IS NOT NULL) AS warnings
  FROM cases)"""


@add("v7_check_cases", ["cases"], f"""
SELECT doc_id, coalesce(case_id, '') AS case_id, valid, data_quality_score, array_to_string(errors, '|') AS errors, array_to_string(warnings, '|') AS warnings FROM ({CHECKED_CASES})""")
def _(t):
    return V.check_cases(t.view("cases", wide=True)).select(
        "doc_id", F.coalesce("case_id", F.lit("")).alias("case_id"), "valid", "data_quality_score",
        F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"),
    )


@add("v8_case_batches", ["cases"], f"""
WITH c AS ({CHECKED_CASES}), ev AS (SELECT doc_id, coalesce(adverse_event_term, 'Unknown') AS ev, count(*) AS n, min(pos) AS p FROM c GROUP BY 1, 2)
SELECT c.doc_id, count(*) AS total_records, count(*) FILTER (valid) AS valid_records, count(*) FILTER (NOT valid) AS invalid_records,
  round(sum(round(data_quality_score * 10)::BIGINT) / count(*)) / 10 AS overall_data_quality, any_value(m.most_common_ae) AS most_common_ae,
  CASE WHEN count(*) FILTER (valid) / count(*) >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS overall_status
FROM c JOIN (SELECT DISTINCT ON (doc_id) doc_id, ev AS most_common_ae FROM ev ORDER BY doc_id, n DESC, p) m ON c.doc_id = m.doc_id GROUP BY c.doc_id""")
def _(t):
    return V.summarize_case_batches(V.check_cases(t.view("cases", wide=True)))


@add("v8_case_distributions", ["cases"], """
SELECT doc_id, 'severity' AS kind, coalesce(event_severity, 'Unknown') AS value, count(*) AS n FROM cases GROUP BY 1, 3
UNION ALL SELECT doc_id, 'outcome', coalesce(outcome, 'Unknown'), count(*) FROM cases GROUP BY 1, 3""")
def _(t):
    cases = t.view("cases", wide=True)
    sev = V.case_distribution(cases, "event_severity").select("doc_id", F.lit("severity").alias("kind"), F.col("event_severity").alias("value"), "n")
    return sev.unionByName(
        V.case_distribution(cases, "outcome").select("doc_id", F.lit("outcome").alias("kind"), F.col("outcome").alias("value"), "n")
    )


# ---------------------------------------------------------------- consistency

def _iso_date(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN try_cast({c} AS DATE) END)"


def _issue(when: str, kind: str, severity: str, message: str) -> str:
    return f"CASE WHEN {when} THEN '{kind}~{severity}~' || {message} END"


def _date_reason(c: str) -> str:
    return f"""CASE WHEN {c} <> '' AND {_iso_date(c)} IS NULL THEN CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-(1[0-2]|0?[1-9])-(3[01]|[12][0-9]|0?[1-9])$')
      THEN 'day is out of range for month' ELSE 'time data ''' || {c} || ''' does not match format ''%Y-%m-%d''' END END"""


_S, _E, _D = _iso_date("treatment_start_date"), _iso_date("event_onset_date"), _iso_date("dechallenge_date")
_ON, _GAP = f"({_E} - {_S})", f"({_D} - {_E})"
_REASON = f"coalesce({_date_reason('treatment_start_date')}, {_date_reason('event_onset_date')}, {_date_reason('dechallenge_date')})"
_NONNULL = "lambda x: x IS NOT NULL"
_DATES_SQL = f"""CASE WHEN treatment_start_date IS NULL OR event_onset_date IS NULL THEN [] WHEN {_REASON} IS NOT NULL THEN ['DATE_FORMAT_ERROR~HIGH~Invalid date format: ' || {_REASON}]
  ELSE list_filter([{_issue(f"{_ON} < 0", "TEMPORAL_ERROR", "CRITICAL", "'Adverse event (' || event_onset_date || ') occurred BEFORE treatment started (' || treatment_start_date || ')'")},
    {_issue(f"{_ON} < 0", "IMPOSSIBLE_ONSET", "CRITICAL", "'Event occurred before treatment initiation'")},
    {_issue(f"{_ON} * 24 > 3650", "IMPLAUSIBLE_ONSET", "MEDIUM", f"'Very delayed onset (' || {_ON} || ' days) - verify causality documentation'")},
    {_issue(f"{_GAP} < 0", "IMPOSSIBLE_DECHALLENGE", "CRITICAL", "'Dechallenge date before event occurred - logically impossible'")},
    {_issue(f"{_GAP} > 365", "DELAYED_DECHALLENGE", "HIGH", f"'Dechallenge ' || {_GAP} || ' days after event - verify accuracy'")}], {_NONNULL}) END"""
_A, _B = _int("patient_age"), _iso_date("date_of_birth")
_CALC = f"((DATE '2026-06-30' - {_B}) / 365.25)"
_AGE_SQL = f"""CASE WHEN patient_age IS NULL THEN [] WHEN {_A} IS NULL THEN ['INVALID_AGE_FORMAT~HIGH~Age must be a valid number']
  ELSE list_filter([{_issue(f"{_A} < 0", "NEGATIVE_AGE", "CRITICAL", "'Patient age cannot be negative'")},
    {_issue(f"{_A} > 150", "IMPOSSIBLE_AGE", "HIGH", f"'Age ' || {_A} || ' exceeds realistic lifespan'")},
    {_issue(f"lower(coalesce(age_unit, 'years')) NOT IN ({_list(AGE_UNITS)})", "INVALID_AGE_UNIT", "HIGH", "'Invalid age unit: ' || age_unit")},
    {_issue(f"abs({_A} - {_CALC}) > 1", "AGE_DOB_MISMATCH", "HIGH", f"'Reported age (' || {_A} || ') does not match DOB (calculated: ' || trunc({_CALC})::INT || ')'")},
    {_issue(f"date_of_birth <> '' AND {_B} IS NULL", "INVALID_DOB_FORMAT", "HIGH", "'Invalid date of birth format (use YYYY-MM-DD)'")}], {_NONNULL}) END"""
_DIGITS = "regexp_replace(regexp_split_to_array(trim(dose), '\\s+')[1], '[^0-9.]', '', 'g')"
_DOSE = f"(CASE WHEN regexp_matches({_DIGITS}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN {_DIGITS}::DOUBLE END)"
_TIMES = "(CASE WHEN lower(frequency) LIKE '%twice%' THEN 2.0::DOUBLE WHEN lower(frequency) LIKE '%three%' THEN 3.0::DOUBLE WHEN lower(frequency) LIKE '%weekly%' THEN 1.0::DOUBLE / 7.0::DOUBLE ELSE 1.0::DOUBLE END)"
_TOTAL = f"({_DOSE} * {_TIMES} * duration_days::INT)"
_KNOWN = " OR ".join(f"lower(frequency) LIKE '%{f}%'" for f in FREQUENCIES)
_DOSE_SQL = f"""CASE WHEN dose IS NULL OR frequency IS NULL OR duration_days IS NULL THEN [] WHEN {_DOSE} IS NULL THEN ['INVALID_DOSE_FORMAT~HIGH~Cannot parse dose: ' || dose]
  ELSE list_filter([{_issue(f"{_DOSE} <= 0", "INVALID_DOSE", "CRITICAL", "'Dose must be positive'")},
    {_issue(f"NOT ({_KNOWN})", "UNCLEAR_FREQUENCY", "HIGH", "'Frequency unclear: ' || frequency")},
    {_issue(f"{_DOSE} > 0 AND {_TOTAL} > 100000", "HIGH_CUMULATIVE_DOSE", "MEDIUM", f"'High cumulative dose (' || {_TOTAL} || ' units over ' || duration_days || ' days)'")}], {_NONNULL}) END"""
_N, _DE, _RE = "naranjo_score::INT", "coalesce(dechallenge_response, FALSE)", "coalesce(rechallenge_response, FALSE)"
_SCORE_SQL = f"""CASE WHEN naranjo_score IS NULL THEN [] ELSE list_filter([{_issue(f"{_N} NOT BETWEEN 0 AND 13", "INVALID_NARANJO_SCORE", "CRITICAL", "'Naranjo score must be between 0 and 13'")},
    {_issue(f"{_N} >= 9 AND NOT {_DE} AND NOT {_RE}", "WEAK_EVIDENCE_HIGH_SCORE", "HIGH", "'Score of Definitive (≥9) without dechallenge/rechallenge data'")},
    {_issue(f"{_N} <= 2 AND {_DE} AND {_RE}", "INCONSISTENT_EVIDENCE", "MEDIUM", "'Strong evidence (dechallenge + rechallenge) but score is Doubtful'")}], {_NONNULL}) END"""
_GENDER_SQL = f"""CASE WHEN patient_gender IS NULL THEN [] ELSE list_filter([{_issue(f"patient_gender NOT IN ({_list(GENDERS)})", "INVALID_GENDER", "HIGH", "'Invalid gender value: ' || patient_gender")},
    {_issue("patient_gender IN ('M', 'Male') AND pregnancy_status <> '' AND lower(pregnancy_status) <> 'not applicable'", "IMPOSSIBLE_STATE", "CRITICAL", "'Male patient reported as pregnant - data error'")}], {_NONNULL}) END"""


def _count(severity: str) -> str:
    return f"len(list_filter(issues, lambda x: contains(x, '~{severity}~')))"


def _joined_issues(c: str = "issues") -> Column:
    return F.array_join(F.transform(c, lambda i: F.concat_ws("~", i["type"], i["severity"], i["message"])), "|")


def _consistency_query(name: str, parts: list[str], columns: list[str]):
    body = f"""SELECT id, array_to_string(issues, '|') AS issues,
  CASE WHEN {_count("CRITICAL")} > 0 THEN 'FAIL' WHEN {_count("HIGH")} > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS overall_status,
  {_count("CRITICAL")} AS n_critical, {_count("HIGH")} AS n_high
FROM (SELECT id, flatten([{", ".join(parts)}]) AS issues FROM checked_records)"""

    @add(name, ["checked_records"], body)
    def _(t):
        rows = t.view("checked_records", wide=True).select("id", *columns)
        return C.check_consistency(rows, AS_OF).select(
            "id", _joined_issues().alias("issues"), "overall_status",
            F.size("critical_issues").cast("bigint").alias("n_critical"), F.size("high_priority_issues").cast("bigint").alias("n_high"),
        )


_DATE_COLS = ["treatment_start_date", "event_onset_date", "dechallenge_date"]
_AGE_COLS = ["patient_age", "date_of_birth", "age_unit"]
_DOSE_COLS = ["dose", "frequency", "duration_days"]
_SCORE_COLS = ["naranjo_score", "dechallenge_response", "rechallenge_response"]
_GENDER_COLS = ["patient_gender", "pregnancy_status"]
_consistency_query("c1_date_consistency", [_DATES_SQL], _DATE_COLS)
_consistency_query("c2_age_consistency", [_AGE_SQL], _AGE_COLS)
_consistency_query("c3_dose_consistency", [_DOSE_SQL], _DOSE_COLS)
_consistency_query("c4_score_consistency", [_SCORE_SQL], _SCORE_COLS)
_consistency_query("c5_gender_consistency", [_GENDER_SQL], _GENDER_COLS)
_consistency_query(
    "c6_all_checks", [_DATES_SQL, _AGE_SQL, _DOSE_SQL, _SCORE_SQL, _GENDER_SQL],
    _DATE_COLS + _AGE_COLS + _DOSE_COLS + _SCORE_COLS + _GENDER_COLS,
)


# ---------------------------------------------------------------- causality

def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"


def _rx(p: str) -> str:
    return f"regexp_matches(n, '{p}')"


_W = {k: _any(v) for k, v in NARRATIVE_WORDS.items()}
_SCORED = f"""
WITH l AS (SELECT id, lower(narrative) AS n FROM narratives), s AS (SELECT id,
  CASE WHEN {_rx("(2|3|4)\\s+days?\\s+(post|after|following)")} OR {_rx("48\\s+hours")} OR {_W["onset_2days"]} THEN 2
       WHEN {_rx("(5|6|7|8|9|10|14|21|30)\\s+(days?|weeks?)")} OR {_W["onset_5_30days"]} OR {_W["onset_immediate"]} THEN 1 ELSE 0 END AS temporal_relationship,
  {_W["dose_increase"]}::INT AS dose_response, {_W["known_reaction"]}::INT AS prior_knowledge,
  CASE WHEN {_W["stopped_drug"]} THEN 1 + {_W["resolved"]}::INT ELSE 0 END AS de_challenge,
  CASE WHEN {_W["restarted_drug"]} THEN 1 + {_W["recurred"]}::INT ELSE 0 END AS re_challenge,
  CASE WHEN {_rx("infection|disease|condition|comorbid|pre-existing|history")} AND NOT {_rx("no.*alternative|no.*comorbid|clear.*drug")} THEN -1 ELSE 0 END AS alternative_causes,
  {_rx("allerg|sensitive|prior|history")}::INT AS adverse_history,
  {_rx("blood|urine|lab|test|detected|concentration|plasma|serum")}::INT AS body_fluid_test,
  -{_rx("\\b3\\s+months|\\b90\\s+days|quarter|3 months|90 days")}::INT AS temporal_extended FROM l),
t AS (SELECT *, greatest(0, least(13, temporal_relationship + dose_response + prior_knowledge + de_challenge + re_challenge + alternative_causes + adverse_history + body_fluid_test + temporal_extended)) AS total_score FROM s)
SELECT *, CASE WHEN total_score >= 9 THEN 'Probable' WHEN total_score >= 5 THEN 'Possible' WHEN total_score >= 1 THEN 'Unlikely' ELSE 'Unrelated' END AS probability,
  'Total Score: ' || total_score || '/13' AS total_line FROM t"""


_STOPPED, _RESTARTED = _W["stopped_drug"], _W["restarted_drug"]
_REASONS = [  # of each factor the tests with their texts, then the text when none holds
    ("1. Temporal relationship: ", [("temporal_relationship = 2", "Strong temporal relationship (onset 2-4 days post-dose): +2"),
        (f"{_rx('(5|6|7|8|9|10|14|21|30)' + chr(92) + 's+(days?|weeks?)')} OR {_W['onset_5_30days']}", "Reasonable temporal relationship (onset 5-30 days post-dose): +1"),
        (_W["onset_immediate"], "Immediate onset suggests strong relationship: +1")], "Temporal relationship: uncertain"),
    ("2. Dose-response: ", [("dose_response = 1", "Dose-response relationship evident: +1")], "No clear dose-response relationship: 0"),
    ("3. Prior knowledge: ", [("prior_knowledge = 1", "Known adverse reaction with this drug or similar drugs: +1")], "No prior knowledge of this reaction: 0"),
    ("4. De-challenge (stopped drug): ", [("de_challenge = 2", "Event resolved after drug cessation: +2"), (_STOPPED, "Drug stopped but unclear if resolved: +1")], "No de-challenge data: 0"),
    ("5. Re-challenge: ", [("re_challenge = 2", "Event recurred on re-exposure (strongest evidence): +2"), (_RESTARTED, "Drug re-exposed but unclear if recurred: +1")], "No re-challenge data: 0"),
    ("6. Alternative causes: ", [("alternative_causes = -1", "Alternative cause identified (reduces causality): -1"),
        (_rx("no.*alternative|no significant.*cause|clear drug|temporal relationship"), "No significant alternative cause identified: 0")], "Alternative cause assessment unclear: 0"),
    ("7. Adverse history: ", [("adverse_history = 1", "History of similar adverse reactions: +1")], "No significant prior adverse history: 0"),
    ("8. Body fluid test: ", [("body_fluid_test = 1", "Drug or metabolite detected in body fluids: +1")], "No body fluid testing mentioned: 0"),
    ("9. Extended temporal (>3mo): ", [("temporal_extended = -1", "Temporal relationship >3 months (negative factor): -1")], "Temporal relationship within 3 months: 0"),
]
_REASONING = " || chr(10) || ".join(
    f"'{head}' || CASE " + " ".join(f"WHEN {test} THEN '{text}'" for test, text in tests) + f" ELSE '{default}' END" for head, tests, default in _REASONS
)


@add("n1_score_narratives", ["narratives"], f"""
SELECT r.* EXCLUDE (n, total_line), md5({_REASONING} || chr(10) || chr(10) || '**' || total_line || '**' || chr(10) || '**Probability: ' || probability || '**') AS reasoning_md5
FROM (SELECT z.*, l.n FROM ({_SCORED}) z JOIN (SELECT id, lower(narrative) AS n FROM narratives) l USING (id)) r""")
def _(t):
    out = N.score_narratives(t.view("narratives", wide=True))
    return out.withColumn("reasoning_md5", F.md5("reasoning")).drop("narrative", "reasoning", "previous_literature")


@add("n1_sql_functions", ["narratives"], f"""
SELECT id, total_score, probability, CASE WHEN total_score >= 9 THEN 'CRITICAL' WHEN total_score >= 5 THEN 'HIGH' WHEN total_score >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM ({_SCORED})""")
def _(t):
    register(t.spark)
    return t.spark.sql("""
        SELECT id, total_score, causality_probability(total_score) AS probability, priority_level(total_score) AS priority
        FROM (SELECT id, narrative_score(narrative) AS total_score FROM {narratives})""", narratives=t.view("narratives", wide=True))


@add("n2_score_factors", ["factors"], """
WITH s AS (SELECT id, greatest(0, least(13, CASE WHEN days BETWEEN 2 AND 4 THEN 2 WHEN days BETWEEN 5 AND 30 THEN 1 WHEN days > 90 THEN -1 ELSE 0 END
  + coalesce(dose_correlated, FALSE)::INT + known_reaction::INT + 2 * coalesce(resolved, FALSE)::INT + 2 * recurred::INT - alternative::INT)) AS total_score FROM factors)
SELECT id, total_score, CASE WHEN total_score >= 9 THEN 'Probable' WHEN total_score >= 5 THEN 'Possible' WHEN total_score >= 1 THEN 'Unlikely' ELSE 'Unrelated' END AS probability,
  'Structured field assessment: Score ' || total_score || '/13 → ' || CASE WHEN total_score >= 9 THEN 'Probable' WHEN total_score >= 5 THEN 'Possible' WHEN total_score >= 1 THEN 'Unlikely' ELSE 'Unrelated' END AS reasoning FROM s""")
def _(t):
    return N.score_factors(t.view("factors")).select("id", "total_score", "probability", "reasoning")


_CAT = "CASE WHEN naranjo_score >= 9 THEN '{}' WHEN naranjo_score >= 5 THEN '{}' WHEN naranjo_score >= 1 THEN '{}' ELSE '{}' END"


@add("n3_priority", ["sae_cases"], f"""
SELECT id, {_CAT.format("Definitive", "Probable", "Possible", "Doubtful")} AS category, {_CAT.format("CRITICAL", "HIGH", "MEDIUM", "LOW")} AS priority,
  {_CAT.format(*[PRIORITY_ACTIONS[k] for k in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])} AS action FROM sae_cases""")
def _(t):
    score = F.col("naranjo_score")
    level = N.priority_level(score)
    return t.view("sae_cases").select("id", N.category(score).alias("category"), level.alias("priority"), N.action_for(level).alias("action"))


@add("n4_evidence_quotes", ["sae_cases"], """
SELECT id, CASE WHEN naranjo_score >= 9 THEN 4 ELSE 3 END AS quotes, CASE WHEN naranjo_score >= 9 THEN 5 ELSE 4 END AS contribution,
  'MedDRA database confirms ' || event_term || ' as documented adverse reaction for drug class. Similar pattern reported in published literature.' AS literature,
  'Temporal relation to administration|Effect of dechallenge|From the literature' || CASE WHEN naranjo_score >= 9 THEN '|Temporal relation concordance' ELSE '' END AS criteria FROM sae_cases""")
def _(t):
    out = t.view("sae_cases").withColumn("q", N.evidence_quotes(F.col("event_term"), F.col("naranjo_score")))
    total = F.aggregate("q", F.lit(0), lambda acc, q: acc + q["score_contribution"])
    return out.select("id", F.size("q").alias("quotes"), total.alias("contribution"), F.get("q", 2)["quote"].alias("literature"), F.array_join(F.transform("q", lambda q: q["criterion"]), "|").alias("criteria"))


@add("n5_default_score", ["adr_forms"], "SELECT id, CASE WHEN adverse_reaction IS NOT NULL OR drug_name IS NOT NULL THEN 7 ELSE -1 END AS score FROM adr_forms")
def _(t):
    score = N.default_score(F.col("adverse_reaction"), F.col("drug_name"))
    return t.view("adr_forms", wide=True).select("id", F.coalesce(score, F.lit(-1)).alias("score"))


@add("r7_scored_report", ["sae_cases"], f"""
SELECT id, {_CAT.format("Definitive", "Probable", "Possible", "Doubtful")} AS category,
  'This ' || {_CAT.format("CRITICAL", "HIGH", "MEDIUM", "LOW")} || ' case warrants ' || CASE WHEN naranjo_score >= 5 THEN 'IMMEDIATE' ELSE 'routine' END ||
  ' review. Officer should verify dates cited in evidence quotes and consider pharmacovigilance reporting requirements.' AS officer_instructions,
  'Score of ' || naranjo_score || ' = ' || {_CAT.format("Definitive", "Probable", "Possible", "Doubtful")} || ' category. This case meets WHO-UMC criteria for drug causality based on documented evidence: temporal relationship, dechallenge response pattern, and literature concordance.' AS final_reasoning
FROM sae_cases""")
def _(t):
    cases = t.view("sae_cases").select("id", "naranjo_score", F.col("event_term").alias("adverse_event"), F.col("case_id").alias("drug_name"))
    return N.scored_report(cases).select("id", "category", "officer_instructions", "final_reasoning")
