"""Queries over report lines, whole reviews, privacy and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from caselight.operators import analytics as A
from caselight.operators import duplicates as D
from caselight.operators import privacy as Y
from caselight.operators import relations as R
from caselight.operators import reports as T
from caselight.operators.clean import clean_forms
from caselight.operators.extract import parse_reports
from caselight.operators.mondrian import BINS, mondrian
from caselight.operators.privacy import PII_PATTERNS
from caselight.operators.rules import check_cases, check_reports
from caselight.plans import catalog_clean as CC
from caselight.plans.catalog_clean import _flat_reports, adr_sql, ambiguous_sql, clean_text_sql, normal_date_sql
from caselight.plans.catalog_core import _ISSUES, _ROLLUP, member, trimmed
from caselight.plans.catalog_dups import FILED_LINKS
from caselight.plans.catalog_text import _report_column
from caselight.plans.registry import CATALOG
from caselight.schemas import DATE_FIELDS, FRAMEWORK_NAMES, PROCESSING_STAGES, REPORT_FIELDS, TEXT_FIELDS
from caselight.sources import changes
from caselight.sources.staging import new_folder, stage
from caselight.streaming import state
from caselight.streaming.intake import landed_uploads, parsed_uploads
from caselight.streaming.sinks import drain, finish
from caselight.streaming.toplists import top_values_per_window, top_values_stream

add = CATALOG.add
AS_OF = dt.date(2026, 6, 30)
NOW = dt.datetime(2024, 2, 1)

# ---------------------------------------------------------------- report lines


def _d(name: str, default: str) -> str:
    return f"coalesce({member(name)}, '{default}')"


_FINDING = f"""CASE WHEN status = 'FAIL' THEN CASE check_type WHEN 'Duplicate Detection' THEN '[FAIL] CRITICAL: Found ' || {_d("duplicates_found", "0")} || ' potential duplicate submissions'
    WHEN 'Consistency Check' THEN '[FAIL] ERROR: Data consistency issues detected'
    WHEN 'Form 44 Validation' THEN '[FAIL] Form validation failed: Only ' || {_d("completeness", "0")} || '% complete'
    WHEN 'ADR Validation' THEN '[FAIL] Form validation failed: Only ' || {_d("completeness", "0")} || '% complete'
    WHEN 'MD-14 Validation' THEN '[FAIL] ERROR: Adverse event validation failed' END
  WHEN status = 'PASS' THEN CASE check_type WHEN 'Form 44 Validation' THEN '[OK] Form ' || {_d("completeness", "0")} || '% complete - Validation passed'
    WHEN 'ADR Validation' THEN '[OK] Form ' || {_d("completeness", "0")} || '% complete - Validation passed'
    WHEN 'Naranjo Causality Scoring' THEN '[OK] Causality: Naranjo Score ' || {_d("causality_score", "0")} || '/13 - ' || {_d("probability", "Unknown")}
    WHEN 'Duplicate Detection' THEN '[OK] No duplicates - Unique submission'
    WHEN 'Consistency Check' THEN '[OK] Data consistency - All fields validated' END
  WHEN status = 'SKIPPED' THEN '[SKIP] ' || check_type || ': Skipped (' || {_d("reason", "N/A")} || ')' END"""
_FINDINGS = f"""lines AS (SELECT submission_id AS id, pos, {_FINDING} AS finding FROM results WHERE submission_id IN (SELECT id FROM submissions)),
findings AS (SELECT * FROM lines WHERE finding IS NOT NULL UNION ALL
  SELECT id, 0, 'All validation checks completed' FROM submissions WHERE id NOT IN (SELECT id FROM lines WHERE finding IS NOT NULL))"""
_KEYS = r"""marked AS (SELECT id, pos, trim(regexp_replace(finding, '\[(OK|FAIL|SKIP|ERR)\]', '', 'g')) AS key_finding FROM findings WHERE regexp_matches(finding, '\[(OK|FAIL|SKIP)\]')),
keys AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank, key_finding FROM marked WHERE length(key_finding) > 5 QUALIFY rank <= 5)"""


@add("r1_findings", ["submissions", "results"], f"WITH {_FINDINGS} SELECT * FROM findings")
def _(t):
    return T.findings(t.view("submissions"), t.view("results"))


@add("r4_key_findings", ["submissions", "results"], f"WITH {_FINDINGS}, {_KEYS} SELECT * FROM keys")
def _(t):
    return T.key_findings(T.findings(t.view("submissions"), t.view("results")))


_MISSING = "CASE WHEN json_valid(result) THEN json_extract_string(result, '$.missing_fields[*]') ELSE [] END"
_RECS = f"""recs AS (
  SELECT id, 0 AS part, pos, line FROM submissions, (VALUES (0, '[ALERT] REVIEW REQUIRED: Address flagged issues before resubmission'), (1, 'Contact regulatory team for clarification on failed checks')) v(pos, line) WHERE status = 'failed'
  UNION ALL SELECT submission_id, 1, pos, line FROM (SELECT submission_id, pos, CASE check_type WHEN 'Duplicate Detection' THEN '[ACTION] Check system for existing similar submissions and resolve conflicts'
    WHEN 'Form 44 Validation' THEN CASE WHEN len({_MISSING}) > 0 THEN '[ACTION] Complete mandatory Form 44 fields: ' || array_to_string(({_MISSING})[1:2], ', ') ELSE '[ACTION] Review Form 44 data validity and format' END
    WHEN 'Consistency Check' THEN CASE WHEN len({_ISSUES}) > 0 THEN '[ACTION] Resolve data inconsistency: ' || ({_ISSUES})[1] END END AS line
    FROM results WHERE status = 'FAIL' AND submission_id IN (SELECT id FROM submissions)) WHERE line IS NOT NULL
  UNION ALL SELECT id, 2, pos, line FROM submissions, (VALUES (0, '[OK] Submission ready for regulatory review'), (1, '[OK] All validation criteria successfully met'), (2, 'Next: Submit to compliance officer for approval')) v(pos, line) WHERE status = 'completed')"""


@add("r2_recommendations", ["submissions", "results"], f"WITH {_RECS} SELECT id, part, pos, line FROM recs")
def _(t):
    return T.recommendations(t.view("submissions"), t.view("results"))


_FORMS = "(check_type LIKE '%ADR Validation%' OR check_type LIKE '%Form 44%')"
_SUMMARY = f"""fc AS (SELECT submission_id, arg_min(status, pos) AS fs, arg_min(coalesce({member("completeness")}, '0'), pos) AS c,
  arg_min(array_to_string(({_ISSUES})[1:3], ', '), pos) AS mi FROM results WHERE {_FORMS} GROUP BY 1),
n AS (SELECT submission_id, count(*) FILTER (status = 'PASS') AS p, count(*) FILTER (status = 'FAIL') AS f, count(*) FILTER (status = 'SKIPPED') AS k FROM results GROUP BY 1),
base AS (SELECT s.id, s.filename, coalesce(s.status = 'completed', FALSE) AS done, coalesce(p, 0) AS p, coalesce(f, 0) AS f, coalesce(k, 0) AS k, fs, c, mi, fc.submission_id IS NOT NULL AS has_form
  FROM submissions s LEFT JOIN n ON s.id = n.submission_id LEFT JOIN fc ON s.id = fc.submission_id),
summary AS (
  SELECT id, part, 0 AS pos, line FROM (SELECT id, unnest([
    {{'part': 0, 'line': '=== SUBMISSION VALIDATION SUMMARY ==='}}, {{'part': 1, 'line': 'Status: ' || CASE WHEN done THEN 'APPROVED FOR REGULATORY REVIEW' ELSE 'REQUIRES ATTENTION' END}},
    {{'part': 2, 'line': 'Submission ID: ' || id}}, {{'part': 3, 'line': 'Filename: ' || coalesce(filename, 'None')}}, {{'part': 4, 'line': ''}},
    {{'part': 5, 'line': CASE WHEN has_form THEN 'Form Completeness: ' || c || '%' END}},
    {{'part': 6, 'line': CASE WHEN has_form AND fs = 'PASS' THEN 'Form validation PASSED - All mandatory fields present' END}},
    {{'part': 7, 'line': CASE WHEN has_form AND fs <> 'PASS' THEN 'Form validation FAILED - Missing required fields' END}},
    {{'part': 8, 'line': CASE WHEN has_form AND fs <> 'PASS' AND mi <> '' THEN 'Missing fields: ' || mi END}},
    {{'part': 9, 'line': CASE WHEN has_form THEN '' END}}, {{'part': 10, 'line': 'VALIDATION PIPELINE RESULTS:'}},
    {{'part': 11, 'line': CASE WHEN p > 0 THEN 'Passed (' || p || ' checks):' END}}, {{'part': 13, 'line': CASE WHEN f > 0 THEN 'Failed (' || f || ' checks):' END}},
    {{'part': 15, 'line': CASE WHEN k > 0 THEN 'Skipped (' || k || ' checks):' END}}, {{'part': 17, 'line': ''}},
    {{'part': 18, 'line': CASE WHEN done THEN 'NEXT STEPS:' END}}, {{'part': 19, 'line': CASE WHEN done THEN '- Document passed all regulatory validation checks' END}},
    {{'part': 20, 'line': CASE WHEN done THEN '- Ready for submission to regulatory authority' END}}, {{'part': 21, 'line': CASE WHEN done THEN '- Forward to compliance officer for final approval' END}},
    {{'part': 22, 'line': CASE WHEN NOT done THEN 'ACTION REQUIRED:' END}}, {{'part': 23, 'line': CASE WHEN NOT done AND f > 0 THEN '- Address failed validation checks before resubmission' END}},
    {{'part': 24, 'line': CASE WHEN NOT done AND f > 0 THEN '- Complete all mandatory form fields' END}}, {{'part': 25, 'line': CASE WHEN NOT done AND f > 0 THEN '- Ensure data consistency across all sections' END}}], recursive := true) FROM base)
    WHERE line IS NOT NULL
  UNION ALL SELECT submission_id, CASE status WHEN 'PASS' THEN 12 WHEN 'FAIL' THEN 14 ELSE 16 END, pos, '  - ' || check_type FROM results
    WHERE status IN ('PASS', 'FAIL', 'SKIPPED') AND submission_id IN (SELECT id FROM submissions))"""


@add("r3_summary_lines", ["submissions", "results"], f"WITH {_SUMMARY} SELECT id, part, pos, line FROM summary")
def _(t):
    return T.summary_lines(t.view("submissions"), t.view("results"))


@add("r3_summary_text", ["submissions", "results"], f"WITH {_SUMMARY} SELECT id, md5(string_agg(line, chr(10) ORDER BY part, pos, line)) AS text_md5 FROM summary GROUP BY id")
def _(t):
    text = T.lines_to_text(T.summary_lines(t.view("submissions"), t.view("results")), ["part", "pos"])
    return text.select("id", F.md5("text").alias("text_md5"))


def _agg(expr: str, order: str, source: str) -> str:
    return f"(SELECT id, string_agg({expr}, chr(10) ORDER BY {order}) AS x FROM {source} GROUP BY id)"


@add("s12_results_document", ["submissions", "results"], f"""
WITH {_ROLLUP.strip()[5:]}, {_FINDINGS}, {_KEYS}, {_RECS}, {_SUMMARY}
SELECT r.id, md5(concat_ws(chr(10), 'VALIDATION REPORT', repeat('=', 40), '', 'SUBMISSION INFORMATION', repeat('-', 21), 'ID: ' || r.id, 'Filename: ' || coalesce(filename, ''),
  'Status: ' || coalesce(r.status, ''), 'Overall: ' || overall_status, '', 'VALIDATION RESULTS', repeat('-', 18), 'Total Checks: ' || total_checks, 'Passed: ' || checks_passed, 'Failed: ' || checks_failed,
  'Skipped: ' || checks_skipped, '', 'FORM COMPLETENESS', repeat('-', 17), 'Score: ' || printf('%.0f', round(form_completeness)) || '%', '', 'KEY FINDINGS', repeat('-', 11), coalesce(k.x, ''), '',
  'DETAILED FINDINGS', repeat('-', 17), coalesce(f.x, ''), '', 'RECOMMENDATIONS', repeat('-', 16), coalesce(a.x, ''), '', 'COMPREHENSIVE SUMMARY', repeat('-', 21), coalesce(s.x, 'No summary available'))) AS text_md5
FROM rollup_rows r LEFT JOIN {_agg("rank || '. ' || key_finding", "rank", "keys")} k ON r.id = k.id LEFT JOIN {_agg("finding", "pos, finding", "findings")} f ON r.id = f.id
LEFT JOIN {_agg("line", "part, pos, line", "recs")} a ON r.id = a.id LEFT JOIN {_agg("line", "part, pos, line", "summary")} s ON r.id = s.id""")
def _(t):
    subs, results = t.view("submissions"), t.view("results")
    rows = T.packed_lines(A.results_rollup(subs, results), subs, results)
    found = T.key_findings(T.findings(rows))
    summary = T.lines_to_text(T.summary_lines(T.recommendations(found)), ["part", "pos"], packed="summary")
    doc = T.results_document(summary)
    return doc.select("id", F.md5("text").alias("text_md5"))


_NAMES = ", ".join(f"('{k}', '{v}', {a})" for (k, v), a in zip(FRAMEWORK_NAMES.items(), (2, -1, 1, 0)))


@add("s12_compliance_document", ["submissions", "results"], _ROLLUP.rstrip() + f""",
scores AS (SELECT id, framework, full_name, overall_status = 'PASS' AS ok, CASE WHEN total_checks > 0 THEN least(100, greatest(0, round(checks_passed / total_checks * 100)::INT + adj)) END AS score
  FROM rollup_rows, (VALUES {_NAMES}) v(framework, full_name, adj))
SELECT id, md5('COMPLIANCE REPORT' || chr(10) || chr(10) || string_agg(framework || ' - ' || full_name || chr(10) || 'Status: ' || CASE WHEN ok THEN 'COMPLIANT' ELSE 'NOT COMPLIANT' END || chr(10) ||
  'Score: ' || coalesce(score::VARCHAR, 'null') || '/100', chr(10) || chr(10) ORDER BY framework) || chr(10) || chr(10) ||
  CASE WHEN bool_and(ok) THEN 'Document is COMPLIANT with all 4 regulatory frameworks' ELSE 'Document is NOT COMPLIANT' END) AS text_md5 FROM scores GROUP BY id""")
def _(t):
    scores = A.framework_scores(A.results_rollup(t.view("submissions"), t.view("results")))
    return T.compliance_document(scores).select("id", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- whole reviews


def _cleaned_column(name: str) -> str:
    if name in TEXT_FIELDS:
        return f"CASE WHEN {name} <> '' THEN {clean_text_sql(name)} END AS {name}"
    if name in DATE_FIELDS:
        return f"CASE WHEN {name} <> '' THEN {normal_date_sql('(' + ambiguous_sql(name) + ')')} END AS {name}"
    return f"CASE WHEN {name} <> '' THEN trim({name}) END AS {name}"


_ANY = " OR ".join(f"coalesce({n} <> '', FALSE)" for n in REPORT_FIELDS)
_REPORTER = clean_text_sql("reporter_name")
_REVIEW = f"""
parsed AS (SELECT doc_id AS id, {", ".join(_report_column(n) for n in REPORT_FIELDS)} FROM reports),
batches AS (SELECT doc_id AS id, count(*) AS total, count(*) FILTER (valid) / count(*) >= 0.6 AS ok FROM ({CC.CHECKED_CASES}) GROUP BY 1),
cleaned AS (SELECT p.id, b.id IS NOT NULL AS is_batch, coalesce(b.ok, FALSE) AS batch_ok, {", ".join(_cleaned_column(n) for n in REPORT_FIELDS if n != "reporter_name")},
  CASE WHEN NOT ({_ANY}) THEN NULL WHEN {_REPORTER} = '' OR upper({_REPORTER}) = 'MISSING' THEN CASE WHEN b.id IS NOT NULL THEN 'Batch Submission - Auto-reported' ELSE 'Auto-reported (Extracted)' END ELSE {_REPORTER} END AS reporter_name
  FROM parsed p LEFT JOIN batches b ON p.id = b.id),
days AS (SELECT id, coalesce(created_date, '') AS d, {CC.normal_text_sql("applicant_name")} AS a, pos FROM filings),
dups AS (SELECT id, n FROM (SELECT id, (lag(id) OVER w IS NOT NULL)::INT + (lead(id) OVER w IS NOT NULL)::INT AS n FROM days WINDOW w AS (PARTITION BY d, a ORDER BY pos)) WHERE n > 0),
adr AS ({adr_sql("cleaned")}),
typed AS (SELECT c.*, ({_ANY}) AS has_form, (coalesce(patient_age <> '', FALSE)::INT + coalesce(adverse_reaction <> '', FALSE)::INT + coalesce(onset_date <> '', FALSE)::INT + coalesce(patient_gender <> '', FALSE)::INT) >= 2 AS is_adr,
  coalesce(d.n, 0) AS dups, a.overall_status AS adr_status, a.completeness_score,
  CASE WHEN patient_age IS NOT NULL AND {CC._A} IS NULL THEN 1 WHEN {CC._A} > 150 THEN 1 ELSE 0 END + CASE WHEN patient_gender NOT IN ('M', 'F', 'Male', 'Female', 'Other', 'Not specified') THEN 1 ELSE 0 END AS highs
  FROM cleaned c LEFT JOIN dups d ON c.id = d.id JOIN adr a ON a.id = c.id),
checks AS (SELECT id, 0 AS pos, 'Duplicate Detection' AS check_type, CASE WHEN has_form AND dups > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
    CASE WHEN has_form THEN '{{"duplicates_found":' || dups || '}}' ELSE '{{"reason":"No form data available"}}' END AS result FROM typed
  UNION ALL SELECT id, 1, 'Consistency Check', CASE WHEN has_form AND highs > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END, CASE WHEN has_form THEN '{{"critical_issues":[]}}' ELSE '{{"reason":"No form data available"}}' END FROM typed
  UNION ALL SELECT id, 2, CASE WHEN is_adr THEN 'ADR Validation' ELSE 'Form 44 Validation' END, CASE WHEN is_adr THEN adr_status ELSE 'FAIL' END, NULL FROM typed WHERE has_form
  UNION ALL SELECT id, 2 + has_form::INT, 'MD-14 Validation', CASE WHEN is_batch THEN CASE WHEN batch_ok THEN 'PASS' ELSE 'FAIL' END ELSE 'SKIPPED' END,
    CASE WHEN NOT is_batch THEN '{{"reason":"Form 44 (ADR) submission - MD-14 validation not applicable"}}' END FROM typed
  UNION ALL SELECT id, 3 + has_form::INT, 'Naranjo Causality Scoring', 'PASS', CASE WHEN adverse_reaction IS NOT NULL OR drug_name IS NOT NULL THEN '{{"causality_score":7}}' ELSE '{{"reason":"Insufficient data for scoring"}}' END FROM typed)"""


def _reviewed(t):
    reports = t.view("reports", wide=True).withColumnRenamed("doc_id", "id")
    # The parse is the costly step and the review reads its fields many times.
    forms = stage(parse_reports(reports).drop("text"))
    cases = t.view("cases").withColumnRenamed("doc_id", "id")
    return T.review_submissions(forms, AS_OF, cases, D.flagged_submissions(t.view("filings")))


@add("r5_review_checks", ["reports", "cases", "filings"], f"WITH {_REVIEW} SELECT id AS submission_id, pos, check_type, status, coalesce(result, '') AS result FROM checks")
def _(t):
    # payloads with fields of a form or a batch are compared by the queries of those checks
    own = ~F.col("check_type").isin("ADR Validation", "Form 44 Validation") & ~((F.col("check_type") == "MD-14 Validation") & (F.col("status") != "SKIPPED"))
    return T.review_results(_reviewed(t)).withColumn("result", F.when(own, F.col("result")).otherwise(""))


@add("r5_review_submissions", ["reports", "cases", "filings"], f"""
WITH {_REVIEW}, agg AS (SELECT id, count(*) FILTER (status = 'PASS') AS passed_checks, count(*) FILTER (status = 'FAIL') AS failed_checks, count(*) FILTER (status = 'SKIPPED') AS skipped_checks FROM checks GROUP BY 1)
SELECT t.id, CASE WHEN is_adr THEN 'ADR' ELSE 'unknown' END AS form_type, coalesce(severity, 'Unknown') AS severity, coalesce(outcome, 'Unknown') AS outcome, coalesce(adverse_reaction, '') AS adverse_event,
  coalesce(drug_name, '') AS drug_name, passed_checks, failed_checks, skipped_checks, CASE WHEN failed_checks > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status,
  CASE WHEN failed_checks > 0 THEN 'failed' ELSE 'completed' END AS processing_status FROM typed t JOIN agg ON t.id = agg.id""")
def _(t):
    out = _reviewed(t).drop("checks", "error_checks")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("passed_checks", "failed_checks", "skipped_checks")})


_FILED = "coalesce(applicant_name <> '', FALSE) OR coalesce(applicant_email <> '', FALSE) OR coalesce(phone <> '', FALSE)"


@add("r5_review_filings", ["batch_filings"], f"""
WITH {FILED_LINKS}
SELECT id, ({_FILED}) AS has_form, CASE WHEN ({_FILED}) AND coalesce(n, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE WHEN {_FILED} THEN '{{"duplicates_found":' || coalesce(n, 0) || '}}' ELSE '{{"reason":"No form data available"}}' END AS result
FROM batch_filings b LEFT JOIN linked l ON b.pos = l.pos""")
def _(t):
    subs = t.view("batch_filings").withColumn("drug_count", F.size(F.split("drug_list", ",")))
    forms = subs.select("id", "applicant_name", "applicant_email", "phone")
    found = T.review_results(T.review_submissions(forms, AS_OF, flagged=D.flagged_submissions(subs))).where("check_type = 'Duplicate Detection'")
    return found.select(F.col("submission_id").alias("id"), (~F.contains("result", F.lit("reason"))).alias("has_form"), "status", "result")


_ALL_PARTS = [CC._DATES_SQL, CC._AGE_SQL, CC._DOSE_SQL, CC._SCORE_SQL, CC._GENDER_SQL]


@add("r6_comprehensive_review", ["checked_records"], f"""
WITH i AS (SELECT id, form_type, naranjo_score, len(list_filter(flatten([{", ".join(_ALL_PARTS)}]), lambda x: contains(x, '~CRITICAL~'))) AS crit,
  len(list_filter(flatten([{", ".join(_ALL_PARTS)}]), lambda x: contains(x, '~HIGH~'))) AS high FROM checked_records)
SELECT id, CASE WHEN crit > 0 THEN 'FAIL' WHEN high > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS consistency_status, CASE WHEN form_type = 'Form 44' THEN 'FAIL' END AS form_status,
  1 + (form_type = 'Form 44')::INT + coalesce(naranjo_score::INT <> 0, FALSE)::INT AS checks_performed, crit + CASE WHEN form_type = 'Form 44' THEN 19 ELSE 0 END AS n_issues,
  CASE WHEN crit > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status,
  CASE WHEN crit > 0 THEN 'CRITICAL: Address all critical issues before proceeding' WHEN form_type <> 'Form 44' THEN '[PASS] Ready for processing - all checks passed' END AS recommendation FROM i""")
def _(t):
    out = T.comprehensive_review(t.view("checked_records", wide=True), AS_OF)
    return out.select(
        "id", "consistency_status", "form_status", F.col("checks_performed").cast("bigint").alias("checks_performed"),
        F.size("critical_issues").cast("bigint").alias("n_issues"), "overall_status", "recommendation",
    )


# ---------------------------------------------------------------- privacy

_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{k.lower()}" for k, p in PII_PATTERNS.items())


@add("y1_count_pii", [], f"""
SELECT *, {" + ".join(f"n_{k.lower()}" for k in PII_PATTERNS)} AS n_pii FROM (SELECT doc_id, {_COUNTS} FROM documents)""")
def _(t):
    out = Y.count_pii(t.dealt("documents").select("doc_id", "text")).drop("text")
    return out.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in out.columns if c != "doc_id"])


def _mask_sql(text: str) -> str:
    out = text
    for kind, p in PII_PATTERNS.items():
        mark = "[DATE-REMOVED]" if kind == "DATE" else "[PII-REMOVED]"
        if kind in ("PERSON", "ADDRESS"):
            cut = p.index("(", 3)
            out = f"regexp_replace({out}, '({p[:cut]}){p[cut:]}', '\\1{mark}', 'g')"
        else:
            out = f"regexp_replace({out}, '{p}', '{mark}', 'g')"
    return out


_CLEAR = " AND ".join(f"NOT regexp_matches(m, '{p}')" for k, p in PII_PATTERNS.items() if k not in ("PERSON", "ADDRESS"))


@add("y2_mask_documents", [], f"SELECT doc_id, md5(m) AS text_md5, {_CLEAR} AS safe FROM (SELECT doc_id, {_mask_sql('text')} AS m FROM documents)")
def _(t):
    out = Y.anonymize(t.dealt("documents").select("doc_id", "text"))
    return out.select("doc_id", F.md5("anonymized").alias("text_md5"), F.col("safe_for_regulatory_review").alias("safe"))


def _numbered_ctes(source: str) -> tuple[str, str]:
    ctes, last = [], source
    for i, (kind, p) in enumerate(PII_PATTERNS.items()):
        group = 1 if kind in ("PERSON", "ADDRESS") else 0
        kept = "w[:length(w) - length(v)]" if group else "''"
        ctes.append(f"""v{i} AS (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS ws, regexp_extract_all(text, '{p}', {group}) AS vs FROM {last}),
g{i} AS (SELECT *, string_split_regex(text, '{p}') AS gaps FROM v{i}),
s{i} AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN text ELSE array_to_string(list_transform(gaps, lambda g, j: g || CASE WHEN j > len(ws) THEN '' ELSE
  {kept.replace("w[:length(w) - length(v)]", "ws[j][:length(ws[j]) - length(vs[j])]")} || '[{kind}_' || len(list_distinct(vs[1:list_position(vs, vs[j])]))::VARCHAR || ']' END), '') END AS text FROM g{i})""")
        last = f"s{i}"
    return ", ".join(ctes), last


_NUMBERED, _LAST_STEP = _numbered_ctes("named")


_NAMED = "CASE WHEN doc_id % 9 = 0 THEN 'Name: A. Reporter Name: ' || upper(source) || chr(10) || 'All About ' || source || ' a@b.cc a@b.cc 1234 5678 9012 Address: ' ELSE '' END || text"


@add("y2_pseudonymize_documents", [], f"WITH named AS (SELECT doc_id, {_NAMED} AS text FROM documents), {_NUMBERED} SELECT doc_id, md5(text) AS text_md5 FROM {_LAST_STEP}")
def _(t):
    named = t.dealt("documents").select("doc_id", F.expr(_NAMED.replace("chr(10)", "char(10)")).alias("text"))
    return named.select("doc_id", F.md5(Y.pseudonymize(F.col("text"))).alias("text_md5"))


@add("y2_mask_fields", ["patients"], """
SELECT id, age, '[PII-REMOVED]' AS patient_name, '[PII-REMOVED]' AS patient_email, CASE WHEN visit_date IS NOT NULL THEN '[DATE-REMOVED]' END AS visit_date FROM patients""")
def _(t):
    out = Y.anonymize_fields(t.view("patients"), ["patient_name", "patient_email"], ["visit_date"])
    return out.select("id", "age", "patient_name", "patient_email", "visit_date")


_REGION = "CASE WHEN city IN ('Delhi', 'Gurgaon') THEN 'NCR Region, India' WHEN city = 'Mumbai' THEN 'Western Region, India' WHEN city = 'Bangalore' THEN 'Southern Region, India' WHEN city = 'Hyderabad' THEN 'South-Central Region, India' WHEN city = 'Kolkata' THEN 'Eastern Region, India' ELSE 'India' END"
_TIER = "CASE hospital WHEN 'AIIMS New Delhi' THEN 'Tier-1 Public Hospital' WHEN 'Max Super Specialty' THEN 'Tier-3 Private Hospital' WHEN 'Apollo Hospital' THEN 'Tier-3 Private Hospital' WHEN 'Fortis Healthcare' THEN 'Tier-3 Private Hospital' WHEN 'Government Medical College' THEN 'Tier-2 Government Hospital' ELSE 'Other' END"
_GEN = f"g AS (SELECT *, (age // 10 * 10)::VARCHAR || '-' || (age // 10 * 10 + 9)::VARCHAR AS age_band, {_REGION} AS region, {_TIER} AS hospital_tier FROM patients)"
_QUASI = ["age_band", "region", "hospital_tier", "gender"]


def _generalized(t):
    return Y.generalize(t.view("patients"), "age", "city", "hospital")


@add("y3_generalize", ["patients"], f"WITH {_GEN} SELECT id, age_band, region, hospital_tier FROM g")
def _(t):
    return _generalized(t).select("id", "age_band", "region", "hospital_tier")


_CLASSES = f"{_GEN}, k AS (SELECT {', '.join(_QUASI)}, count(*) AS n FROM g GROUP BY ALL)"


@add("y4_k_anonymity", ["patients"], f"""
WITH {_CLASSES} SELECT count(*) AS classes, min(n) AS k_value, count(*) FILTER (n < 5) AS classes_below_k, coalesce(sum(n) FILTER (n < 5), 0)::BIGINT AS rows_below_k,
  CASE WHEN min(n) >= 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM k""")
def _(t):
    return Y.k_anonymity(_generalized(t), _QUASI)


@add("y4_suppress", ["patients"], f"""
WITH {_CLASSES} SELECT g.id, n AS class_size, n < 5 AS suppressed, {", ".join(f"CASE WHEN n >= 5 THEN g.{q} END AS {q}" for q in _QUASI)} FROM g JOIN k USING ({", ".join(_QUASI)})""")
def _(t):
    return Y.suppress_small_classes(_generalized(t), _QUASI).select("id", "class_size", "suppressed", *_QUASI)


_MONDRIAN = ["age", "city", "hospital", "gender"]


def _mondrian_sql(levels: int = 20) -> str:
    """The same cuts with one group of common table expressions per level; a box that cannot be cut keeps its number."""
    dims = range(len(_MONDRIAN))
    names = ", ".join(_MONDRIAN)
    parts = [f"cells AS MATERIALIZED (SELECT {names}, count(*) AS n FROM patients GROUP BY ALL)"]
    for i, q in enumerate(_MONDRIAN):
        parts.append(f"v{i} AS MATERIALIZED (SELECT {q}, (coalesce(sum(r) OVER (ORDER BY {q} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {BINS} // (SELECT sum(n) FROM cells))::INT AS b{i} FROM (SELECT {q}, sum(n) AS r FROM cells GROUP BY 1))")
    joins = " ".join(f"JOIN v{i} ON v{i}.{q} IS NOT DISTINCT FROM cells.{q}" for i, q in enumerate(_MONDRIAN))
    bins = ", ".join(f"b{i}" for i in dims)
    parts.append(f"o0 AS MATERIALIZED (SELECT {', '.join(f'cells.{q}' for q in _MONDRIAN)}, n, {bins}, 1::BIGINT AS box FROM cells {joins})")
    parts.append("w AS MATERIALIZED (SELECT " + ", ".join(f"greatest(1, max(b{i})) AS w{i}" for i in dims) + " FROM o0)")
    for j in range(levels):
        parts.append(f"h{j} AS MATERIALIZED (SELECT box, dim, bin, sum(n) AS n FROM (SELECT box, n, unnest([{', '.join(map(str, dims))}]) AS dim, unnest([{bins}]) AS bin FROM o{j}) GROUP BY ALL)")
        parts.append(f"c{j} AS MATERIALIZED (SELECT box, dim, bin, sum(n) OVER (PARTITION BY box, dim ORDER BY bin) AS lo, sum(n) OVER (PARTITION BY box, dim) AS al, max(bin) OVER (PARTITION BY box, dim) - min(bin) OVER (PARTITION BY box, dim) AS wide FROM h{j})")
        share = "CASE dim " + " ".join(f"WHEN {i} THEN wide / w{i}" for i in dims) + " END"
        parts.append(f"p{j} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY box ORDER BY share DESC, dim, abs(2 * lo - al), bin) AS nr FROM (SELECT *, {share} AS share FROM c{j}, w WHERE lo >= 5 AND al - lo >= 5))")
        own = "CASE p.dim " + " ".join(f"WHEN {i} THEN b{i}" for i in dims) + " END"
        parts.append(f"o{j + 1} AS MATERIALIZED (SELECT {', '.join(f'o.{q}' for q in _MONDRIAN)}, o.n, {bins}, CASE WHEN p.bin IS NULL THEN o.box ELSE 2 * o.box + ({own} > p.bin)::INT END AS box FROM o{j} o LEFT JOIN p{j} p ON p.box = o.box AND p.nr = 1)")
    ranges = ", ".join(f"CASE WHEN min({q}) = max({q}) THEN min({q})::VARCHAR ELSE min({q})::VARCHAR || '-' || max({q})::VARCHAR END AS t{i}" for i, q in enumerate(_MONDRIAN))
    parts.append(f"boxes AS (SELECT box, sum(n)::BIGINT AS class_size, {ranges} FROM o{levels} GROUP BY box)")
    shown = ", ".join(f"t{i} AS {q}" for i, q in enumerate(_MONDRIAN))
    match = " AND ".join(f"o.{q} IS NOT DISTINCT FROM patients.{q}" for q in _MONDRIAN)
    return f"WITH {', '.join(parts)} SELECT id, class_size, class_size < 5 AS suppressed, {shown} FROM patients JOIN o{levels} o ON {match} JOIN boxes USING (box)"


@add("y4_mondrian", ["patients"], _mondrian_sql())
def _(t):
    return mondrian(t.view("patients"), _MONDRIAN).select("id", "class_size", "suppressed", *_MONDRIAN)


@add("y5_l_diversity", ["patients"], f"WITH {_GEN} SELECT region, gender, count(*) AS class_size, count(DISTINCT diagnosis) AS l_value FROM g GROUP BY 1, 2")
def _(t):
    return Y.l_diversity(_generalized(t), ["region", "gender"], "diagnosis")


@add("y5_t_closeness", ["patients"], f"""
WITH {_GEN}, q AS (SELECT diagnosis, count(*) / (SELECT count(*) FROM g) AS q FROM g GROUP BY 1), c AS (SELECT region, gender, count(*) AS n FROM g GROUP BY 1, 2),
p AS (SELECT region, gender, diagnosis, count(*) AS m FROM g GROUP BY 1, 2, 3)
SELECT c.region, c.gender, any_value(c.n) AS class_size, round(sum(abs(coalesce(p.m / c.n, 0) - q.q)) / 2, 9) AS t_value
FROM c CROSS JOIN q LEFT JOIN p ON p.region = c.region AND p.gender = c.gender AND p.diagnosis = q.diagnosis GROUP BY 1, 2""")
def _(t):
    return Y.t_closeness(_generalized(t), ["region", "gender"], "diagnosis").withColumn("t_value", F.round("t_value", 9))


@add("y6_tokens", ["patients"], "SELECT id AS submission_id, 'TOK_' || substr(sha256('salt' || patient_email), 1, 32) AS token, 'EMAIL' AS category FROM patients")
def _(t):
    rows = t.view("patients").withColumnRenamed("id", "submission_id")
    return Y.tokenize(rows, "patient_email", "EMAIL", "salt").drop("encrypted_value")


@add("y6_reveal_and_purge", ["patients"], """
SELECT id AS submission_id, CASE WHEN age < 30 THEN NULL ELSE patient_email END AS value, CASE WHEN age < 30 THEN 'erasure request' END AS purge_reason, age < 30 AS purged FROM patients""")
def _(t):
    people = t.view("patients")
    key = F.lit("0123456789abcdef0123456789abcdef")
    tokens = Y.tokenize(people.withColumnRenamed("id", "submission_id"), "patient_email", "EMAIL", "salt", key)
    purged = Y.purge_tokens(tokens, people.filter(F.col("age") < 30), "erasure request", NOW)
    return Y.reveal(purged, key).select("submission_id", "value", "purge_reason", F.col("purged_at").isNotNull().alias("purged"))


@add("f5_purged_tokens", ["patients"], "SELECT id AS submission_id, 'erasure request' AS purge_reason FROM patients WHERE age < 30")
def _(t):
    people = t.view("patients")
    tokens = Y.tokenize(people.withColumnRenamed("id", "submission_id"), "patient_email", "EMAIL", "salt")
    gone = Y.purge_tokens(tokens, people.filter(F.col("age") < 30), "erasure request", NOW)
    return R.purged(gone).select("submission_id", "purge_reason")


@add("y7_erase", ["submissions", "results", "audit"], """
SELECT 'results' AS table_name, id FROM results WHERE submission_id NOT IN (SELECT id FROM submissions WHERE status = 'failed')
UNION ALL SELECT 'audit', id FROM audit WHERE user_id NOT IN (SELECT id FROM submissions WHERE status = 'failed')""")
def _(t):
    gone = R.by_status(t.view("submissions"), "failed")
    tables = {"results": t.view("results"), "audit": t.view("audit").withColumnRenamed("user_id", "submission_id")}
    kept = Y.erase(tables, gone)
    return kept["results"].select(F.lit("results").alias("table_name"), "id").unionByName(
        kept["audit"].select(F.lit("audit").alias("table_name"), "id")
    )


# ---------------------------------------------------------------- streams


@add("st1_streamed_reports", ["adr_forms"], f"WITH cleaned AS ({CC._CLEANED}) " + adr_sql("cleaned"))
def _(t):
    forms = t.view("adr_forms", streaming=True).withColumnRenamed("is_batch", "_batch")
    checked = check_reports(clean_forms(forms, "id", F.col("_batch")), F.col("_batch"))
    return drain(t.spark, _flat_reports(checked), "st1")


_LANDED = ["patient_id", "patient_age", "outcome", "severity", "report_date"]


@add("st1_landed_files", [], f"""
WITH f AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 9 = 0 THEN 'exe' ELSE 'doc' END AS extension FROM documents),
once AS (SELECT text, extension FROM f GROUP BY ALL)
SELECT extension, CASE WHEN extension = 'exe' THEN 'File extension not allowed: exe' END AS reason, CASE WHEN length({trimmed("text")}) >= 100 THEN 'SUCCESS' ELSE 'EXTRACTION_FAILED' END AS status, md5(text) AS text_md5,
  {", ".join(_report_column(n) for n in _LANDED)} FROM once""")
def _(t):
    kind = F.when(F.col("doc_id") % 9 == 0, "exe").otherwise("doc")
    texts = t.table("documents").select(F.coalesce("text", F.lit("")).alias("text"), kind.alias("extension"), F.concat(F.lit("upload_"), F.col("doc_id"), F.lit("."), kind).alias("name"))
    texts = t.cut(texts, "name")  # a file for each document takes its writer longer than any other step, so all cores write
    base = new_folder(t.spark, "st1f")
    for again in ("landing", "landing/again"):  # every file is uploaded twice
        texts.select("text", "name").write.partitionBy("name").text(f"{base}/{again}")
    found = parsed_uploads(landed_uploads(t.spark, f"{base}/landing", by=["extension"]))
    out = drain(t.spark, found.select("extension", "reason", "status", F.md5("text").alias("text_md5"), *_LANDED), "st1f")
    return out


@add("st1_streamed_cases", ["cases"], f"SELECT doc_id, valid, data_quality_score, array_to_string(errors, '|') AS errors FROM ({CC.CHECKED_CASES})")
def _(t):
    checked = check_cases(t.view("cases", streaming=True))
    return drain(t.spark, checked.select("doc_id", "valid", "data_quality_score", F.array_join("errors", "|").alias("errors")), "st1c")


@add("st2_latest_status", [], "SELECT user_id AS id, arg_max(event_type, ts) AS status FROM events GROUP BY 1")
def _(t):
    moves = t.stream("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("changed_at"))
    return drain(t.spark, state.latest_status_stream(moves), "st2", "update", ["id"]).select("id", "status")


@add("st3_tumbling_counts", [], """
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2, time_bucket(INTERVAL 1 HOUR, ts)""")
def _(t):
    rows = t.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(t.spark, state.windowed_counts(rows, "ts", ["event_type"], "1 hour"), "st3", "update", ["window_start", "window_end", "event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@add("st3_sliding_counts", [], """
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events)
GROUP BY w""")
def _(t):
    rows = t.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(t.spark, state.windowed_counts(rows, "ts", [], "1 hour", "30 minutes"), "st3s", "update", ["window_start", "window_end"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n")


@add("st3_activity_sessions", ["audit"], """
WITH s AS (SELECT user_id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM audit WINDOW w AS (PARTITION BY user_id ORDER BY timestamp)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY timestamp) AS grp FROM s)
SELECT user_id, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM g GROUP BY user_id, grp""")
def _(t):
    rows = t.view("audit", streaming=True).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = drain(t.spark, state.activity_sessions(rows, gap="6 hours"), "st3a", "complete")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def _top_sql(column: str) -> str:
    return f"""
WITH c AS (SELECT floor(epoch(created_at) / 7776000) AS w, trim({column}) AS value, count(*) AS n FROM submissions WHERE trim({column}) <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, value) AS rank FROM c)
SELECT strftime(to_timestamp(w * 7776000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS window_start, rank::INT AS rank, value, n FROM r WHERE rank <= 5"""


def _top(t, column: str):
    rows = t.view("submissions", streaming=True).withColumn("created_at", F.col("created_at").cast("timestamp"))
    base = new_folder(t.spark, "st3top")
    finish(top_values_stream(rows, "created_at", column, "90 days", base, f"{base}/state"))
    return top_values_per_window(t.spark, base).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@add("st3_top_events", ["submissions"], _top_sql("adverse_event"))
def _(t):
    return _top(t, "adverse_event")


@add("st3_top_drugs", ["submissions"], _top_sql("drug_name"))
def _(t):
    return _top(t, "drug_name")


@add("st4_audit_without_repeats", ["audit"], "SELECT id, operation, user_id FROM audit")
def _(t):
    once = t.view("audit", streaming=True).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    again = t.view("audit", streaming=True).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = state.audit_without_repeats(once.unionByName(again))
    return drain(t.spark, out.select("id", "operation", "user_id"), "st4")


@add("st5_same_day_on_arrival", ["filings"], """
WITH k AS (SELECT *, coalesce(created_date, '') AS d, """ + CC.normal_text_sql("applicant_name") + """ AS a FROM filings),
n AS (SELECT *, lead(id) OVER w AS id_2, lead(drug_count) OVER w AS c_2 FROM k WINDOW w AS (PARTITION BY d, a ORDER BY pos))
SELECT id AS submission_1_id, id_2 AS submission_2_id, d AS date, abs(drug_count - c_2)::BIGINT AS drug_count_diff FROM n WHERE id_2 IS NOT NULL""")
def _(t):
    base = new_folder(t.spark, "st5")
    finish(state.same_day_pairs(t.view("filings", streaming=True), base, f"{base}/state"))
    finish(state.same_day_pairs_across(t.spark, base, f"{base}/state_across"))
    return state.written_pairs(t.spark, base).select("submission_1_id", "submission_2_id", "date", "drug_count_diff")


_STAGE_RANK = "CASE " + " ".join(f"WHEN status = '{s}' THEN {i}" for i, s in enumerate(PROCESSING_STAGES)) + f" ELSE {len(PROCESSING_STAGES)} END"


@add("st2_stage_order", ["submissions"], f"""
WITH m AS (SELECT submitted_by AS id, status, created_at, {_STAGE_RANK} AS rank FROM submissions WHERE status IS NOT NULL),
r AS (SELECT *, max(rank) OVER (PARTITION BY id ORDER BY created_at, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m)
SELECT id, status, strftime(created_at, '%Y-%m-%d') AS changed_at FROM r WHERE rank < reached""")
def _(t):
    moves = t.view("submissions", streaming=True).select(F.col("submitted_by").alias("id"), "status", F.col("created_at").cast("timestamp").alias("changed_at"))
    base = new_folder(t.spark, "st2o")
    finish(state.stage_order_violations(moves, base, f"{base}/state"))
    finish(state.stage_order_violations_across(t.spark, base, f"{base}/state_across"))
    return state.written_steps(t.spark, base).select("id", "status", F.date_format("changed_at", "yyyy-MM-dd").alias("changed_at"))


@add("s9_streamed_changes", [], f"""
WITH new AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'approved' ELSE o_orderstatus END AS status, o_orderkey % 7 = 0 AS gone FROM orders)
SELECT CASE WHEN n.gone THEN 'DELETE' ELSE 'UPDATE' END AS action, 'submissions' AS entity_type, n.id AS entity_id,
  '{{"id":"' || n.id || '","status":"' || o.o_orderstatus || '"}}' AS old_data, CASE WHEN NOT n.gone THEN '{{"id":"' || n.id || '","status":"' || n.status || '"}}' END AS new_data
FROM new n JOIN orders o ON o.o_orderkey::VARCHAR = n.id WHERE n.gone OR n.status <> o.o_orderstatus""")
def _(t):
    old = t.table("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    arriving = t.stream("orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "approved").otherwise(F.col("o_orderstatus")).alias("status"),
        (F.col("o_orderkey") % 7 == 0).alias("gone"),
    )
    base = new_folder(t.spark, "s9")
    finish(changes.streamed_changes(old, arriving, "submissions", f"{base}/out", f"{base}/state", tombstone="gone"))
    return t.spark.read.parquet(f"{base}/out/batch=*").select("action", "entity_type", "entity_id", "old_data", "new_data")
