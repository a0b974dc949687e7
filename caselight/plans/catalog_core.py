"""Queries over submissions, results and audit entries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from caselight.operators import analytics as A
from caselight.operators import relations as R
from caselight.operators.ordering import write_order_index
from caselight.plans.registry import CATALOG
from caselight.schemas import OUTCOME_BUCKETS, SEVERITY_BUCKETS, TABLE_STATUSES
from caselight.sources import changes, documents, sinks
from caselight.sources.staging import new_folder

add = CATALOG.add
AS_OF = dt.datetime(1998, 6, 30)
AUDIT_AS_OF = dt.datetime(2024, 1, 12)


def member(name: str, column: str = "result") -> str:
    return f"CASE WHEN json_valid({column}) THEN json_extract_string({column}, '$.{name}') END"


def _values(names: list[str]) -> str:
    return ", ".join(f"('{n}')" for n in names)


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


_PASSED = "status IN ('completed', 'approved')"


@add("a1_summary", ["submissions"], f"""
SELECT count(*) AS total_submissions, count(*) FILTER ({_PASSED}) AS passed_submissions,
  round(count(*) FILTER ({_PASSED}) / count(*) * 100, 2) AS pass_rate FROM submissions""")
def _(t):
    return A.summary(t.view("submissions"))


def _dist_sql(column: str, names: list[str]) -> str:
    return f"""
SELECT v.value, count(s.value) AS n FROM (VALUES {_values(names)}) v(value)
LEFT JOIN (SELECT CASE WHEN {column} IN ({_in(names)}) THEN {column} ELSE 'Unknown' END AS value FROM submissions) s
ON v.value = s.value GROUP BY v.value"""


@add("a1_severity_distribution", ["submissions"], _dist_sql("severity", SEVERITY_BUCKETS))
def _(t):
    return A.distribution(t.view("submissions"), "severity", SEVERITY_BUCKETS)


@add("a1_outcome_distribution", ["submissions"], _dist_sql("outcome", OUTCOME_BUCKETS))
def _(t):
    return A.distribution(t.view("submissions"), "outcome", OUTCOME_BUCKETS)


@add("a1_dashboard", ["submissions"], f"""
SELECT 'summary' AS section, 'total_submissions' AS key, count(*)::DOUBLE AS value FROM submissions
UNION ALL SELECT 'summary', 'passed_submissions', (count(*) FILTER ({_PASSED}))::DOUBLE FROM submissions
UNION ALL SELECT 'summary', 'pass_rate', round(count(*) FILTER ({_PASSED}) / count(*) * 100, 2) FROM submissions
UNION ALL SELECT 'severity', value, n::DOUBLE FROM ({_dist_sql("severity", SEVERITY_BUCKETS)})
UNION ALL SELECT 'outcome', value, n::DOUBLE FROM ({_dist_sql("outcome", OUTCOME_BUCKETS)})""")
def _(t):
    return A.dashboard_summary(t.view("submissions"))


@add("a2_top_adverse_events", ["submissions"], """
SELECT trim(adverse_event) AS value, count(*) AS n FROM submissions WHERE trim(adverse_event) <> ''
GROUP BY 1 ORDER BY n DESC, value LIMIT 5""")
def _(t):
    return A.top_values(t.view("submissions"), "adverse_event")


@add("a3_top_drugs", ["submissions"], """
SELECT trim(drug_name) AS value, count(*) AS n FROM submissions WHERE trim(drug_name) <> ''
GROUP BY 1 ORDER BY n DESC, value LIMIT 5""")
def _(t):
    return A.top_values(t.view("submissions"), "drug_name")


@add("a4_form_types", ["submissions"], """
SELECT CASE WHEN submission_type <> '' THEN submission_type ELSE 'Unknown' END AS submission_type, count(*) AS n
FROM submissions GROUP BY 1""")
def _(t):
    return A.form_type_distribution(t.view("submissions"))


_KIND = "CASE WHEN submission_type <> '' THEN submission_type ELSE 'Unknown' END"


def _totals_sql(sets: str) -> str:
    return f"""
SELECT kind, month, grouping_id(kind, month) AS level, count(*) AS n, count(*) FILTER ({_PASSED}) AS passed, round(count(*) FILTER ({_PASSED}) / count(*) * 100, 2) AS pass_rate
FROM (SELECT *, {_KIND} AS kind, strftime(created_at, '%Y-%m') AS month FROM submissions) GROUP BY {sets}"""


def _totals(t, sets=None):
    groups = {"kind": A.default_if_blank(F.col("submission_type"), "Unknown"), "month": F.date_format("created_at", "yyyy-MM")}
    return A.grouped_totals(t.view("submissions"), groups, sets)


@add("a4_types_by_month", ["submissions"], _totals_sql("ROLLUP (kind, month)"))
def _(t):
    return _totals(t)


@add("a1_grouping_sets", ["submissions"], _totals_sql("GROUPING SETS ((kind, month), (kind), (month), ())"))
def _(t):
    return _totals(t, [["kind", "month"], ["kind"], ["month"], []])


@add("a5_export_statistics", ["submissions"], """
SELECT count(*) AS total_submissions, count(*) FILTER (status = 'PASSED') AS passed_submissions,
  round(count(*) FILTER (status = 'PASSED') / count(*) * 100, 2) AS pass_rate FROM submissions""")
def _(t):
    return A.export_statistics(t.view("submissions"))


def _result_dist(name: str) -> str:
    return f"""SELECT coalesce({member(name)}, 'Unknown') AS value, count(*) AS n FROM results
WHERE CASE WHEN json_valid(result) THEN json_type(result) = 'OBJECT' END GROUP BY 1"""


@add("a5_result_severity", ["results"], _result_dist("severity"))
def _(t):
    return A.result_distribution(t.view("results"), "severity")


@add("a5_result_outcome", ["results"], _result_dist("outcome"))
def _(t):
    return A.result_distribution(t.view("results"), "outcome")


@add("a6_status_dashboard", ["submissions", "anonymized"], """
SELECT s.status, count(*) AS submission_count, round(avg(a.compliance_score), 6) AS avg_compliance_score,
  count(*) FILTER (a.k_anonymity_status = 'FAIL') AS k_anonymity_failures
FROM submissions s LEFT JOIN anonymized a ON s.id = a.submission_id GROUP BY s.status""")
def _(t):
    out = A.status_dashboard(t.view("submissions"), t.view("anonymized"))
    return out.withColumn("avg_compliance_score", F.round("avg_compliance_score", 6))


_ISSUES = "CASE WHEN json_valid(result) THEN json_extract_string(result, '$.critical_issues[*]') ELSE [] END"
_FORM = "(check_type LIKE '%ADR Validation%' OR check_type LIKE '%Form 44%')"
_OVERVIEW = f"""
WITH counts AS (SELECT submission_id, count(*) AS n FROM results GROUP BY 1),
forms AS (SELECT submission_id, arg_max(status, pos) AS status, arg_max(coalesce({member("completeness")}, '0'), pos) AS c
  FROM results WHERE {_FORM} GROUP BY 1),
issue_rows AS (SELECT submission_id, pos, generate_subscripts({_ISSUES}, 1) AS i, unnest({_ISSUES}) AS issue
  FROM results WHERE status = 'FAIL'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY pos, i) AS rn FROM issue_rows),
issues AS (SELECT submission_id, string_agg(issue, '; ' ORDER BY rn) AS issues FROM ranked WHERE rn <= 3 GROUP BY 1)
SELECT s.id, s.filename, s.submission_type, s.status, s.submitted_by, strftime(s.created_at, '%Y-%m-%d') AS created_at,
  CASE WHEN s.severity <> '' THEN s.severity ELSE 'Unknown' END AS severity,
  CASE WHEN s.outcome <> '' THEN s.outcome ELSE 'Unknown' END AS outcome,
  coalesce(s.adverse_event, '') AS adverse_event, coalesce(s.drug_name, '') AS drug_name,
  coalesce(f.status, 'UNKNOWN') AS validation_status, coalesce(f.c::DOUBLE, 0.0) AS form_completeness,
  coalesce(i.issues, '') AS critical_issues, coalesce(c.n, 0) AS checks_count
FROM submissions s LEFT JOIN counts c ON s.id = c.submission_id LEFT JOIN forms f ON s.id = f.submission_id
LEFT JOIN issues i ON s.id = i.submission_id"""


def _flat_overview(df):
    return df.withColumns({"created_at": day("created_at"), "critical_issues": F.array_join("critical_issues", "; ")})


@add("a7_submission_overview", ["submissions", "results"], _OVERVIEW)
def _(t):
    return _flat_overview(A.submission_overview(t.view("submissions"), t.view("results")))


@add("a7_submission_page", ["submissions", "results"], _OVERVIEW.replace(
    "SELECT s.id, s.filename",
    "SELECT 2 AS page, 25 AS per_page, (SELECT count(*) FROM submissions) AS total, "
    "(SELECT ceil(count(*) / 25)::BIGINT FROM submissions) AS pages, s.id, s.filename",
) + " ORDER BY s.created_at DESC, s.id LIMIT 25 OFFSET 25")
def _(t):
    return _flat_overview(A.submission_page(t.view("submissions"), t.view("results"), 2, 25))


_DEEP = "(SELECT greatest(1, ceil(count(*) / 25)::BIGINT * 3 // 5) FROM submissions)"


@add("a7_deep_page", ["submissions", "results"], _OVERVIEW.replace(
    "SELECT s.id, s.filename",
    f"SELECT {_DEEP} AS page, 25 AS per_page, (SELECT count(*) FROM submissions) AS total, (SELECT ceil(count(*) / 25)::BIGINT FROM submissions) AS pages, s.id, s.filename",
) + f" QUALIFY row_number() OVER (ORDER BY s.created_at DESC, s.id) BETWEEN ({_DEEP} - 1) * 25 + 1 AND {_DEEP} * 25")
def _(t):
    rows = t.view("submissions")
    index = write_order_index(rows, A.newest_first())
    page = max(1, -(-index.total // 25) * 3 // 5)
    return _flat_overview(A.indexed_page(index, rows, t.view("results"), page, 25))


@add("a7_page_after", ["submissions"], """
SELECT id, status FROM submissions WHERE created_at < TIMESTAMP '1998-06-30' OR (created_at = TIMESTAMP '1998-06-30' AND id > '5')
ORDER BY created_at DESC, id LIMIT 20""")
def _(t):
    return A.page_after(t.view("submissions"), AS_OF, "5", 20).select("id", "status")


@add("a8_submission_status", ["submissions", "results"], """
SELECT s.id, s.filename, s.submission_type AS type, s.status, coalesce(r.pos, -1) AS pos, r.check_type, r.status AS check_status,
  strftime(r.created_at, '%Y-%m-%d %H:%M:%S') AS checked_at
FROM submissions s LEFT JOIN results r ON s.id = r.submission_id""")
def _(t):
    out = A.submission_status(t.view("submissions"), t.view("results")).drop("created_at")
    return out.withColumns(
        {"checked_at": F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss"), "pos": F.coalesce("pos", F.lit(-1))}
    )


_COUNTS = """count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS checks_passed,
  count(*) FILTER (status = 'FAIL') AS checks_failed, count(*) FILTER (status = 'SKIPPED') AS checks_skipped,
  count(*) FILTER (status = 'ERROR') AS checks_errored"""
_ROLLUP = f"""
WITH counts AS (SELECT submission_id, {_COUNTS} FROM results GROUP BY 1),
forms AS (SELECT submission_id, arg_max(coalesce({member("completeness")}, '0'), pos) AS c FROM results WHERE {_FORM} GROUP BY 1),
rollup_rows AS (SELECT s.id, s.filename, s.status, CASE WHEN s.status = 'completed' THEN 'PASS' ELSE 'FAIL' END AS overall_status,
  coalesce(f.c::DOUBLE, 0.0) AS form_completeness, coalesce(total_checks, 0) AS total_checks,
  coalesce(checks_passed, 0) AS checks_passed, coalesce(checks_failed, 0) AS checks_failed,
  coalesce(checks_skipped, 0) AS checks_skipped, coalesce(checks_errored, 0) AS checks_errored
FROM submissions s LEFT JOIN counts c ON s.id = c.submission_id LEFT JOIN forms f ON s.id = f.submission_id)
"""


@add("a9_results_rollup", ["submissions", "results"], _ROLLUP + "SELECT * FROM rollup_rows")
def _(t):
    return A.results_rollup(t.view("submissions"), t.view("results")).drop("created_at")


@add("a9_form_issues", ["results"], f"""
SELECT submission_id, pos, (generate_subscripts({_ISSUES}, 1) - 1)::INT AS issue_no, unnest({_ISSUES}) AS issue
FROM results WHERE status = 'FAIL' AND {_FORM}""")
def _(t):
    return A.form_issues(t.view("results"))


@add("a10_process_rollup", ["results"], f"""
SELECT submission_id, {_COUNTS}, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'failed' ELSE 'completed' END AS processing_status
FROM results GROUP BY 1""")
def _(t):
    return A.process_rollup(t.view("results"))


@add("a11_status_counters", ["submissions"], """
SELECT count(*) AS total, count(*) FILTER (status = 'processing') AS processing,
  count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM submissions""")
def _(t):
    return A.status_counters(t.view("submissions"))


@add("a12_severity_total", ["submissions"], "SELECT count(*) AS total_records FROM submissions")
def _(t):
    return A.severity_total(t.view("submissions"))


@add("a13_framework_scores", ["submissions", "results"], _ROLLUP + """
SELECT id, framework, coalesce(CASE WHEN total_checks > 0 THEN least(100.0, greatest(0.0, round(checks_passed / total_checks * 100) + adj)) END, -1.0)::DOUBLE AS score,
  overall_status = 'PASS' AS compliant
FROM rollup_rows, (VALUES ('DPDP', 2), ('NDHM', -1), ('ICMR', 1), ('CDSCO', 0)) v(framework, adj)""")
def _(t):
    out = A.framework_scores(A.results_rollup(t.view("submissions"), t.view("results")))
    return out.withColumn("score", F.coalesce("score", F.lit(-1.0)))


@add("a14_submission_report", ["submissions", "results"], _ROLLUP + "SELECT * FROM rollup_rows WHERE id IN ('21', '42', '63')")
def _(t):
    return A.submission_report(t.view("submissions"), t.view("results"), ["21", "42", "63"]).drop("created_at")


@add("w1_priority_ranking", ["submissions", "sae_cases"], """
SELECT c.id, c.case_id, c.event_term, c.severity_grade, c.naranjo_score, c.priority_score, c.priority_level, s.submission_type
FROM sae_cases c JOIN submissions s ON c.submission_id = s.id ORDER BY c.priority_score DESC, c.id LIMIT 3""")
def _(t):
    return A.priority_ranking(t.view("sae_cases"), t.view("submissions"), 3).drop("created_at")


@add("w1_top_cases_per_event", ["sae_cases"], """
SELECT id, event_term, naranjo_score, priority_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_term ORDER BY priority_score DESC, id) AS rank FROM sae_cases) WHERE rank <= 3""")
def _(t):
    return A.top_per_group(t.view("sae_cases"), "event_term", "priority_score", "id", 3).select(
        "id", "event_term", "naranjo_score", "priority_score", "rank"
    )


def _match_sql(order: str) -> str:
    return f"""SELECT submission_id, id, status, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY pos {order}) AS rn FROM results WHERE {_FORM}) WHERE rn = 1"""


@add("w3_first_form_check", ["results"], _match_sql("ASC"))
def _(t):
    return A.first_match(t.view("results"), A.is_form_check(F.col("check_type"))).select("submission_id", "id", "status", "pos")


@add("w3_last_form_check", ["results"], _match_sql("DESC"))
def _(t):
    return A.last_match(t.view("results"), A.is_form_check(F.col("check_type"))).select("submission_id", "id", "status", "pos")


@add("w4_newest_results", ["results"], "SELECT id, status, pos FROM results ORDER BY pos DESC LIMIT 5")
def _(t):
    return A.newest(t.view("results"), 5, "pos").select("id", "status", "pos")


@add("f1_by_owner_and_status", ["submissions"], """
SELECT id, status, submitted_by FROM submissions WHERE status = 'failed' AND submitted_by = '7'""")
def _(t):
    return R.by_status(t.view("submissions"), "failed").filter(F.col("submitted_by") == "7").select("id", "status", "submitted_by")


@add("f1_by_key", ["submissions"], "SELECT id, status FROM submissions WHERE id IN ('1', '2', '3')")
def _(t):
    return R.by_key(t.view("submissions"), ["1", "2", "3"]).select("id", "status")


@add("f2_form_checks", ["results"], f"SELECT id, check_type FROM results WHERE {_FORM}")
def _(t):
    return t.view("results").filter(A.is_form_check(F.col("check_type"))).select("id", "check_type")


@add("f3_non_blank_events", ["submissions"], "SELECT id, adverse_event FROM submissions WHERE length(trim(adverse_event)) > 0")
def _(t):
    return t.view("submissions").filter(F.length(F.trim("adverse_event")) > 0).select("id", "adverse_event")


@add("f4_status_constraint", ["submissions"], """
SELECT id, status, coalesce(status IN ('pending', 'processing', 'completed', 'error'), FALSE) AS accepted,
  CASE WHEN coalesce(status IN ('pending', 'processing', 'completed', 'error'), FALSE) THEN NULL
       ELSE 'status not allowed: ' || coalesce(status, 'null') END AS reason FROM submissions""")
def _(t):
    return R.split_by_status(t.view("submissions"), TABLE_STATUSES).select("id", "status", "accepted", "reason")


@add("f6_retention", ["submissions"], """
SELECT id, strftime(created_at + INTERVAL 90 DAY, '%Y-%m-%d') AS scheduled_deletion FROM submissions
WHERE created_at >= TIMESTAMP '1998-06-30' - INTERVAL 90 DAY""")
def _(t):
    kept = R.within_retention(t.view("submissions"), AS_OF)
    return kept.select("id", F.date_format(R.scheduled_deletion(F.col("created_at")), "yyyy-MM-dd").alias("scheduled_deletion"))


@add("f7_audit_entries", ["audit"], """
SELECT id, user_id, details FROM audit WHERE operation = 'ANONYMIZE' AND timestamp > TIMESTAMP '2024-01-12' - INTERVAL 7 DAY""")
def _(t):
    return R.audit_entries_of(t.view("audit"), "ANONYMIZE", AUDIT_AS_OF).select("id", "user_id", "details")


@add("j8_submissions_with_results", ["submissions", "results"], """
SELECT s.id, s.status, r.check_type, r.status AS check_status, coalesce(r.pos, -1) AS pos
FROM submissions s LEFT JOIN results r ON s.id = r.submission_id""")
def _(t):
    out = R.with_results(t.view("submissions"), t.view("results"))
    return out.select("id", "status", "check_type", "check_status", F.coalesce("pos", F.lit(-1)).alias("pos"))


@add("j10_cases_with_submissions", ["submissions", "sae_cases"], """
SELECT c.id, c.case_id, c.priority_score, c.priority_level, s.submission_type, strftime(s.created_at, '%Y-%m-%d') AS created_at
FROM sae_cases c JOIN submissions s ON c.submission_id = s.id""")
def _(t):
    out = A.priority_ranking(t.view("sae_cases"), t.view("submissions"))
    return out.select("id", "case_id", "priority_score", "priority_level", "submission_type", day("created_at").alias("created_at"))


@add("j11_compliance_scorecard", ["submissions", "compliance"], """
SELECT s.id, s.filename, c.dpdp_score, c.ndhm_score, c.icmr_score, c.cdsco_score, c.overall_compliance_score, c.risk_level
FROM submissions s LEFT JOIN compliance c ON s.id = c.submission_id""")
def _(t):
    return R.compliance_scorecard(t.view("submissions"), t.view("compliance"))


@add("j12_cascade_delete", ["submissions", "results"], """
SELECT id, submission_id FROM results WHERE submission_id NOT IN (SELECT id FROM submissions WHERE status = 'failed')""")
def _(t):
    gone = R.by_status(t.view("submissions"), "failed")
    return R.cascade_delete(t.view("results"), gone).select("id", "submission_id")


@add("j12_orphans", ["submissions", "sae_cases"], """
SELECT id, submission_id FROM sae_cases WHERE submission_id NOT IN (SELECT id FROM submissions WHERE status = 'completed')""")
def _(t):
    return R.orphans(t.view("sae_cases"), R.by_status(t.view("submissions"), "completed")).select("id", "submission_id")


@add("u1_combined_checks", ["submissions", "results"], """
SELECT submission_id, check_type, status FROM results
UNION ALL SELECT id, 'Status Check', CASE WHEN status = 'failed' THEN 'FAIL' ELSE 'PASS' END FROM submissions""")
def _(t):
    more = t.view("submissions").select(
        F.col("id").alias("submission_id"), F.lit("Status Check").alias("check_type"),
        F.when(F.col("status") == "failed", "FAIL").otherwise("PASS").alias("status"),
    )
    return R.combine_checks(t.view("results").select("submission_id", "check_type", "status"), more)


@add("u4_issue_lists", ["results"], f"""
SELECT id, array_to_string(list_concat({_ISSUES}, CASE WHEN json_valid(result) THEN json_extract_string(result, '$.missing_fields[*]') ELSE [] END), '|') AS issues FROM results""")
def _(t):
    lists = {c: F.from_json(F.get_json_object("result", f"$.{c}"), "array<string>") for c in ("critical_issues", "missing_fields")}
    return t.view("results").withColumns(lists).select("id", F.array_join(R.concat_issues(*lists), "|").alias("issues"))


@add("u3_distinct_drugs", ["submissions"], "SELECT DISTINCT drug_name FROM submissions WHERE drug_name IS NOT NULL")
def _(t):
    return R.distinct_values(t.view("submissions"), "drug_name")


@add("s1_submission_rows", ["files"], """
SELECT sha256(path) AS id, sha256(path) || '_' || list_extract(string_split(path, '/'), -1) AS filename, 'PDF' AS submission_type,
  'uploaded' AS status, 'anonymous' AS submitted_by, 'Unknown' AS severity, 'Unknown' AS outcome, '' AS adverse_event, '' AS drug_name FROM files""")
def _(t):
    files = t.view("files").withColumn("modified_at", F.lit(AS_OF))
    return documents.submission_rows(files).drop("created_at")


_EXT = "lower(regexp_extract(list_extract(string_split(path, '/'), -1), '\\.([^.]+)$', 1))"
_BIG = "'File size must be less than 100MB (Current: ' || printf('%.2f', length / 1048576.0) || 'MB)'"


@add("s2_intake_by_extension", ["files"], f"""
SELECT doc_id, reason, reason IS NULL AS accepted FROM (
  SELECT doc_id, CASE WHEN length > 104857600 THEN {_BIG}
    WHEN {_EXT} NOT IN ('pdf', 'doc', 'docx', 'jpg', 'jpeg', 'png') THEN 'File extension not allowed: ' || {_EXT} END AS reason FROM files)""")
def _(t):
    return documents.intake_check(t.view("files")).select("doc_id", "reason", "accepted")


@add("s2_intake_by_type", ["files"], f"""
SELECT doc_id, reason, reason IS NULL AS accepted FROM (
  SELECT doc_id, CASE WHEN length > 104857600 THEN {_BIG}
    WHEN mime NOT IN ('application/pdf', 'image/jpeg', 'image/png', 'image/tiff') THEN 'File must be PDF, JPEG, PNG, or TIFF format' END AS reason FROM files)""")
def _(t):
    return documents.intake_check(t.view("files"), mime="mime").select("doc_id", "reason", "accepted")


_WS = "'^[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$'"


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, {_WS}, '', 'g')"


@add("s3_extract_texts", ["text_candidates"], f"""
WITH ok AS (SELECT doc_id, min(method_rank) AS method_rank FROM text_candidates WHERE length({trimmed("text")}) >= 100 GROUP BY 1)
SELECT d.doc_id, coalesce(ok.method_rank, 0) AS method_rank, coalesce(md5(c.text), '') AS text_md5,
  CASE WHEN ok.method_rank IS NULL THEN 'low' WHEN ok.method_rank = 2 THEN 'medium' ELSE 'high' END AS extraction_quality,
  CASE WHEN ok.method_rank IS NULL THEN 'EXTRACTION_FAILED' ELSE 'SUCCESS' END AS status
FROM (SELECT DISTINCT doc_id FROM text_candidates) d LEFT JOIN ok ON d.doc_id = ok.doc_id
LEFT JOIN text_candidates c ON c.doc_id = ok.doc_id AND c.method_rank = ok.method_rank""")
def _(t):
    out = documents.extract_texts(t.view("text_candidates"))
    return out.select(
        "doc_id", F.coalesce("method_rank", F.lit(0)).alias("method_rank"),
        F.coalesce(F.md5("text"), F.lit("")).alias("text_md5"), "extraction_quality", "status",
    )


@add("s4_line_listing_texts", ["text_candidates"], """
WITH ok AS (SELECT doc_id, min(method_rank) AS method_rank, arg_min(md5(text), method_rank) AS text_md5 FROM text_candidates
  WHERE (method_rank = 3 AND doc_id % 2 = 0 AND length(trim(text)) >= 1) OR (method_rank < 3 AND length(trim(text)) >= 100) GROUP BY 1)
SELECT d.doc_id, coalesce(method_rank, 0) AS method_rank, coalesce(text_md5, '') AS text_md5, CASE WHEN method_rank IS NULL THEN 'WARNING' ELSE 'SUCCESS' END AS status
FROM (SELECT DISTINCT doc_id FROM text_candidates) d LEFT JOIN ok USING (doc_id)""")
def _(t):
    marked = t.view("text_candidates").withColumn("is_txt", F.col("doc_id") % 2 == 0)
    return documents.line_listing_texts(marked).select(
        "doc_id", F.coalesce("method_rank", F.lit(0)).alias("method_rank"), F.coalesce(F.md5("text"), F.lit("")).alias("text_md5"), "status"
    )


@add("s5_json_records", [], """
SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events""")
def _(t):
    rows = t.table("events").select("event_id", "props")
    return documents.parse_json_records(rows, "props", "k bigint")


@add("s5_json_lists", ["results"], f"""
SELECT id, (generate_subscripts({_ISSUES}, 1) - 1)::INT AS pos, unnest({_ISSUES}) AS issue FROM results""")
def _(t):
    rows = t.view("results").select("id", "result")
    body = F.from_json(F.get_json_object("result", "$.critical_issues"), "array<string>")
    return rows.select("id", F.posexplode(body).alias("pos", "issue"))


@add("s6_stored_table", [], "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    stored = documents.table(t.spark, f"{t.folder}/orders.parquet")
    return stored.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@add("s7_result_rows", ["submissions"], """
SELECT id AS submission_id, 'Status Check' AS check_type, CASE WHEN status = 'failed' THEN 'FAIL' ELSE 'PASS' END AS status,
  '{"severity":"' || coalesce(severity, 'none') || '","drug_name":"' || drug_name || '"}' AS result FROM submissions""")
def _(t):
    subs = t.view("submissions").withColumn("severity", F.coalesce("severity", F.lit("none")))
    status = F.when(F.col("status") == "failed", "FAIL").otherwise("PASS")
    return sinks.result_rows(subs, "Status Check", status, ["severity", "drug_name"])


@add("s7_results_written_again", ["submissions"], """
SELECT run, check_type, status, count(*) AS n FROM (SELECT 'first' AS run, 'Status Check' AS check_type, CASE WHEN status = 'failed' THEN 'FAIL' ELSE 'PASS' END AS status FROM submissions
  UNION ALL SELECT 'second', CASE WHEN severity = 'Mild' THEN 'Severity / mild' ELSE 'Severity' END, 'PASS' FROM submissions WHERE status = 'failed') GROUP BY ALL""")
def _(t):
    subs, base = t.view("submissions"), new_folder(t.spark, "s7")
    status = F.when(F.col("status") == "failed", "FAIL").otherwise("PASS")
    first = sinks.result_rows(subs, "Status Check", status, ["severity"])
    second = sinks.result_rows(subs.filter(F.col("status") == "failed"), "Severity", F.lit("PASS"), ["severity"])
    mild = F.get_json_object("result", "$.severity") == "Mild"
    second = second.withColumn("check_type", F.when(mild, "Severity / mild").otherwise(F.col("check_type")))
    for rows, run in ((first, "first"), (second.filter(F.col("check_type") == "Severity"), "second"), (second, "second"), (first, "first")):
        sinks.write_results(rows, base, run)
    return sinks.read_results(t.spark, base).groupBy("run", "check_type", "status").agg(F.count(F.lit(1)).alias("n"))


@add("s8_audit_entries", ["submissions"], """
WITH e AS (SELECT 'UPLOAD_SUBMISSION' AS operation, submitted_by AS user_id, id AS resource,
  '{"outcome":"' || coalesce(outcome, '') || '","drug_name":"' || drug_name || '"}' AS details FROM submissions)
SELECT sha256(concat_ws(chr(31), operation, user_id, resource, details, '1998-06-30 00:00:00')) AS id, operation, user_id, resource, details,
  sha256(details) AS data_hash FROM e""")
def _(t):
    subs = t.view("submissions")
    details = F.struct(F.coalesce("outcome", F.lit("")).alias("outcome"), "drug_name")
    out = sinks.audit_entries(subs, "UPLOAD_SUBMISSION", F.col("submitted_by"), F.col("id"), details, AS_OF, hashed=True)
    return out.drop("timestamp")


_NEW = "CASE WHEN o_orderkey % 5 = 0 THEN 'approved' ELSE o_orderstatus END"


_CHANGES = f"""
WITH old AS (SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, o_custkey AS owner FROM orders),
new AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'new-' ELSE '' END || o_orderkey::VARCHAR AS id, {_NEW} AS status, o_custkey AS owner FROM orders)
SELECT CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS action, 'submissions' AS entity_type,
  coalesce(o.id, n.id) AS entity_id,
  '{{"id":"' || o.id || '","status":"' || o.status || '","owner":' || o.owner || '}}' AS old_data,
  '{{"id":"' || n.id || '","status":"' || n.status || '","owner":' || n.owner || '}}' AS new_data, 'SUCCESS' AS status
FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.status <> n.status OR o.owner <> n.owner"""


def _snapshots(t):
    key = F.col("o_orderkey")
    base = t.table("orders").select(key, key.cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    old = base.select("id", "status", "owner")
    renamed = F.concat(F.when(key % 11 == 0, "new-").otherwise(""), "id").alias("id")  # a renamed key is deleted and inserted
    new = base.select(renamed, F.when(key % 5 == 0, "approved").otherwise(F.col("status")).alias("status"), "owner")
    return old, new


@add("s9_snapshot_changes", [], _CHANGES)
def _(t):
    return changes.snapshot_changes(*_snapshots(t), "submissions", AS_OF).drop("changed_at")


@add("s9_range_changes", [], _CHANGES)
def _(t):
    return changes.range_changes(*_snapshots(t), "submissions", AS_OF).drop("changed_at")


@add("s10_export_sections", ["submissions", "results"], f"""
SELECT 'Summary Statistics' AS section, 'Total Submissions' AS key, count(*)::DOUBLE AS value FROM submissions
UNION ALL SELECT 'Summary Statistics', 'Passed Validations', (count(*) FILTER (status = 'PASSED'))::DOUBLE FROM submissions
UNION ALL SELECT 'Summary Statistics', 'Pass Rate (%)', round(count(*) FILTER (status = 'PASSED') / count(*) * 100, 2) FROM submissions
UNION ALL SELECT 'Summary Statistics', 'Total Records Processed', count(*)::DOUBLE FROM results
UNION ALL SELECT 'Severity Distribution', value, n::DOUBLE FROM ({_result_dist("severity")})
UNION ALL SELECT 'Outcome Distribution', value, n::DOUBLE FROM ({_result_dist("outcome")})""")
def _(t):
    return sinks.export_sections(t.view("submissions"), t.view("results"))


@add("s10_export_records", ["submissions"], """
SELECT id AS submission_id, CASE WHEN filename <> '' THEN filename ELSE 'N/A' END AS filename,
  CASE WHEN submission_type <> '' THEN submission_type ELSE 'Unknown' END AS type, coalesce(status, 'Unknown') AS status,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_date FROM submissions""")
def _(t):
    return sinks.export_records(t.view("submissions"))


@add("s13_status_upsert", ["submissions"], """
WITH last AS (SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY 1)
SELECT s.id, coalesce(l.event_type, s.status) AS status, CASE WHEN l.user_id IS NOT NULL THEN CASE WHEN l.value > 50 THEN 'Severe' ELSE 'Mild' END ELSE s.severity END AS severity
FROM submissions s LEFT JOIN last l ON s.id = l.user_id::VARCHAR""")
def _(t):
    moves = t.table("events").select(
        F.col("user_id").cast("string").alias("id"), F.col("ts").alias("changed_at"), F.col("event_type").alias("status"),
        F.when(F.col("value") > 50, "Severe").otherwise("Mild").alias("severity"),
    )
    return sinks.upsert_status(t.view("submissions"), moves, ["status", "severity"]).select("id", "status", "severity")
