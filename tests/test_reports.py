"""The document that packs its lines against the one that joins line rows."""

from caselight.operators import analytics as A
from caselight.operators import reports as T
from caselight.plans import load_catalog

SUBMISSIONS = "id string, filename string, status string, created_at timestamp"
RESULTS = "submission_id string, check_type string, result string, status string, pos bigint"


def _by_rows(subs, results):
    found = T.findings(subs, results)
    summary = T.lines_to_text(T.summary_lines(subs, results), ["part", "pos"])
    return T.results_document(A.results_rollup(subs, results), T.key_findings(found), found, T.recommendations(subs, results), summary)


def _packed(subs, results):
    rows = T.key_findings(T.findings(T.packed_lines(A.results_rollup(subs, results), subs, results)))
    return T.results_document(T.lines_to_text(T.summary_lines(T.recommendations(rows)), ["part", "pos"], packed="summary"))


def test_packed_document_equals_the_one_of_rows(spark):
    """Repeated, null and unknown ids, equal and null positions, checks without a line, and more findings than are numbered.

    Findings of equal position are ranked in no order by the row form, so they lie past the numbered ones.
    """
    subs = spark.createDataFrame(
        [("a", "f.pdf", "completed", None), ("b", None, "failed", None), ("c", "", None, None), ("d", "z", "failed", None), ("d", "y", "completed", None),
         ("d", "y", "uploaded", None), (None, "n", "failed", None), (None, "n", "completed", None), ("e", "e", "completed", None)], SUBMISSIONS)
    form = '{"completeness": 50, "critical_issues": ["x", "y", "z", "u"], "missing_fields": ["p", "q", "r"]}'
    rows = [
        ("a", "ADR Validation", form, "PASS", 2), ("a", "Form 44 Validation", form, "FAIL", 5), ("a", "Duplicate Detection", None, "PASS", 1),
        ("b", "Form 44 Validation", "raw", "FAIL", 3), ("b", "Consistency Check", form, "FAIL", 4), ("b", "Duplicate Detection", '{"duplicates_found": 2}', "FAIL", 5),
        ("b", "MD-14 Validation", None, "SKIPPED", 6), ("b", "Other", None, "NEEDS_REVIEW", 7), ("b", "MD-14 Validation", None, "FAIL", None),
        ("d", "Form 44 Validation", form, "FAIL", 1), ("d", "Other", None, "ERROR", 2), (None, "Duplicate Detection", None, "PASS", 1),
        ("unknown", "Duplicate Detection", None, "PASS", 1), ("e", None, None, "PASS", 1), ("e", "Other", None, "FAIL", 2),
        ("c", "Consistency Check", form, "FAIL", 20), ("c", "Duplicate Detection", '{"duplicates_found": 2}', "FAIL", 20),
        *[("c", "Naranjo Causality Scoring", '{"causality_score": %d}' % i, "PASS", 10 - i) for i in range(8)],
    ]
    results = spark.createDataFrame(rows, RESULTS)
    want = sorted(tuple(r) for r in _by_rows(subs, results).fillna("none", ["id"]).collect())
    got = sorted(tuple(r) for r in _packed(subs, results).fillna("none", ["id"]).collect())
    assert len(got) == 9
    assert got == want
    texts = dict(got)
    assert "1. Causality: Naranjo Score 7/13 - Unknown" in texts["c"] and "\n6. " not in texts["c"]
    assert texts["d"].count("Contact regulatory team") == 1 and texts["d"].count("=== SUBMISSION VALIDATION SUMMARY ===") == 3
    assert "No summary available" in texts["none"]


def test_document_reads_its_tables_twice(spark, small):
    """The line rows read the results seven times and collected every line after a shuffle; the packed ones take one pass beside the rollup's."""
    plan = load_catalog()["s12_results_document"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 2
    assert plan.count("Relation [o_orderkey") == 2
    assert "Generate" not in plan and "Union" not in plan


def test_lines_are_sorted_in_compiled_code(spark):
    lines = spark.createDataFrame([("a", 2, "z"), ("a", 1, "y"), ("a", 1, "x"), ("a", 3, None)], "id string, pos int, line string")
    text = T.lines_to_text(lines, ["pos"])
    assert text.first()["text"] == "x\ny\nz"
    assert "lambda" not in text._jdf.queryExecution().optimizedPlan().toString()
