"""Registered queries against their oracle SQL on the smallest tables.

One query per family by default; set CASELIGHT_ALL=1 for all of them.
"""

import os
import shutil
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from caselight.plans import load_catalog
from tools.compare import compare, database

DEFAULT = [
    "a1_dashboard", "a2_top_adverse_events", "a5_result_severity", "a6_status_dashboard", "a7_submission_page", "a9_results_rollup",
    "a13_framework_scores", "w1_top_cases_per_event", "f4_status_constraint", "j11_compliance_scorecard", "j12_cascade_delete",
    "s3_extract_texts", "s9_snapshot_changes", "s10_export_sections", "p4_clean_forms", "v2_check_forms", "v4_check_reports",
    "v8_case_batches", "c6_all_checks", "n1_score_narratives", "x2_clean_documents", "x14_onset_dates", "x16_parse_cases",
    "j2_duplicate_drugs", "j6_same_day", "r1_findings", "r3_summary_text", "y2_mask_documents", "y4_suppress", "st3_tumbling_counts",
    "st4_audit_without_repeats", "st2_stage_order", "st5_same_day_on_arrival", "s9_streamed_changes", "x7_extraction_chain", "r5_review_checks", "y2_pseudonymize_documents",
]
NAMES = list(oracle_sql()) if os.environ.get("CASELIGHT_ALL") else DEFAULT


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, small, name):
    assert compare(spark, database(small), name, queries()[name], oracle_sql()[name], small)


def test_entry(spark):
    assert entry(spark).count() == 13


def test_every_query_of_the_library_has_an_oracle():
    own = load_catalog()
    assert set(own) <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert set(own) <= set(oracle_sql())


def test_entry_point_works_without_the_text_subpackage(tmp_path):
    """A copy of the repository without the optional parts still imports and lists its own queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "caselight"), tmp_path / "caselight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) == set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
