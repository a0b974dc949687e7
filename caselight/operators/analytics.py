"""Counts, distributions, listings and rankings over submissions and their check results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselight.functions.presence import default_if_blank, strip
from caselight.functions.text import bucket
from caselight.operators.clean import display_defaults
from caselight.operators.ordering import OrderIndex, rows_between
from caselight.schemas import (
    EXPORT_PASSED_STATUSES,
    FORM_CHECKS,
    FRAMEWORK_ADJUSTMENTS,
    OUTCOME_BUCKETS,
    PASSED_STATUSES,
    SEVERITY_BUCKETS,
)


def is_form_check(check_type: Column) -> Column:
    """Substring test that picks the form checks."""
    out = F.lit(False)
    for part in FORM_CHECKS:
        out = out | check_type.contains(part)
    return out


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(part / F.nullif(whole, F.lit(0)) * 100, digits), F.lit(0.0))


def summary(submissions: DataFrame, passed: list[str] = PASSED_STATUSES) -> DataFrame:
    """Total, passed and pass rate; the rate is 0 for an empty table."""
    return submissions.agg(
        F.count(F.lit(1)).alias("total_submissions"),
        F.count_if(F.col("status").isin(passed)).alias("passed_submissions"),
    ).withColumn("pass_rate", percent(F.col("passed_submissions"), F.col("total_submissions")))


def distribution(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Count per vocabulary bucket, zero rows included, in one pass without a join."""
    value = bucket(F.col(column), vocabulary)
    counts = df.agg(*[F.count_if(value == v).alias(f"n{i}") for i, v in enumerate(vocabulary)])
    rows = F.array(
        *[F.struct(F.lit(v).alias("value"), F.col(f"n{i}").alias("n")) for i, v in enumerate(vocabulary)]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.value", "r.n")


def dashboard_summary(submissions: DataFrame) -> DataFrame:
    """Summary, severity and outcome counts as (section, key, value) from a single scan."""
    severity, outcome = bucket(F.col("severity"), SEVERITY_BUCKETS), bucket(F.col("outcome"), OUTCOME_BUCKETS)
    passed = F.count_if(F.col("status").isin(PASSED_STATUSES))
    total = F.count(F.lit(1))
    counters = [("summary", "total_submissions", total), ("summary", "passed_submissions", passed)]
    counters += [("severity", v, F.count_if(severity == v)) for v in SEVERITY_BUCKETS]
    counters += [("outcome", v, F.count_if(outcome == v)) for v in OUTCOME_BUCKETS]
    one = submissions.agg(
        *[c.alias(f"n{i}") for i, (_, _, c) in enumerate(counters)], percent(passed, total).alias("rate")
    )
    rows = [
        F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.col(f"n{i}").cast("double").alias("value"))
        for i, (s, k, _) in enumerate(counters)
    ]
    rows.append(F.struct(F.lit("summary").alias("section"), F.lit("pass_rate").alias("key"), F.col("rate").alias("value")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def severity_total(submissions: DataFrame) -> DataFrame:
    """Total of the severity counts."""
    return distribution(submissions, "severity", SEVERITY_BUCKETS).agg(F.sum("n").alias("total_records"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """Most frequent non-blank values, ties in alphabetical order."""
    value = strip(F.col(column))
    return (
        df.select(value.alias("value")).filter(F.length("value") > 0)
        .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("value")).limit(k)
    )


def grouped_totals(submissions: DataFrame, groups: dict[str, Column], sets: list[list[str]] | None = None) -> DataFrame:
    """Submissions, passed ones and the pass rate per combination of groups, with totals, in one aggregation.

    ``groups`` names the grouping expressions. Without ``sets`` all prefixes are totalled, as a roll-up does; ``level`` has a bit for each
    group that a row does not tell apart, the first group's bit highest, so that totals are told from groups without a value.
    """
    names = list(groups)
    wanted = sets if sets is not None else [names[:i] for i in range(len(names), -1, -1)]
    rows = submissions.select(*[c.alias(n) for n, c in groups.items()], F.col("status").isin(PASSED_STATUSES).alias("_passed"))
    passed = F.count_if("_passed")
    return rows.groupingSets([[F.col(n) for n in s] for s in wanted], *[F.col(n) for n in names]).agg(
        F.grouping_id(*names).cast("long").alias("level"), F.count(F.lit(1)).alias("n"), passed.alias("passed"), percent(passed, F.count(F.lit(1))).alias("pass_rate"),
    )


def form_type_distribution(submissions: DataFrame, *more: str) -> DataFrame:
    """Count per submission type, null or empty as Unknown; further grouping columns optional."""
    kind = default_if_blank(F.col("submission_type"), "Unknown").alias("submission_type")
    return submissions.groupBy(kind, *more).agg(F.count(F.lit(1)).alias("n"))


def export_statistics(submissions: DataFrame, passed: list[str] = EXPORT_PASSED_STATUSES) -> DataFrame:
    """Summary of an export; counts its own set of passed statuses."""
    return summary(submissions, passed)


def result_distribution(results: DataFrame, member: str) -> DataFrame:
    """Count per value of a member of the result JSON objects; absent counts as Unknown, text that is no object is left out."""
    is_object = F.json_object_keys("result").isNotNull()
    value = F.coalesce(F.get_json_object("result", f"$.{member}"), F.lit("Unknown"))
    return (
        results.filter(is_object).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy("value")
    )


def status_dashboard(submissions: DataFrame, anonymized: DataFrame) -> DataFrame:
    """Per status: rows, mean compliance score, failed k-anonymity checks."""
    joined = submissions.join(
        anonymized.select(F.col("submission_id").alias("id"), "compliance_score", "k_anonymity_status"), "id", "left"
    )
    return joined.groupBy("status").agg(
        F.count(F.lit(1)).alias("submission_count"),
        F.avg("compliance_score").alias("avg_compliance_score"),
        F.count_if(F.col("k_anonymity_status") == "FAIL").alias("k_anonymity_failures"),
    )


def _completeness(default: str = "0") -> Column:
    return F.coalesce(F.get_json_object("result", "$.completeness"), F.lit(default))


def _critical_issues() -> Column:
    return F.from_json(F.get_json_object("result", "$.critical_issues"), "array<string>")


def _last_form() -> Column:
    """Aggregate: completeness and status of the last form check, null without one."""
    return F.max_by(
        F.struct(_completeness().alias("completeness"), "status"), F.when(is_form_check(F.col("check_type")), F.col("pos"))
    ).alias("form")


def first_issues(results: DataFrame, k: int = 3) -> DataFrame:
    """First k critical issues of the failed checks of each submission.

    The first k issues come from the first k failed checks that have any, so only that many rows
    per submission leave a map task.
    """
    failed = results.filter(F.col("status") == "FAIL").withColumn("issues", _critical_issues()).filter(
        F.size("issues") > 0
    )
    rank = F.row_number().over(Window.partitionBy("submission_id").orderBy("pos"))
    heads = failed.select("submission_id", "pos", "issues").withColumn("rn", rank).filter(F.col("rn") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "issues")))
    flat = F.flatten(F.transform(ordered, lambda s: s["issues"]))
    return heads.groupBy("submission_id").agg(F.slice(flat, 1, k).alias("critical_issues"))


def submission_overview(submissions: DataFrame, results: DataFrame) -> DataFrame:
    """Every submission with its form status, first issues and number of checks."""
    counts = results.groupBy("submission_id").agg(F.count(F.lit(1)).alias("checks_count"), _last_form())
    extra = counts.join(first_issues(results), "submission_id", "left").withColumnRenamed("submission_id", "id")
    shown = submissions.withColumns(display_defaults(submissions))
    return shown.join(extra, "id", "left").select(
        *submissions.columns,
        F.coalesce("form.status", F.lit("UNKNOWN")).alias("validation_status"),
        F.coalesce(F.col("form.completeness").cast("double"), F.lit(0.0)).alias("form_completeness"),
        F.coalesce("critical_issues", F.array().cast("array<string>")).alias("critical_issues"),
        F.coalesce("checks_count", F.lit(0)).alias("checks_count"),
    )


def submission_page(submissions: DataFrame, results: DataFrame, page: int = 1, per_page: int = 10) -> DataFrame:
    """One page of submissions, newest first, with totals as columns.

    The page is cut first. Its ids then filter the results, so only the page's results are aggregated.
    """
    rows = submissions.orderBy(F.desc("created_at"), F.asc("id")).offset((page - 1) * per_page).limit(per_page)
    ids = rows.select(F.col("id").alias("submission_id"))
    total = submissions.select(F.count(F.lit(1))).scalar()
    return submission_overview(rows, results.join(ids, "submission_id", "left_semi")).withColumns(
        {"page": F.lit(page), "per_page": F.lit(per_page), "total": total}
    ).withColumn("pages", F.ceil(F.col("total") / per_page)).orderBy(F.desc("created_at"), F.asc("id"))


def indexed_page(index: OrderIndex, submissions: DataFrame, results: DataFrame, page: int = 1, per_page: int = 10) -> DataFrame:
    """One page from an order index of ``submissions`` by ``newest_first``; the last page costs what the first does.

    The index tells the total and the ranges that hold the page, so nothing before it is read or sorted.
    """
    first = (page - 1) * per_page
    rows = rows_between(submissions.sparkSession, index, first, first + per_page).select(*submissions.columns)
    ids = rows.select(F.col("id").alias("submission_id"))
    return submission_overview(rows, results.join(ids, "submission_id", "left_semi")).withColumns(
        {"page": F.lit(page), "per_page": F.lit(per_page), "total": F.lit(index.total), "pages": F.lit(-(-index.total // per_page))}
    ).orderBy(*newest_first())


def newest_first() -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


def page_after(submissions: DataFrame, created_at: dt.datetime, last_id: str, per_page: int = 10) -> DataFrame:
    """Next page after a known row; the filter reaches the scan, so depth costs nothing."""
    older = (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("id") > last_id))
    return submissions.filter(older).orderBy(F.desc("created_at"), F.asc("id")).limit(per_page)


def submission_status(submissions: DataFrame, results: DataFrame) -> DataFrame:
    """Submissions with their checks, one row per check (one row with nulls when there is none)."""
    checks = results.select(
        F.col("submission_id").alias("id"), "pos", "check_type", F.col("status").alias("check_status"),
        F.col("created_at").alias("checked_at"),
    )
    return submissions.select("id", "filename", F.col("submission_type").alias("type"), "status", "created_at").join(
        checks, "id", "left"
    )


def check_counts(results: DataFrame, *more: Column) -> DataFrame:
    """Per submission the number of checks by status, and further aggregates."""

    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return results.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("total_checks"),
        n("PASS").alias("checks_passed"),
        n("FAIL").alias("checks_failed"),
        n("SKIPPED").alias("checks_skipped"),
        n("ERROR").alias("checks_errored"),
        *more,
    )


COUNT_COLUMNS = ["total_checks", "checks_passed", "checks_failed", "checks_skipped", "checks_errored"]


def results_rollup(submissions: DataFrame, results: DataFrame) -> DataFrame:
    """Check counts, completeness and overall status of every submission."""
    extra = check_counts(results, _last_form()).withColumnRenamed("submission_id", "id")
    return submissions.select("id", "filename", "status", "created_at").join(extra, "id", "left").select(
        "id", "filename", "status", "created_at",
        F.when(F.col("status") == "completed", "PASS").otherwise("FAIL").alias("overall_status"),
        F.coalesce(F.col("form.completeness").cast("double"), F.lit(0.0)).alias("form_completeness"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNT_COLUMNS],
    )


def form_issues(results: DataFrame) -> DataFrame:
    """Critical issues of failed form checks, one row each in order."""
    failed = results.filter(is_form_check(F.col("check_type")) & (F.col("status") == "FAIL"))
    return failed.select("submission_id", "pos", F.posexplode(_critical_issues()).alias("issue_no", "issue"))


def process_rollup(results: DataFrame) -> DataFrame:
    """Final status of a processed submission: failed when any check failed, else completed."""
    return check_counts(results).withColumn(
        "processing_status", F.when(F.col("checks_failed") > 0, "failed").otherwise("completed")
    )


def status_counters(submissions: DataFrame) -> DataFrame:
    """Total and the three dashboard counters, one row."""
    return submissions.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("processing", "completed", "failed")],
    )


def framework_scores(rollup: DataFrame) -> DataFrame:
    """Adjusted score per framework; null without checks."""
    base = F.round(F.col("checks_passed") / F.nullif(F.col("total_checks"), F.lit(0)) * 100)
    frames = F.array(
        *[F.struct(F.lit(n).alias("framework"), F.lit(a).alias("adjustment")) for n, a in FRAMEWORK_ADJUSTMENTS]
    )
    rows = rollup.withColumn("f", F.explode(frames))
    score = F.when(base.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), base + F.col("f.adjustment"))))
    return rows.select(
        "id", F.col("f.framework").alias("framework"), score.alias("score"),
        (F.col("overall_status") == "PASS").alias("compliant"),
    )


def submission_report(submissions: DataFrame, results: DataFrame, ids: list[str]) -> DataFrame:
    """Roll-up of a few submissions; the id filter reaches both scans."""
    return results_rollup(
        submissions.filter(F.col("id").isin(ids)), results.filter(F.col("submission_id").isin(ids))
    )


def priority_ranking(cases: DataFrame, submissions: DataFrame, k: int | None = None) -> DataFrame:
    """Cases with their submission, highest priority first; the top k where asked for.

    The top k are ranked on cases that have a submission, with the ids of submissions only, and just they are joined to the rest.
    """
    if k is not None:
        known = submissions.select(F.col("id").alias("submission_id"))
        cases = cases.join(known, "submission_id", "left_semi").orderBy(F.desc("priority_score"), F.asc("id")).limit(k)
    joined = cases.join(
        submissions.select(F.col("id").alias("submission_id"), "submission_type", "created_at"), "submission_id"
    ).select(
        "id", "case_id", "event_term", "severity_grade", "naranjo_score", "priority_score", "priority_level",
        "submission_type", "created_at",
    )
    ranked = joined.orderBy(F.desc("priority_score"), F.asc("id"))
    return ranked if k is None else ranked.limit(k)


def top_per_group(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """Top k of every group; each map task forwards at most k rows per group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def newest(df: DataFrame, k: int = 5, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(key)).limit(k)


def first_match(results: DataFrame, test: Column, group: str = "submission_id", pos: str = "pos") -> DataFrame:
    """First row of each group that passes a test."""
    others = [c for c in results.columns if c != group]
    return results.filter(test).groupBy(group).agg(F.min_by(F.struct(*others), pos).alias("r")).select(group, "r.*")


def last_match(results: DataFrame, test: Column, group: str = "submission_id", pos: str = "pos") -> DataFrame:
    others = [c for c in results.columns if c != group]
    return results.filter(test).groupBy(group).agg(F.max_by(F.struct(*others), pos).alias("r")).select(group, "r.*")
