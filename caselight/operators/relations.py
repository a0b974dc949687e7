"""Joins, filters and set operations between the tables."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caselight.schemas import APP_STATUSES, RETENTION_DAYS


def by_key(df: DataFrame, ids: list[str], owner: str | None = None, key: str = "id") -> DataFrame:
    """Rows of some ids, optionally of one owner."""
    out = df.filter(F.col(key).isin(ids))
    return out if owner is None else out.filter(F.col("submitted_by") == owner)


def by_status(df: DataFrame, *statuses: str) -> DataFrame:
    return df.filter(F.col("status").isin(list(statuses)))


def split_by_status(df: DataFrame, allowed: list[str] = APP_STATUSES) -> DataFrame:
    """Mark rows whose status is outside the vocabulary as quarantined."""
    ok = F.coalesce(F.col("status").isin(allowed), F.lit(False))
    return df.withColumn("accepted", ok).withColumn(
        "reason", F.when(~ok, F.concat(F.lit("status not allowed: "), F.coalesce("status", F.lit("null"))))
    )


def within_retention(df: DataFrame, as_of: dt.datetime, days: int = RETENTION_DAYS, column: str = "created_at") -> DataFrame:
    """Rows young enough to keep. The bound is a literal, so the filter reaches the scan."""
    return df.filter(F.col(column) >= F.lit(as_of - dt.timedelta(days=days)))


def scheduled_deletion(column: Column, days: int = RETENTION_DAYS) -> Column:
    return column + F.expr(f"INTERVAL {days} DAYS")


def audit_entries_of(audit: DataFrame, operation: str, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Recent entries of one operation, newest first."""
    return audit.filter(
        (F.col("operation") == operation) & (F.col("timestamp") > F.lit(as_of - dt.timedelta(days=days)))
    ).orderBy(F.desc("timestamp"), F.asc("id"))


def purged(df: DataFrame) -> DataFrame:
    return df.filter(F.col("purged_at").isNotNull())


def with_results(submissions: DataFrame, results: DataFrame) -> DataFrame:
    """Submissions with their results in one join."""
    right = results.select(F.col("submission_id").alias("id"), "check_type", F.col("status").alias("check_status"), "result", "pos")
    return submissions.join(right, "id", "left")


def compliance_scorecard(submissions: DataFrame, compliance: DataFrame) -> DataFrame:
    scores = compliance.select(
        F.col("submission_id").alias("id"), "dpdp_score", "ndhm_score", "icmr_score", "cdsco_score",
        "overall_compliance_score", "risk_level",
    )
    return submissions.select("id", "filename").join(scores, "id", "left")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str = "submission_id", parent_key: str = "id") -> DataFrame:
    """Child rows that survive the deletion of some parents."""
    return child.join(deleted.select(F.col(parent_key).alias(key)), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, key: str = "submission_id", parent_key: str = "id") -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def combine_checks(*frames: DataFrame) -> DataFrame:
    """Append stage outputs in long form."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def concat_issues(*columns: str) -> Column:
    """One issue list out of several, nulls as empty lists."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.col(c), empty) for c in columns])
