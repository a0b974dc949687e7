"""Result, audit, status and export sinks."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselight.functions.presence import default_if_blank
from caselight.operators.analytics import export_statistics, result_distribution


def result_rows(df: DataFrame, check_type: str, status: Column, payload: list[str], key: str = "id") -> DataFrame:
    """One result row per performed check, the payload as JSON text."""
    return df.select(
        F.col(key).alias("submission_id"),
        F.lit(check_type).alias("check_type"),
        status.alias("status"),
        F.to_json(F.struct(*payload)).alias("result"),
    )


def write_results(results: DataFrame, path: str, run: str) -> None:
    """Write the results of one run, in place of what the same run wrote before.

    Rows go to a folder of this attempt, one folder per check type below it, and an entry of the ledger then names the attempt as the run's. A
    job that is retried, or fails half-way, so leaves the rows of one attempt. ``drop_superseded`` deletes the others.
    """
    attempt = uuid.uuid4().hex
    parts = results.withColumns({"run": F.lit(run), "attempt": F.lit(attempt)})
    parts.write.mode("append").partitionBy("run", "attempt", "check_type").parquet(f"{path}/rows")
    entry = results.sparkSession.createDataFrame([(run, attempt)], "run string, attempt string")
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/of={hashlib.sha256(run.encode()).hexdigest()}")


def _ledger(spark: SparkSession, path: str) -> list:
    """The attempt that counts of every run; a row per run."""
    return spark.read.schema("run string, attempt string").parquet(f"{path}/ledger/of=*").collect()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all runs that ended, each once, with their run; filters on run and check type prune folders."""
    kept = [r["attempt"] for r in _ledger(spark, path)]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.filter(F.col("attempt").isin(kept)).drop("attempt")


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete the attempts that the ledger does not name, and return their number; not while a run is being written."""
    kept = {r["attempt"] for r in _ledger(spark, path)}
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(place(f"{path}/rows/run=*/attempt=*"))
    gone = [f.getPath() for f in found if f.getPath().getName().removeprefix("attempt=") not in kept]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)


def audit_entries(df: DataFrame, operation: str, user: Column, resource: Column, details: Column, at: dt.datetime | Column, hashed: bool = False) -> DataFrame:
    """Audit rows derived from a stage's output.

    Details become JSON. The id hashes the entry, so a repeated write can be recognised.
    """
    when = at if isinstance(at, Column) else F.lit(at)
    out = df.select(
        F.lit(operation).alias("operation"), user.alias("user_id"), resource.alias("resource"),
        F.to_json(details).alias("details"), when.alias("timestamp"),
    )
    key = F.sha2(F.concat_ws("\x1f", "operation", "user_id", "resource", "details", F.col("timestamp").cast("string")), 256)
    out = out.select(key.alias("id"), "*")
    return out.withColumn("data_hash", F.sha2("details", 256)) if hashed else out


def write_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def latest_status(changes: DataFrame, key: str = "id", at: str = "changed_at") -> DataFrame:
    """Last change of each key; map tasks keep one row per key."""
    others = [c for c in changes.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(at, *[c for c in others if c != at]))
    return changes.groupBy(key).agg(last.alias("r")).select(key, "r.*")


def upsert_status(submissions: DataFrame, changes: DataFrame, columns: list[str], key: str = "id", at: str = "changed_at") -> DataFrame:
    """Submissions with the named columns taken from their last change."""
    last = latest_status(changes.select(key, at, *columns), key, at).select(
        key, F.struct(*columns).alias("_new")
    )
    joined = submissions.join(last, key, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in submissions.columns
        ]
    )


def export_records(submissions: DataFrame) -> DataFrame:
    """Submission records of the CSV export with their defaults."""
    return submissions.select(
        F.col("id").alias("submission_id"),
        default_if_blank(F.col("filename"), "N/A").alias("filename"),
        default_if_blank(F.col("submission_type"), "Unknown").alias("type"),
        default_if_blank(F.col("status"), "Unknown").alias("status"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("created_date"),
    )


def export_sections(submissions: DataFrame, results: DataFrame) -> DataFrame:
    """Summary, severity and outcome sections as (section, key, value)."""
    stats = export_statistics(submissions)
    total = results.agg(F.count(F.lit(1)).alias("n"))

    def line(df: DataFrame, section: str, key: Column | str, value: Column) -> DataFrame:
        name = F.lit(key) if isinstance(key, str) else key
        return df.select(F.lit(section).alias("section"), name.alias("key"), value.cast("double").alias("value"))

    out = line(stats, "Summary Statistics", "Total Submissions", F.col("total_submissions"))
    out = out.unionByName(line(stats, "Summary Statistics", "Passed Validations", F.col("passed_submissions")))
    out = out.unionByName(line(stats, "Summary Statistics", "Pass Rate (%)", F.col("pass_rate")))
    out = out.unionByName(line(total, "Summary Statistics", "Total Records Processed", F.col("n")))
    for member in ("severity", "outcome"):
        out = out.unionByName(
            line(result_distribution(results, member), f"{member.title()} Distribution", F.col("value"), F.col("n"))
        )
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_texts(texts: DataFrame, path: str, key: str = "id") -> None:
    """One text row per submission, texts of a bucket of ids together in a folder."""
    bucketed = texts.select(F.pmod(F.xxhash64(key), F.lit(64)).alias("bucket"), F.col("text").alias("value"))
    bucketed.write.mode("overwrite").partitionBy("bucket").option("lineSep", "\n\f\n").text(path)
