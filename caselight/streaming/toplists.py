"""Most frequent values per time window of a stream, exact, from mergeable sketches and a second count of what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from caselight.functions.presence import strip
from caselight.sources.staging import stage
from caselight.streaming.sinks import write_batches

#: Values a sketch tracks per window.
TRACKED = 1024
#: A sketch is off by 3.5 parts of its rows in ``TRACKED`` at most, and lists no value that may be as rare as twice that.
OFF = 7

_COUNTS = "window_start timestamp, value string, n long"


def _sketch_schema(spark: SparkSession) -> T.StructType:
    one = spark.range(0).select(F.expr(f"approx_top_k_accumulate('', {TRACKED})").alias("sketch")).schema["sketch"].dataType
    return T.StructType([T.StructField("window_start", T.TimestampType()), T.StructField("sketch", one), T.StructField("n", T.LongType())])


def top_values_stream(rows: DataFrame, at: str, value: str, window: str, path: str, checkpoint: str, tracked: int = TRACKED) -> StreamingQuery:
    """Write, for each micro-batch, a sketch per window under ``path``/sketches and counts per window and value under ``path``/counts.

    Both are reduced where the rows are read. Blank values and rows without a time are left out. A batch that is retried overwrites its own folders.
    """

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        found = batch.select(F.window(at, window)["start"].alias("window_start"), strip(F.col(value)).alias("value"))
        found = found.filter("window_start is not null and length(value) > 0")
        counts = found.groupBy("window_start", "value").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        return found.groupBy("window_start").agg(F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n"))

    return write_batches(rows, f"{path}/sketches", checkpoint, "append", step)


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window_start").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("window_start", "value").agg(F.sum("n").alias("n"))


def top_values_per_window(spark: SparkSession, path: str, k: int = 5, tracked: int = TRACKED) -> DataFrame:
    """(window_start, rank, value, n): the ``k`` most frequent values of each window so far, ties in alphabetical order.

    Sketches of all batches are merged. Values that can be among the first ``k`` by their estimates are counted exactly; a window whose last count
    is not above what an untracked value may have is counted in full. So the result is exact, and a window with a long tail of rare values costs a few of
    them only.
    """
    sketches = spark.read.schema(_sketch_schema(spark)).parquet(f"{path}/sketches/batch=*")
    counts = spark.read.schema(_COUNTS).parquet(f"{path}/counts/batch=*")
    merged = sketches.groupBy("window_start").agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"), F.sum("n").alias("total"))
    listed = merged.select("window_start", F.ceil(F.col("total") * OFF / tracked).alias("off"), F.expr(f"approx_top_k_estimate(sketch, {tracked})").alias("items"))
    floor: Column = F.coalesce(F.get("items", F.lit(k - 1))["count"], F.lit(0)) - F.col("off")
    likely = listed.select("window_start", "off", F.explode(F.filter("items", lambda i: i["count"] >= floor)).alias("i"))
    likely = stage(likely.select("window_start", "off", F.col("i.item").alias("value")))
    first = _ranked(_summed(counts.join(likely.drop("off"), ["window_start", "value"], "left_semi")), k)
    first = stage(first)
    least = likely.groupBy("window_start").agg(F.max("off").alias("off"))
    last = first.filter(F.col("rank") == k).select("window_start", F.col("n").alias("last"))
    sure = least.join(last, "window_start").filter("last > off").select("window_start")
    rest = counts.join(sure, "window_start", "left_anti")
    whole = _ranked(_summed(rest), k)
    return first.join(sure, "window_start", "left_semi").unionByName(whole).select("window_start", "rank", "value", "n")
