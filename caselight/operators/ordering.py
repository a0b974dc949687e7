"""Places in a total order without a global window, and an order index that serves any page of a table at one price."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caselight.sources.staging import new_folder, stage


def _ranges(df: DataFrame, order: list[Column], weight: Column, name: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows with the number of their range, ``_range``, and the running total before them; and per range what lies before and in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(weight).alias("n")).collect()  # a row per range
    ranges, before = [], 0
    for r in sorted(sums, key=lambda r: r["_range"]):
        ranges.append((r["_range"], before, r["n"]))
        before += r["n"]
    inside = F.sum(weight).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(df.sparkSession.createDataFrame([(r, b) for r, b, _ in ranges], "_range int, _range_start long"))
    placed = dealt.withColumn(name, F.coalesce(inside, F.lit(0)).cast("long")).join(starts, "_range")
    return placed.withColumn(name, F.col(name) + F.col("_range_start")).drop("_range_start"), ranges


def running_total(df: DataFrame, order: list[Column], weight: str, name: str) -> DataFrame:
    """Add the total of ``weight`` over all rows before a row in ``order``, which must tell all rows apart.

    Rows are sorted in ranges, each of which sums its own rows; one number per range tells what lies before it.
    """
    return _ranges(df, order, F.col(weight), name)[0].drop("_range")


# ---------------------------------------------------------------- order index

@dataclass(frozen=True)
class OrderIndex:
    """A table written in one order, in ranges; ``ranges`` has (range, first place, rows) for each that has rows."""

    folder: str
    ranges: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return self.ranges[-1][1] + self.ranges[-1][2] if self.ranges else 0


def write_order_index(df: DataFrame, order: list[Column], folder: str | None = None) -> OrderIndex:
    """Write ``df`` sorted by ``order``, with each row's ``place`` from 0, and the places where ranges begin.

    ``order`` must tell all rows apart. A range is a folder of its own, in which rows lie in order, so that a reader finds a place from the
    ranges' starts and the files' statistics. ``none`` holds the schema, for places beyond the end.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "order")
    placed, ranges = _ranges(df, order, F.lit(1), "place")
    placed.write.mode("overwrite").partitionBy("_range").parquet(f"{folder}/rows")
    placed.drop("_range").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/none")
    starts = spark.createDataFrame(ranges, "range int, first long, rows long")
    starts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranges")
    return OrderIndex(folder, tuple(ranges))


def open_order_index(spark: SparkSession, folder: str) -> OrderIndex:
    """An index that was written before; it has a row per range."""
    starts = spark.read.parquet(f"{folder}/ranges").collect()
    return OrderIndex(folder, tuple(sorted((r["range"], r["first"], r["rows"]) for r in starts)))


def rows_between(spark: SparkSession, index: OrderIndex, first: int, last: int) -> DataFrame:
    """Rows at places ``first`` to ``last``, the latter excluded, with their place; only the ranges that hold them are read."""
    held = [r for r, start, n in index.ranges if start < last and start + n > first]
    if not held:
        return spark.read.parquet(f"{index.folder}/none")
    found = spark.read.parquet(f"{index.folder}/rows").filter(F.col("_range").isin(held) & (F.col("place") >= first) & (F.col("place") < last))
    return found.drop("_range")
