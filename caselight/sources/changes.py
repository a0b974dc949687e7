"""Change capture between two snapshots of a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from caselight.streaming.sinks import write_batches


def snapshot_changes(
    old: DataFrame, new: DataFrame, table: str, at: dt.datetime, key: str = "id",
    operations: tuple[str, ...] = ("INSERT", "UPDATE", "DELETE"),
) -> DataFrame:
    """Audit row per inserted, updated or deleted key with both rows as JSON.

    ``operations`` lists what is audited for the table. Unchanged rows are dropped by comparing
    row hashes before any JSON is written.
    """
    columns = [c for c in new.columns if c != key]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(key, *columns).alias(name), F.xxhash64(*columns).alias(f"{name}_hash"))

    both = side(old, "old").join(side(new, "new"), key, "full_outer")
    action = (
        F.when(F.col("old").isNull(), "INSERT")
        .when(F.col("new").isNull(), "DELETE")
        .when((F.col("old_hash") != F.col("new_hash")) | ~F.col("old").eqNullSafe(F.col("new")), "UPDATE")
    )
    changed = both.withColumn("action", action).filter(F.col("action").isin(list(operations)))
    return changed.select(
        "action",
        F.lit(table).alias("entity_type"),
        F.col(key).alias("entity_id"),
        F.to_json("old").alias("old_data"),
        F.to_json("new").alias("new_data"),
        F.lit(at).alias("changed_at"),
        F.lit("SUCCESS").alias("status"),
    )


#: Ranges of key hashes whose digests are compared first.
RANGES = 4096


def differing_ranges(old: DataFrame, new: DataFrame, key: str = "id", ranges: int = RANGES) -> DataFrame:
    """Ranges of key hashes, ``range``, in which the two snapshots are not alike.

    A range's digest is its number of rows and two sums over hashes of whole rows, which do not depend on their order, so each side is reduced where
    it is read to ``ranges`` rows at most. Ranges that differ in any row have equal digests with odds of about one in 2^128.
    """
    columns = [key, *(c for c in new.columns if c != key)]

    def digests(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.pmod(F.xxhash64(key), F.lit(ranges)).alias("range"), F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        return rows.groupBy("range").agg(F.struct(F.count(F.lit(1)), total("a"), total("b")).alias(name))

    both = digests(old, "old").join(digests(new, "new"), "range", "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select("range")


def range_changes(
    old: DataFrame, new: DataFrame, table: str, at: dt.datetime, key: str = "id",
    operations: tuple[str, ...] = ("INSERT", "UPDATE", "DELETE"), ranges: int = RANGES,
) -> DataFrame:
    """``snapshot_changes`` of the rows in ranges that differ; the rows of all others are neither dealt nor joined."""
    changed = F.broadcast(differing_ranges(old, new, key, ranges))  # at most ``ranges`` numbers
    inside = F.pmod(F.xxhash64(key), F.lit(ranges)) == F.col("range")
    return snapshot_changes(old.join(changed, inside, "left_semi"), new.join(changed, inside, "left_semi"), table, at, key, operations)


def streamed_changes(
    table: DataFrame, arriving: DataFrame, name: str, path: str, checkpoint: str, key: str = "id",
    operations: tuple[str, ...] = ("INSERT", "UPDATE", "DELETE"), tombstone: str | None = None,
) -> StreamingQuery:
    """Write audit rows for rows that arrive as a stream, against the table as it is when each micro-batch comes.

    Each batch looks up its own keys only. What is not in a batch did not change. Where ``tombstone`` names a column, a row in which it is true
    deletes its key; the column is no part of the data. ``operations`` lists what is audited for the table.
    """

    def step(batch: DataFrame, batch_id: int) -> DataFrame:
        old = table.join(batch.select(key).distinct(), key, "left_semi")
        new = batch.filter(~F.coalesce(tombstone, F.lit(False))).drop(tombstone) if tombstone else batch
        return snapshot_changes(old, new, name, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), key, operations)

    return write_batches(arriving, path, checkpoint, "append", step)
