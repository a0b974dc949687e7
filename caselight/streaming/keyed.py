"""What a key held before each batch, kept in the state store.

A stream that must look back is taken in two steps. The first reduces each micro-batch to one small row per key it touches, in the JVM
and with partial aggregation, so a key that fills a batch is one row like any other. The second, here, keeps one value per key in the state
store: work per batch grows with the keys of the batch, not with all keys seen, and a timer clears what can no longer be asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caselight.sources.shipping import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Before(StatefulProcessor):
    """Gives each row the text its key held before the row's batch, and merges the row's own text into it.

    Rows of one key are taken in the order of their batches. A batch that was merged before is passed over, so a batch written again after a
    failure does not count twice.
    """

    def __init__(self, keys: list[str], merge: Callable[[str | None, str], str], timed: bool) -> None:
        self.keys, self.merge, self.timed = keys, merge, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "batch long, value string")

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
        import pandas as pd

        batch, value = self.kept.get() if self.kept.exists() else (-1, None)
        taken = pd.concat(list(rows)).sort_values("batch")  # one row per batch
        out: list[list] = [[], [], []]
        for n, own, lost, gone in zip(taken["batch"], taken["value"], taken["lost"], taken["gone"]):
            if n <= batch:
                continue
            before = None if lost else value
            for column, x in zip(out, (int(n), own, before)):
                column.append(x)
            batch, value = int(n), None if gone else self.merge(before, own)
        if value is None:
            self.kept.clear()
        else:
            self.kept.update((batch, value))
            for at in taken["expires"].dropna().unique() if self.timed else ():
                self.handle.registerTimer(int(pd.Timestamp(at).value // 1_000_000))
        names = {k: [v] * len(out[0]) for k, v in zip(self.keys, key)}
        if out[0]:
            yield pd.DataFrame(names | dict(zip(("batch", "value", "before"), out)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def summary_schema(keys: list[str]) -> T.StructType:
    """Keys, the row's ``value`` as text, whether what was kept before is ``lost`` and the row itself ``gone``, when a key ``expires``, event time ``seen``."""
    kinds = [T.StructField(k, T.StringType()) for k in keys] + [T.StructField("value", T.StringType())]
    kinds += [T.StructField("lost", T.BooleanType()), T.StructField("gone", T.BooleanType())]
    return T.StructType(kinds + [T.StructField("expires", T.TimestampType()), T.StructField("seen", T.TimestampType()), T.StructField("batch", T.LongType())])


def summaries(spark: SparkSession, path: str, keys: list[str], max_files: int = 1000) -> DataFrame:
    """The summary rows that batches wrote under ``path``/batch=n, as a stream."""
    return spark.readStream.schema(summary_schema(keys)).option("maxFilesPerTrigger", max_files).parquet(path)


def before_each_batch(rows: DataFrame, keys: list[str], merge: Callable[[str | None, str], str], late: str | None = None) -> DataFrame:
    """(keys, batch, value, before) for each summary row; null ``before`` where the key held nothing.

    With ``late``, keys are cleared by timers once the newest ``seen`` lies so far behind ``expires``.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set(_PROVIDER, _ROCKS)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField("batch", T.LongType()), T.StructField("value", T.StringType()), T.StructField("before", T.StringType())])
    marked = rows.withWatermark("seen", late) if late else rows
    return marked.groupBy(*keys).transformWithStateInPandas(Before(keys, merge, late is not None), schema, "append", "eventTime" if late else "none")
