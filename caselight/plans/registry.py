"""Registered queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from caselight.plans.bindings import Tables, oracle


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


class Catalog(dict):
    def add(self, name: str, views: list[str], sql: str | None = None):
        """Register a builder; ``sql`` may refer to the named views."""

        def register(build: Callable[[Tables], DataFrame]):
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Query(build, None if sql is None else oracle(views, sql))
            return build

        return register


CATALOG = Catalog()
