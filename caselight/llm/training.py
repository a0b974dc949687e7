"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import free, shares


def labelled(labels: DataFrame, keep: Column, label: str, id: str = "doc_id") -> DataFrame:
    """(id, y): mean label of every labelled document that ``keep`` admits; null ids and null labels are left out."""
    rows = labels.where(keep).select(F.col(id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    return rows.groupBy("id").agg(F.avg("y").alias("y"))


def sample(marked: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of (id, y) with the smallest hashes of their ids."""
    return marked.orderBy(shares([F.lit(13), F.col("id")]), "id").limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame, *columns: Column, id: str = "doc_id") -> DataFrame:
    """(id, y, columns) of the chosen documents, one row per id; ``chosen`` is a bounded sample and is broadcast."""
    own, y = free(docs, "__id", "__y")
    picked = F.broadcast(chosen.select(F.col("id").alias(own), F.col("y").alias(y)))
    rows = docs.join(picked, F.col(id) == F.col(own)).select(F.col(own).alias("id"), F.col(y).alias("y"), *columns)
    return rows.dropDuplicates(["id"])
