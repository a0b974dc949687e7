"""String similarity: edit similarity as built-ins, and, where a caller asks for it, the matching-blocks ratio as an Arrow UDF."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

#: Slack of a bound on edits, as thresholds are no exact binary numbers.
EPS = 1e-9

def matching_ratio(a: str | None, b: str | None) -> float:
    """2M/T over matching blocks; 0 when either text is empty. Not symmetric."""
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two normalised texts, in the given order."""
    return pd.Series([matching_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def round3(x: pd.Series) -> pd.Series:
    """Three decimals, half to even on the binary value."""
    return x.map(lambda v: round(v, 3))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, all inside the JVM."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == b) & (a != ""), F.lit(1.0)).when(
        (a != "") & (b != ""), F.lit(1.0) - F.levenshtein(a, b) / F.nullif(longer, F.lit(0))
    ).otherwise(F.lit(0.0))


def match_confidence(score: Column) -> Column:
    return F.when(score > 0.95, "HIGH").when(score > 0.80, "MEDIUM").otherwise("LOW")


def match_reason(score: Column) -> Column:
    return (
        F.when(score > 0.98, "Near-identical strings")
        .when(score > 0.90, "Minor spelling/formatting differences")
        .when(score > 0.80, "Likely same drug with major variations")
        .otherwise(F.concat(F.lit("Possible match (similarity: "), F.format_string("%.1f", score * 100), F.lit("%)")))
    )
