"""Personal data in text, quasi-identifiers, tokens and erasure."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from caselight.operators.relations import cascade_delete
from caselight.schemas import CITY_REGIONS, HOSPITAL_TIERS, K_ANONYMITY_THRESHOLD

# Forms of personal data, in masking order.
PII_PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "AADHAAR": r"\b\d{4}[ -]\d{4}[ -]\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "DATE": r"\b(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})\b",
    "PAN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "PHONE": r"(?:\+\d{1,3}[- ]?)?\b\d{5}[- ]?\d{5}\b",
    "PERSON": r"(?:Patient Name|Reporter Name|Name):[ \t]*([A-Z][A-Za-z.]*(?:[ \t]+[A-Z][A-Za-z.]*)*)",
    "ADDRESS": r"(?:Address):[ \t]*([^\n]+)",
}
GROUPED = {"PERSON", "ADDRESS"}


def _matches(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(PII_PATTERNS[kind]), F.lit(1 if kind in GROUPED else 0))


def count_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of hits per kind as columns, over the whole text."""
    counts = {f"n_{k.lower()}": F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)) for k, p in PII_PATTERNS.items()}
    out = df.withColumns(counts)
    return out.withColumn("n_pii", sum((F.col(c) for c in counts), F.lit(0)))


def mask_pii(text: Column, kinds: list[str] | None = None) -> Column:
    """Replace every hit: dates by ``[DATE-REMOVED]``, all else by ``[PII-REMOVED]``."""
    out = text
    for kind in kinds or PII_PATTERNS:
        pattern, mark = PII_PATTERNS[kind], "[DATE-REMOVED]" if kind == "DATE" else "[PII-REMOVED]"
        if kind in GROUPED:
            lead = pattern[: pattern.index("(", 3)]
            out = F.regexp_replace(out, f"({lead}){pattern[len(lead):]}", f"$1{mark}")
        else:
            out = F.regexp_replace(out, pattern, mark)
    return out


def pseudonymize(text: Column, kinds: list[str] | None = None) -> Column:
    """Replace each hit by a numbered tag such as ``[EMAIL_1]``; equal values share a number, in order of appearance.

    Numbering is per text and row-local. A hit is replaced where it stands: the text is split at the hits, and what
    lies between them, earlier tags included, stays as it is. Where a pattern has a group, only the group is
    replaced, which ends the hit.
    """
    def numbered(out: Column, kind: str) -> Column:
        whole = F.regexp_extract_all(out, F.lit(PII_PATTERNS[kind]), F.lit(0))
        return F.when(F.size(whole) > 0, tagged(out, kind, whole)).otherwise(out)

    def tagged(out: Column, kind: str, whole: Column) -> Column:
        values = _matches(out, kind)
        hits = F.arrays_zip(F.split(out, PII_PATTERNS[kind], -1).alias("gap"), whole.alias("whole"), values.alias("value"))

        def piece(bound: Column) -> Column:
            return F.transform(bound["hits"], lambda s: F.concat(
                s["gap"],
                F.when(s["whole"].isNotNull(), F.concat(
                    F.lit("") if kind not in GROUPED else F.substring(s["whole"], F.lit(1), F.length(s["whole"]) - F.length(s["value"])),
                    F.lit(f"[{kind}_"), F.array_position(bound["distinct"], s["value"]).cast("string"), F.lit("]"),
                )).otherwise(F.lit("")),
            ))

        bound = F.array(F.struct(hits.alias("hits"), F.array_distinct(values).alias("distinct")))
        return F.array_join(F.get(F.transform(bound, piece), 0), "")

    # One kind after the other; a one-element array holds each intermediate text, computed once.
    step = F.array(text)
    for kind in kinds or PII_PATTERNS:
        step = _each(step, numbered, kind)
    return F.get(step, 0)


def _each(texts: Column, rule, kind: str) -> Column:
    def apply(x: Column) -> Column:
        return rule(x, kind)

    return F.transform(texts, apply)


def anonymize(df: DataFrame, text: str = "text") -> DataFrame:
    """Original, anonymised text, and whether nothing detectable is left."""
    out = df.withColumn("anonymized", mask_pii(F.col(text)))
    clean = F.lit(True)
    for kind, pattern in PII_PATTERNS.items():
        if kind not in GROUPED:
            clean = clean & ~F.col("anonymized").rlike(pattern)
    return out.withColumn("safe_for_regulatory_review", F.coalesce(clean, F.lit(True)))


def anonymize_fields(df: DataFrame, names: list[str], dates: list[str]) -> DataFrame:
    """Mask whole columns of a record table."""
    def masked(c: str, mark: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.lit(mark))

    return df.withColumns(
        {c: masked(c, "[PII-REMOVED]") for c in names} | {c: masked(c, "[DATE-REMOVED]") for c in dates}
    )


def age_band(age: Column, width: int = 10) -> Column:
    low = (F.floor(age / width) * width).cast("int")
    return F.concat_ws("-", low.cast("string"), (low + width - 1).cast("string"))


def _lookup(c: Column, mapping: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in mapping.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def generalize(df: DataFrame, age: str | None = None, city: str | None = None, hospital: str | None = None) -> DataFrame:
    """Age bands, regions and hospital tiers in place of exact values."""
    out = {}
    if age:
        out["age_band"] = age_band(F.col(age))
    if city:
        out["region"] = _lookup(F.col(city), CITY_REGIONS, "India")
    if hospital:
        out["hospital_tier"] = _lookup(F.col(hospital), HOSPITAL_TIERS, "Other")
    return df.withColumns(out)


def equivalence_classes(df: DataFrame, quasi: list[str]) -> DataFrame:
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("class_size"))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null; the right side's keys are dropped."""
    renamed = {k: f"_key{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(renamed)
    on = [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    return left.join(other, on, "left").drop(*renamed.values())


def k_anonymity(df: DataFrame, quasi: list[str], k: int = K_ANONYMITY_THRESHOLD) -> DataFrame:
    """One row: number of classes, smallest class, classes and rows below k, PASS or FAIL."""
    sizes = equivalence_classes(df, quasi)
    small = F.col("class_size") < k
    return sizes.agg(
        F.count(F.lit(1)).alias("classes"),
        F.min("class_size").alias("k_value"),
        F.count_if(small).alias("classes_below_k"),
        F.coalesce(F.sum(F.when(small, F.col("class_size"))), F.lit(0)).alias("rows_below_k"),
    ).withColumn("status", F.when(F.coalesce(F.col("k_value") >= k, F.lit(True)), "PASS").otherwise("FAIL"))


def suppress_small_classes(df: DataFrame, quasi: list[str], k: int = K_ANONYMITY_THRESHOLD) -> DataFrame:
    """Blank the quasi-identifiers of rows in classes below k.

    Class sizes are counted with map-side combining and joined back, so a class holding a large
    share of the rows is not gathered in one task. Nulls in quasi-identifiers match nulls.
    """
    joined = _join_null_safe(df, equivalence_classes(df, quasi), quasi)
    keep = F.col("class_size") >= k
    return joined.withColumns({q: F.when(keep, F.col(q)) for q in quasi}).withColumn("suppressed", ~keep)


def l_diversity(df: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """Distinct sensitive values per class."""
    pairs = df.groupBy(*quasi, sensitive).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*quasi).agg(
        F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("l_value")
    )


def t_closeness(df: DataFrame, quasi: list[str], sensitive: str) -> DataFrame:
    """Per class the largest possible probability gap to the whole table (total variation).

    A value missing from a class still counts: the distance is half the summed gaps over the
    class's own values plus half the global share of the values it lacks.
    """
    pairs = df.groupBy(*quasi, sensitive).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    shares = pairs.groupBy(sensitive).agg((F.sum("n") / total).alias("_share"))
    sizes = pairs.groupBy(*quasi).agg(F.sum("n").alias("_size"))
    joined = _join_null_safe(_join_null_safe(pairs, sizes, quasi), shares, [sensitive])
    gap = F.abs(F.col("n") / F.col("_size") - F.col("_share"))
    return joined.groupBy(*quasi).agg(
        F.max("_size").alias("class_size"), ((F.sum(gap) + (1 - F.sum("_share"))) / 2).alias("t_value")
    )


def tokenize(df: DataFrame, column: str, category: str, salt: str, encryption_key: Column | None = None, key: str = "submission_id") -> DataFrame:
    """Token table: a keyed hash per value; the value itself only encrypted, with the caller's key."""
    value = F.col(column)
    token = F.concat(F.lit("TOK_"), F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 32))
    out = df.filter(value.isNotNull()).select(key, token.alias("token"), value.alias("_v"), F.lit(category).alias("category"))
    out = out.dropDuplicates([key, "token"])
    secret = F.lit(None).cast("string") if encryption_key is None else F.base64(F.aes_encrypt("_v", encryption_key))
    return out.withColumn("encrypted_value", secret).drop("_v")


def reveal(tokens: DataFrame, encryption_key: Column) -> DataFrame:
    """Values behind tokens that were not purged."""
    plain = F.try_aes_decrypt(F.unbase64("encrypted_value"), encryption_key).cast("string")
    return tokens.withColumn("value", plain)


def purge_tokens(tokens: DataFrame, deleted: DataFrame, reason: str, at: dt.datetime, key: str = "submission_id") -> DataFrame:
    """Null the values of the given submissions and record why; the token rows stay."""
    hit = deleted.select(F.col("id").alias(key)).distinct().withColumn("_hit", F.lit(True))
    out = tokens.join(hit, key, "left")
    gone = F.col("_hit").isNotNull()
    return out.withColumns(
        {
            "encrypted_value": F.when(~gone, F.col("encrypted_value")),
            "purged_at": F.when(gone, F.lit(at)),
            "purge_reason": F.when(gone, F.lit(reason)),
        }
    ).drop("_hit")


def erase(tables: dict[str, DataFrame], deleted: DataFrame, key: str = "submission_id") -> dict[str, DataFrame]:
    """Every child table without the rows of the erased submissions."""
    return {name: cascade_delete(df, deleted, key) for name, df in tables.items()}
