"""Queries over text quality and labelled extraction."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from caselight.functions import quality as Q
from caselight.functions import text as T
from caselight.operators import extract as X
from caselight.plans.catalog_core import trimmed
from caselight.plans.registry import CATALOG
from caselight.schemas import (
    CASE_LABELS,
    CASE_RULES,
    DRUG_LABELS,
    MONTH_NAME,
    NUMERIC_DATE,
    ONSET_LABELS,
    REACTION_LABELS,
    REPORT_DATE_LABELS,
    REPORT_FIELDS,
    REPORTER_LABELS,
    VALUE_FORMATS,
)

add = CATALOG.add

_CONTROL = "length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'))"
_JUNK = (
    f"coalesce(length({trimmed('text')}) < 10 OR regexp_matches(text, '(?i)^(%PDF|\\x00{{4,}}|\\x{{ff}}\\x{{d8}}\\x{{ff}}|\\x{{89}}PNG)') "
    f"OR {trimmed('text')} LIKE '\\%PDF%' ESCAPE '\\' OR ({_CONTROL}) * 5 > length(text), TRUE)"
)


@add("x1_binary_junk", [], f"""
SELECT doc_id, {_JUNK} AS junk FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '%pdf-1.7 ' || text WHEN doc_id % 13 = 0 THEN source
  WHEN doc_id % 17 = 0 THEN repeat(chr(2), CAST(floor(n_chars / 3) AS INT)) || text ELSE text END AS text FROM documents)""")
def _(t):
    marked = (
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("%pdf-1.7 "), "text"))
        .when(F.col("doc_id") % 13 == 0, F.col("source"))
        .when(F.col("doc_id") % 17 == 0, F.concat(F.expr("repeat(char(2), CAST(floor(n_chars / 3) AS INT))"), "text"))
        .otherwise(F.col("text"))
    )
    return t.dealt("documents").select("doc_id", marked.alias("text")).select("doc_id", Q.is_binary_junk(F.col("text")).alias("junk"))


# White space as a byte-oriented regex class cannot express all of it, the classes are spelled out.
_SPACE = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_PRINT = "regexp_replace(text, '[^\\x20-\\x7E\\n\\r\\x{80}-\\x{FFFF}]', '', 'g')"
_SQUEEZED = trimmed(f"regexp_replace({_PRINT}, '{_SPACE}{{3,}}', '  ', 'g')")
_GOOD = f"length(l) - length(regexp_replace(l, '[\\p{{L}}\\p{{N}}]|{_SPACE}', '', 'g'))"
_CLEAN = f"array_to_string(list_filter(string_split({_SQUEEZED}, chr(10)), lambda l: l = '' OR ({_GOOD}) * 2 > length(l)), chr(10))"


@add("x2_clean_documents", [], f"SELECT doc_id, length({_CLEAN}) AS size, md5({_CLEAN}) AS clean_md5 FROM documents")
def _(t):
    clean = t.dealt("documents").select("doc_id", Q.clean_text(F.col("text")).alias("c"))
    return clean.select("doc_id", F.length("c").cast("bigint").alias("size"), F.md5("c").alias("clean_md5"))


@add("x2_clean_pages", [], f"SELECT page_id, md5({_CLEAN}) AS clean_md5 FROM (SELECT page_id, html AS text FROM pages)")
def _(t):
    return t.table("pages").select("page_id", F.md5(Q.clean_text(F.col("html"))).alias("clean_md5"))


_SIZE = f"length({trimmed('text')})"


@add("x3_extraction_check", [], f"""
SELECT doc_id, CASE WHEN {_SIZE} < 100 THEN 'low' WHEN {_SIZE} < 500 THEN 'medium' ELSE 'unknown' END AS quality,
  concat_ws('|', CASE WHEN {_SIZE} < 100 THEN 'Very short extraction (' || {_SIZE} || ' chars)' WHEN {_SIZE} < 500 THEN 'Short extraction (' || {_SIZE} || ' chars)' END,
    CASE WHEN {_SIZE} > 0 AND doc_id % 10 < 5 THEN 'Low page extraction rate (' || (doc_id % 10) * 10 || '%)' END) AS warnings FROM documents""")
def _(t):
    pages, total = F.col("doc_id") % 10, F.lit(10)
    return t.dealt("documents").select(
        "doc_id", Q.checked_quality(F.col("text"), F.lit("unknown")).alias("quality"),
        F.array_join(Q.extraction_warnings(F.col("text"), pages, total), "|").alias("warnings"),
    )


@add("x4_quality_rating", [], f"""
SELECT doc_id, CASE WHEN doc_id % 23 = 0 OR {_SIZE} < 100 THEN 'low' WHEN doc_id % 11 = 10 AND doc_id % 21 / 20.0 > 0.85 THEN 'high'
  WHEN doc_id % 11 >= 8 OR doc_id % 21 / 20.0 > 0.7 THEN 'medium' ELSE 'low' END AS quality FROM documents""")
def _(t):
    key = F.col("doc_id")
    error = F.when(key % 23 == 0, "unreadable")
    rate = Q.rate_quality(F.col("text"), key % 11, F.lit(10), key % 21 / F.lit(20.0), error)
    return t.dealt("documents").select("doc_id", rate.alias("quality"))


_T = "nullif(length(text), 0)"
_AL = f"((length(text) - length(regexp_replace(text, '[\\p{{L}}\\p{{N}}]', '', 'g'))) / {_T})"
_SP = f"((length(text) - length(regexp_replace(text, '{_SPACE}', '', 'g'))) / {_T})"
_PU = f"((length(text) - length(regexp_replace(text, '[-.,;:!?()\\[\\]{{}}]', '', 'g'))) / {_T})"


@add("x5_text_confidence", [], f"""
SELECT doc_id, (CASE WHEN {_AL} > 0.5 AND {_AL} < 0.8 THEN 4 WHEN {_AL} > 0.4 AND {_AL} < 0.9 THEN 3 ELSE 1 END
  + CASE WHEN {_SP} > 0.15 AND {_SP} < 0.35 THEN 3 WHEN {_SP} > 0.1 AND {_SP} < 0.4 THEN 2 ELSE 1 END
  + CASE WHEN {_PU} > 0.01 AND {_PU} < 0.2 THEN 3 ELSE 1 END) / 10 AS confidence FROM documents""")
def _(t):
    return t.dealt("documents").select("doc_id", Q.text_confidence(F.col("text")).alias("confidence"))


@add("x6_page_rollup", ["doc_pages"], f"""
WITH p AS (SELECT *, NOT {_JUNK} AS ok FROM doc_pages)
SELECT doc_id, count(*) FILTER (ok) AS pages_extracted, count(*) AS total_pages, count(*) FILTER (ok) / count(*) AS confidence,
  md5(coalesce(string_agg(text || chr(10), '' ORDER BY page_no, text) FILTER (ok), '')) AS text_md5,
  coalesce(round(avg(ocr_confidence) FILTER (ocr_confidence > 0) / 100, 9), 0) AS ocr_confidence FROM p GROUP BY doc_id""")
def _(t):
    out = X.roll_up_pages(t.view("doc_pages"), ocr="ocr_confidence")
    return out.select(
        "doc_id", "pages_extracted", "total_pages", "confidence", F.md5("text").alias("text_md5"),
        F.coalesce(F.round("ocr_confidence", 9), F.lit(0.0)).alias("ocr_confidence"),
    )


@add("x7_extraction_chain", ["text_candidates"], f"""
WITH best AS (SELECT doc_id, min(method_rank) AS method_rank FROM text_candidates WHERE {_SIZE} >= 100 GROUP BY 1),
c AS (SELECT d.doc_id, b.method_rank, {_CLEAN} AS clean FROM (SELECT DISTINCT doc_id FROM text_candidates) d LEFT JOIN best b USING (doc_id)
  LEFT JOIN text_candidates t ON t.doc_id = b.doc_id AND t.method_rank = b.method_rank),
q AS (SELECT *, CASE WHEN method_rank IS NULL OR length({trimmed("clean")}) < 100 THEN 'low' WHEN method_rank = 3 AND length({trimmed("clean")}) < 500 THEN 'medium'
  WHEN method_rank = 1 THEN 'high' WHEN method_rank = 2 THEN 'medium' ELSE 'unknown' END AS quality FROM c)
SELECT doc_id, coalesce(method_rank, 0) AS method_rank, quality, md5(CASE WHEN quality = 'low' THEN '' ELSE clean END) AS text_md5,
  CASE WHEN method_rank IS NULL THEN 'No text extracted from document' WHEN quality = 'low' THEN 'Extraction quality too low - document may be corrupted or unreadable' ELSE '' END AS error FROM q""")
def _(t):
    rated = F.when(F.col("method_rank") == 1, "high").when(F.col("method_rank") == 2, "medium").otherwise("unknown")
    out = X.checked_extraction(t.view("text_candidates").withColumn("quality", rated))
    return out.select("doc_id", F.coalesce("method_rank", F.lit(0)).alias("method_rank"), "quality", F.md5("text").alias("text_md5"), F.coalesce("error", F.lit("")).alias("error"))


@add("x8_tables_as_text", [], """
SELECT o_orderkey, 'Field | Value' || chr(10) || '--- | ---' || chr(10) || 'Status | ' || o_orderstatus || chr(10) || 'Priority | ' ||
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority || ' x' END AS text FROM orders""")
def _(t):
    value = F.when(F.col("o_orderkey") % 5 != 0, F.concat("o_orderpriority", F.lit("\nx ")))
    cells = F.array(
        F.array(F.lit("Field"), F.lit(" Value ")), F.array(F.lit("Status"), F.col("o_orderstatus")), F.array(F.lit("Priority"), value)
    )
    return t.table("orders").select("o_orderkey", Q.standardize_table(cells).alias("text"))


# ---------------------------------------------------------------- labelled fields

def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _literal(label: str) -> str:
    return re.escape(label).replace("\\ ", " ")


def _value_sql(layout: str) -> str:
    raw = f"trim(regexp_extract(text, '(?im){_quoted(layout)}', 1), chr(32) || chr(9) || chr(10) || chr(13))"
    return f"trim(regexp_replace({raw}, '\\s+(and|or|a|the|with)\\s+[A-Z][a-z]+\\s*:', ' ', 'g'))"


def _layouts(label: str) -> list[str]:
    name = _literal(label)
    return [_value_sql(f"{name}{tail}") for tail in (r"\s*[:=]\s*([^\n]+)", r"\s*\n\s*([^\n]+)", r"\s*-\s*([^\n]+)")]


def field_sql(labels: list[str], kind: str | None) -> str:
    """Value of a labelled field, null when there is none."""
    if kind is None:
        values = ", ".join(v for label in labels for v in _layouts(label))
        return f"substr(list_filter([{values}], lambda v: length(v) >= 2)[1], 1, 500)"
    fmt = _quoted(VALUE_FORMATS[kind])
    cands = ", ".join(
        f"{{'l': {i}, 'v': {v}}}" for i, label in enumerate(labels) for v in _layouts(label)
    )
    typed = f"""list_transform(list_filter([{cands}], lambda s: length(s.v) >= 2),
      lambda s: {{'l': s.l, 'hit': regexp_matches(s.v, '{fmt}'), 'v': trim(regexp_extract(s.v, '{fmt}', 0))}})"""
    real = f"list_filter({typed}, lambda s: NOT s.hit OR s.v <> '')"
    # Fold: the state is the label closed by a first miss and the value found.
    return f"""nullif(list_reduce(list_prepend({{'l': -1, 'hit': FALSE, 'v': ''}}, {real}),
      lambda a, s: CASE WHEN a.hit THEN a WHEN s.hit AND s.l <> a.l THEN s WHEN a.l = -1 THEN {{'l': s.l, 'hit': FALSE, 'v': ''}} ELSE a END).v, '')"""


_DRUG = f"""coalesce({field_sql(DRUG_LABELS, None)}, nullif(regexp_extract(text, '\\b(Drug-[A-Z0-9]+|[A-Z][a-z]+(\\s+[A-Z][a-z]+)*)\\b', 1), ''))"""


def _reaction_sql() -> str:
    # Ending at a line end covers the ending before a listed word, both stop at the first line end.
    out = []
    for label in REACTION_LABELS:
        out.append(f"trim(regexp_extract(text, '(?i){_literal(label)}\\s*:?\\s*([^\\n]+)', 1))")
    return f"list_filter([{', '.join(out)}], lambda v: length(v) >= 5 AND NOT regexp_matches(v, '^\\d{{4}}[-/]\\d{{2}}'))[1]"


def _reporter_sql() -> str:
    title, name = "Dr|Mr|Ms|Prof|Mrs", r"[A-Za-z\s.]+?"
    rx = [
        rf"(?:Reporter|Submitted|Contact|Investigator).*?:\s*((?:{title})\.\s+{name})(?:\n|,|$)",
        rf"(?:{title})\.\s+({name})(?:\n|,|$)",
        rf"Reporter\s*:\s*({name})(?:\n|$)",
        rf"Submitted\s+By\s*:\s*({name})(?:\n|$)",
        rf"(?:{title})\s+({name})(?:\n|$)",
    ]
    cands = ", ".join(f"trim(regexp_extract(text, '(?i){_quoted(r)}', 1), ' ' || chr(10))" for r in rx)
    return f"""coalesce({field_sql(REPORTER_LABELS, None)}, list_filter([{cands}], lambda v: length(v) BETWEEN 3 AND 99 AND lower(v) NOT IN ('dr', 'mr', 'ms', 'prof', 'mrs'))[1])"""


def _date_sql(labels: list[str], before: str, after: str, last: bool) -> str:
    rx = [
        rf"(?:{before}).*?(\d{{1,2}}\s+{MONTH_NAME}\s+\d{{4}})",
        rf"(?:{before}).*?({MONTH_NAME}\s+\d{{1,2}},?\s+\d{{4}})",
        rf"(?:{before})\D{{0,20}}({NUMERIC_DATE})",
        rf"({NUMERIC_DATE})\D{{0,30}}(?:{after})",
    ]
    near = ", ".join(f"regexp_extract(text, '(?i){_quoted(r)}', 1)" for r in rx)
    dates = f"regexp_extract_all(text, '{NUMERIC_DATE}')"
    return f"coalesce({field_sql(labels, 'date')}, list_filter([{near}], lambda v: v <> '')[1], {dates}[{-1 if last else 1}])"


_SPECIAL = {
    "drug_name": _DRUG,
    "adverse_reaction": _reaction_sql(),
    "onset_date": _date_sql(ONSET_LABELS, "Onset|Reaction|Symptom|Adverse", "onset|reaction|symptom|adverse", False),
    "reporter_name": _reporter_sql(),
    "report_date": _date_sql(REPORT_DATE_LABELS, "Report|Submitted|Filed", "report|submit|filed", True),
}


def _report_column(name: str) -> str:
    sql = _SPECIAL[name] if name in _SPECIAL else field_sql(*REPORT_FIELDS[name])
    return f"CASE WHEN length(trim(text)) >= 100 THEN {sql} END AS {name}"


@add("x10_parse_reports", ["reports"], "SELECT doc_id, " + ", ".join(_report_column(n) for n in REPORT_FIELDS) + " FROM reports")
def _(t):
    return X.parse_reports(t.view("reports", wide=True)).drop("text")


@add("x9_labelled_fields", ["reports"], f"""
SELECT doc_id, {field_sql(["Expiration Date", "Expiry Date", "Exp Date"], "date")} AS expiration_date, {field_sql(["Patient Age", "Age"], "age")} AS patient_age,
  {field_sql(["Route", "Route of Administration"], None)} AS route FROM reports""")
def _(t):
    return X.with_labels(t.view("reports", wide=True)).select(
        "doc_id", X.labelled_field(["Expiration Date", "Expiry Date", "Exp Date"], "date").alias("expiration_date"),
        X.labelled_field(["Patient Age", "Age"], "age").alias("patient_age"),
        X.labelled_field(["Route", "Route of Administration"]).alias("route"),
    )


def _one(name: str, column: str, build):
    @add(name, ["reports"], f"SELECT doc_id, {_SPECIAL[column]} AS {column} FROM reports")
    def _(t):
        return X.with_labels(t.view("reports", wide=True)).select("doc_id", build("text", "_lowered").alias(column))


_one("x11_drug_names", "drug_name", X.drug_name)
_one("x12_adverse_reactions", "adverse_reaction", X.adverse_reaction)
_one("x13_reporter_names", "reporter_name", X.reporter_name)
_one("x14_onset_dates", "onset_date", X.onset_date)
_one("x14_report_dates", "report_date", X.report_date)


_MARK = "(?i)((Case\\s+ID|Case)\\s*:?\\s*([A-Z0-9-]+))"
_BLOCKS = f"""docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM line_listings),
blocks AS (SELECT rid, doc_id, generate_subscripts(b, 1) - 1 AS pos, unnest(b) AS block FROM (
  SELECT rid, doc_id, string_split(regexp_replace(text, '{_MARK}', chr(1) || '\\1', 'g'), chr(1))[2:] AS b FROM docs WHERE length(trim(text)) >= 100))"""


@add("x15_split_cases", ["line_listings"], f"WITH {_BLOCKS} SELECT doc_id, pos::INT AS pos, regexp_extract(block, '{_MARK}', 3) AS marker_id, md5(block) AS block_md5 FROM blocks")
def _(t):
    return X.split_cases(t.view("line_listings", wide=True)).select("doc_id", "pos", "marker_id", F.md5("block").alias("block_md5"))


_LABEL_RULES = " ".join(f"WHEN contains(name, '{label}') THEN '{target}'" for label, target in CASE_LABELS)
_PRESENT = " + ".join(
    f"coalesce({n} <> '', FALSE)::INT" if n != "dechallenge_performed" else f"coalesce({n}, FALSE)::INT" for n in CASE_RULES
)
PARSED_CASES = f"""{_BLOCKS},
lines AS (SELECT rid, pos, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT rid, pos, string_split(block, chr(10)) AS ls FROM blocks)),
pairs AS (SELECT rid, pos, i, CASE {_LABEL_RULES} END AS field, value FROM (
  SELECT rid, pos, i, lower(trim(split_part(line, ':', 1))) AS name, trim(substr(line, instr(line, ':') + 1)) AS value FROM lines WHERE contains(line, ':'))),
grouped AS (SELECT rid, pos, {", ".join(f"arg_max(value, i) FILTER (field = '{n}') AS {n}" for n in CASE_RULES)} FROM pairs GROUP BY rid, pos),
parsed AS (SELECT b.doc_id, b.pos::INT AS pos, coalesce(g.case_id, regexp_extract(b.block, '{_MARK}', 3)) AS case_id, patient_age,
  CASE WHEN patient_gender IS NULL THEN NULL WHEN lower(patient_gender) IN ('m', 'male') THEN 'M' WHEN lower(patient_gender) IN ('f', 'female') THEN 'F' ELSE 'Other' END AS patient_gender,
  adverse_event_term, event_onset_date, event_severity, outcome, drug_name, dose, lower(dechallenge_performed) IN ('yes', 'true', 'y') AS dechallenge_performed, report_date
  FROM blocks b LEFT JOIN grouped g ON b.rid = g.rid AND b.pos = g.pos),
kept AS (SELECT * FROM parsed WHERE {_PRESENT} >= 8)"""


@add("x16_parse_cases", ["line_listings"], f"WITH {PARSED_CASES} SELECT * FROM kept")
def _(t):
    return X.parse_cases(t.view("line_listings", wide=True))


@add("x17_postal_codes", ["addresses"], """
SELECT pos, array_to_string(regexp_extract_all(address, '\\b([0-9]{5,6})\\b', 1), ',') AS codes FROM addresses WHERE address IS NOT NULL""")
def _(t):
    rows = t.view("addresses").filter(F.col("address").isNotNull())
    return rows.select("pos", F.array_join(T.postal_codes(F.col("address")), ",").alias("codes"))


@add("x17_document_codes", [], """
SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b([0-9]{5,6})\\b', 1), ',') AS codes FROM documents""")
def _(t):
    return t.dealt("documents").select("doc_id", F.array_join(T.postal_codes(F.col("text")), ",").alias("codes"))
