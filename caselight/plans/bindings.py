"""Views that bind the operators to the shared tables.

The shared tables hold no safety reports, so each view derives one from whole tables by
deterministic expressions, with blanks, bad values and mixed layouts planted so that every rule
fires. A view is one SQL text that Spark and the oracle engine both run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselight.streaming.intake import table_stream

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


PARTS = "spark.caselight.tables.parts"
#: HotSpot compiles no method of more than 8,000 bytes. The wide projections of the views and checks exceed that as one method; below this
#: limit Spark cuts them into small ones. A session's own value stays.
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def _pick(values: str, index: str) -> str:
    n = values.count(",") + 1
    return f"split_part('{values}', ',', CAST(({index}) % {n} AS INT) + 1)"


_EVENTS = "Headache,Nausea,Severe rash,Dizziness,Hypotension,Neutropenia,Fever,Vomiting,Abdominal pain,Seizure,Anaemia"
_SYL = "ba,ke,li,mo,nu,ra,se,ti,vo,zu,cha,dre,fli,gro,shu,pla,sten,trim,quor,wex"


def _made(count: int, *steps: int) -> str:
    """Invented names: name i joins every step-th syllable counted from i."""
    syllables = _SYL.split(",")
    return ",".join("".join(syllables[(i * s + s) % len(syllables)] for s in steps).capitalize() for i in range(count))


_FIRST, _LAST = _made(17, 1, 7), _made(19, 3, 11, 9)
_ISO = "CAST(CAST({d} AS DATE) + CAST({n} AS INT) AS STRING)"


def _iso(d: str, n: str) -> str:
    return _ISO.format(d=d, n=n)


def _dmy(d: str, n: str, sep: str) -> str:
    iso = _iso(d, n)
    return f"concat(substr({iso}, 9, 2), '{sep}', substr({iso}, 6, 2), '{sep}', substr({iso}, 1, 4))"


_KEY = (
    "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', "
    "CAST(l_suppkey AS STRING), '-', CAST(CAST(l_quantity AS INT) AS STRING))"
)
# A number per line item that spreads over its keys.
_H = "(l_orderkey * 7 + l_partkey * 3 + l_linenumber * 5 + l_suppkey)"

VIEWS: dict[str, tuple[list[str], str]] = {}

VIEWS["submissions"] = (
    ["orders"],
    f"""
SELECT CAST(o_orderkey AS STRING) AS id,
  CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('report_', CAST(o_orderkey AS STRING), '.pdf') END AS filename,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN '' ELSE o_orderpriority END AS submission_type,
  CASE WHEN o_orderkey % 11 = 0 THEN 'approved' WHEN o_orderkey % 13 = 0 THEN 'validating_form'
       WHEN o_orderkey % 19 = 0 THEN 'processing' WHEN o_orderkey % 31 = 0 THEN 'PASSED'
       WHEN o_orderkey % 37 = 0 THEN NULL
       WHEN o_orderstatus = 'P' THEN 'uploaded' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status,
  CAST(o_custkey AS STRING) AS submitted_by,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 14 = 13 THEN NULL WHEN o_orderkey % 14 = 12 THEN ''
       ELSE {_pick("Mild,Moderate,Severe,Life-threatening,Fatal,mild,Mild", "o_orderkey")} END AS severity,
  CASE WHEN o_custkey % 15 = 14 THEN NULL
       ELSE {_pick("Recovered,Recovering,Not Recovered,Unknown,Fatal,Resolved", "o_custkey + o_orderkey")} END AS outcome,
  CASE WHEN o_orderkey % 9 = 8 THEN NULL WHEN o_orderkey % 10 = 9 THEN '  '
       WHEN o_orderkey % 3 = 0 THEN concat(' ', {_pick(_EVENTS, "o_custkey * o_custkey")}, ' ')
       ELSE {_pick(_EVENTS, "o_custkey + o_orderkey")} END AS adverse_event,
  CASE WHEN o_orderkey % 12 = 11 THEN '' ELSE concat('Drug-', CAST((o_custkey * o_custkey) % 41 AS STRING)) END AS drug_name
FROM {{orders}}""",
)

VIEWS["results"] = (
    ["events"],
    """
SELECT CAST(event_id AS STRING) AS id,
  CAST(user_id * 20 + event_id % 20 AS STRING) AS submission_id,
  CASE WHEN value > 120 THEN 'Naranjo Causality Scoring' WHEN event_type = 'view' THEN 'Duplicate Detection'
       WHEN event_type = 'click' THEN 'Consistency Check' WHEN event_type = 'signup' THEN 'ADR Validation'
       WHEN event_type = 'purchase' THEN 'Form 44 Validation' ELSE 'MD-14 Validation' END AS check_type,
  CASE WHEN event_id % 41 = 0 THEN 'raw text' WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN '{{"severity": "Mi'
       ELSE concat('{{"completeness": ', CASE WHEN event_id % 4 = 0 THEN '83.3' WHEN event_id % 4 = 1 THEN '100.0' WHEN event_id % 4 = 2 THEN '66.7' ELSE '0' END,
         CASE WHEN event_id % 3 = 0 THEN ', "critical_issues": ["Mandatory field missing: drug_name", "patient_age must be a number"]'
              WHEN event_id % 3 = 1 THEN ', "critical_issues": ["Mandatory field missing: report_date"]' ELSE '' END,
         CASE WHEN event_id % 5 = 0 THEN ', "missing_fields": ["drug_code", "drug_name", "precautions"]' ELSE '' END,
         CASE WHEN event_id % 7 = 0 THEN ', "severity": "Severe"' WHEN event_id % 7 < 3 THEN ', "severity": "Mild"' ELSE '' END,
         CASE WHEN event_id % 6 = 0 THEN ', "outcome": "Recovered"' ELSE '' END,
         CASE WHEN event_id % 8 = 0 THEN ', "reason": "not applicable"' ELSE '' END,
         ', "duplicates_found": ', CAST(event_id % 9 AS STRING), ', "causality_score": 7', '}}') END AS result,
  CASE WHEN value < 25 THEN 'PASS' WHEN value < 60 THEN 'FAIL' WHEN value < 90 THEN 'SKIPPED'
       WHEN value < 110 THEN 'ERROR' WHEN value < 130 THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS status,
  ts AS created_at,
  event_id AS pos
FROM {events}""",
)

VIEWS["audit"] = (
    ["events"],
    """
SELECT concat('a', CAST(event_id AS STRING)) AS id,
  CASE WHEN event_type = 'view' THEN 'ANONYMIZE' WHEN event_type = 'click' THEN 'SCORE'
       WHEN event_type = 'signup' THEN 'DELETE' WHEN event_type = 'purchase' THEN 'EXPORT' ELSE 'PROCESS' END AS operation,
  CAST(user_id AS STRING) AS user_id, concat('submission/', CAST(user_id AS STRING)) AS resource,
  props AS details, ts AS timestamp
FROM {events}""",
)

VIEWS["anonymized"] = (
    ["orders"],
    """
SELECT concat('n', CAST(o_orderkey AS STRING)) AS id, CAST(o_orderkey AS STRING) AS submission_id,
  CASE WHEN o_custkey % 6 = 0 THEN 'FAIL' ELSE 'PASS' END AS k_anonymity_status,
  CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey % 101 AS DOUBLE) END AS compliance_score
FROM {orders}""",
)

VIEWS["compliance"] = (
    ["orders"],
    """
SELECT concat('c', CAST(o_orderkey AS STRING)) AS id, CAST(o_orderkey AS STRING) AS submission_id,
  CAST(o_custkey % 101 AS DOUBLE) AS dpdp_score, CAST(o_custkey % 97 AS DOUBLE) AS ndhm_score,
  CAST(o_orderkey % 89 AS DOUBLE) AS icmr_score, CAST(o_orderkey % 83 AS DOUBLE) AS cdsco_score,
  CAST((o_custkey + o_orderkey) % 101 AS DOUBLE) AS overall_compliance_score,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 101 < 40 THEN 'HIGH' ELSE 'LOW' END AS risk_level
FROM {orders}""",
)

VIEWS["sae_cases"] = (
    ["lineitem", "part"],
    f"""
SELECT {_KEY} AS id, CAST(l_orderkey AS STRING) AS submission_id, concat('CASE-', CAST(l_linenumber AS STRING)) AS case_id,
  p_type AS event_term, CAST(l_linenumber % 5 + 1 AS INT) AS severity_grade, CAST(l_suppkey % 14 AS INT) AS naranjo_score,
  CAST(floor(l_extendedprice) AS INT) AS priority_score,
  CASE WHEN l_extendedprice > 50000 THEN 'HIGH' ELSE 'LOW' END AS priority_level
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
)

VIEWS["adr_forms"] = (
    ["lineitem", "part"],
    f"""
SELECT {_KEY} AS id,
  CASE WHEN {_H} % 13 = 0 THEN '' WHEN {_H} % 57 = 0 THEN 'X' WHEN {_H} % 5 = 0 THEN concat(' Value:  ', p_name) ELSE p_name END AS drug_name,
  CASE WHEN {_H} % 11 = 0 THEN NULL WHEN {_H} % 19 = 0 THEN 'Rash' WHEN {_H} % 4 = 0 THEN concat('Term: ', {_pick(_EVENTS, _H)}, '   with  pain')
       WHEN {_H} % 4 = 1 THEN concat('Response: Term: ', {_pick(_EVENTS, _H)}) ELSE concat({_pick(_EVENTS, _H)}, ' after dose') END AS adverse_reaction,
  CASE WHEN {_H} % 17 = 0 THEN 'abc' WHEN {_H} % 23 = 0 THEN '0' WHEN {_H} % 29 = 0 THEN '151' WHEN {_H} % 31 = 0 THEN ' '
       ELSE CAST(l_partkey % 90 + 1 AS STRING) END AS patient_age,
  CASE WHEN {_H} % 6 = 0 THEN {_dmy("l_shipdate", "0", "-")} WHEN {_H} % 6 = 1 THEN {_dmy("l_shipdate", "0", "/")}
       WHEN {_H} % 6 = 2 THEN substr({_iso("l_shipdate", "0")}, 3) WHEN {_H} % 6 = 3 THEN '26-13-10'
       WHEN {_H} % 6 = 4 THEN concat(' ', {_iso("l_shipdate", "0")}, ' ') ELSE '12 March 2026' END AS onset_date,
  CASE WHEN {_H} % 7 = 0 THEN 'MISSING' WHEN {_H} % 7 = 1 THEN NULL WHEN {_H} % 7 = 2 THEN 'missing' WHEN {_H} % 7 = 3 THEN '  '
       ELSE concat('Dr. ', {_pick(_FIRST, "l_suppkey")}) END AS reporter_name,
  CASE WHEN {_H} % 37 = 0 THEN NULL ELSE {_iso("l_shipdate", "5")} END AS report_date,
  CASE WHEN {_H} % 3 = 0 THEN NULL ELSE {_pick("Mild,Moderate,Severe,High", _H)} END AS severity,
  CASE WHEN {_H} % 8 = 0 THEN 'Response: Recovering' WHEN {_H} % 8 = 1 THEN '' ELSE 'Recovered' END AS outcome,
  CASE WHEN {_H} % 9 = 0 THEN NULL ELSE concat(CAST(l_linenumber AS STRING), ' days') END AS duration,
  CASE WHEN {_H} % 10 < 3 THEN NULL ELSE ' Warfarin ' END AS concomitant_medications,
  CASE WHEN {_H} % 5 = 1 THEN NULL ELSE {_pick("M,F,Other", _H)} END AS patient_gender,
  CASE WHEN {_H} % 14 = 3 THEN 'Finding: skin event' ELSE NULL END AS adverse_event_term,
  CASE WHEN {_H} % 14 = 3 THEN {_dmy("l_shipdate", "1", "-")} ELSE NULL END AS event_onset_date,
  CASE WHEN {_H} % 15 = 4 THEN 'Severe' WHEN {_H} % 15 = 5 THEN '' ELSE NULL END AS event_severity,
  {_H} % 4 = 2 AS is_batch
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
)

VIEWS["dmf_forms"] = (
    ["lineitem", "part"],
    f"""
SELECT {_KEY} AS id,
  CASE WHEN {_H} % 9 = 0 THEN 'Raj' WHEN {_H} % 31 = 0 THEN NULL ELSE concat('Dr. ', {_pick(_FIRST, "l_suppkey")}, ' ', {_pick(_LAST, "l_partkey")}) END AS applicant_name,
  CASE WHEN {_H} % 8 = 0 THEN 'Delhi' ELSE '12 Pharma Street, Delhi 110001' END AS applicant_address,
  CASE WHEN {_H} % 7 = 0 THEN '+91 98765' ELSE lpad(CAST(l_partkey AS STRING), 10, '9') END AS applicant_phone,
  CASE WHEN {_H} % 6 = 0 THEN 'not-an-email' ELSE concat('user', CAST(l_suppkey AS STRING), '@pharma.com') END AS applicant_email,
  CASE WHEN {_H} % 41 = 0 THEN '   ' ELSE p_name END AS drug_name,
  CASE WHEN {_H} % 5 = 0 THEN 'D1' ELSE concat('IDX-', CAST(l_partkey AS STRING)) END AS drug_code,
  '500mg' AS drug_strength,
  {_pick("Tablet,Capsule,tablet,Gel,Powder,Injection", _H)} AS dosage_form,
  {_pick("Oral,IV,IM,oral,Topical", _H)} AS route_of_administration,
  CASE WHEN {_H} % 3 = 0 THEN 'Mixed and pressed.' ELSE 'Granulated, dried, milled, blended, pressed and then film coated in line.' END AS manufacturing_process,
  CASE WHEN {_H} % 43 = 0 THEN NULL ELSE l_returnflag = 'R' END AS clinical_data_available,
  l_linestatus = 'O' AS animal_toxicity_data,
  {_pick("12 months,18 months,24 months,30 months", _H)} AS stability_data,
  '12 months' AS retest_period,
  CASE WHEN {_H} % 47 = 0 THEN NULL ELSE TRUE END AS adverse_events_reported,
  CAST(l_quantity AS INT) - 3 AS safety_database_size,
  CASE WHEN {_H} % 53 = 0 THEN NULL ELSE CAST(l_linenumber AS INT) - 2 END AS serious_adverse_events,
  CASE WHEN {_H} % 4 = 0 THEN 'None' ELSE 'Pregnancy, lactation' END AS contraindications,
  'Monitor liver function' AS precautions
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
)

VIEWS["checked_records"] = (
    ["lineitem"],
    f"""
SELECT {_KEY} AS id,
  CASE WHEN {_H} % 10 = 0 THEN NULL WHEN {_H} % 10 = 1 THEN 'abc' WHEN {_H} % 10 = 2 THEN '-4' WHEN {_H} % 10 = 3 THEN '151'
       ELSE CAST(l_partkey % 80 + 1 AS STRING) END AS patient_age,
  CASE WHEN {_H} % 9 = 0 THEN NULL ELSE {_pick("M,F,Male,male,Other,Female", _H)} END AS patient_gender,
  CASE WHEN {_H} % 4 = 0 THEN NULL WHEN {_H} % 4 = 1 THEN '1980/01/01'
       ELSE concat(CAST(2026 - (l_partkey % 80 + 1) - {_H} % 3 AS STRING), '-06-15') END AS date_of_birth,
  CASE WHEN {_H} % 6 = 0 THEN 'Decades' WHEN {_H} % 6 = 1 THEN NULL ELSE 'Years' END AS age_unit,
  CASE WHEN {_H} % 5 = 0 THEN 'Pregnant' WHEN {_H} % 5 = 1 THEN NULL ELSE 'Not applicable' END AS pregnancy_status,
  CASE WHEN {_H} % 12 = 0 THEN NULL WHEN {_H} % 12 = 1 THEN '2024-13-01' ELSE {_iso("l_shipdate", "0")} END AS treatment_start_date,
  CASE WHEN {_H} % 13 = 0 THEN NULL WHEN {_H} % 13 = 1 THEN '2023-02-30' WHEN {_H} % 13 = 2 THEN '01/02/2024'
       ELSE {_iso("l_shipdate", f"({_H} % 160) - 4")} END AS event_onset_date,
  CASE WHEN {_H} % 3 = 0 THEN NULL WHEN {_H} % 3 = 1 THEN {_iso("l_shipdate", f"({_H} % 160) + 400")}
       ELSE {_iso("l_shipdate", f"({_H} % 160) - 10")} END AS dechallenge_date,
  CASE WHEN {_H} % 8 = 0 THEN NULL WHEN {_H} % 8 = 1 THEN 'tablet' WHEN {_H} % 8 = 2 THEN '-5mg' WHEN {_H} % 8 = 3 THEN '1.2.3 mg'
       WHEN {_H} % 8 = 4 THEN '0 mg' ELSE concat(CAST(CAST(l_quantity AS INT) * 25 AS STRING), 'mg daily') END AS dose,
  {_pick("once daily,Twice daily,three times daily,weekly,once weekly,as needed,sometimes", _H)} AS frequency,
  CASE WHEN {_H} % 7 = 0 THEN NULL ELSE CAST(l_partkey % 400 AS STRING) END AS duration_days,
  CASE WHEN {_H} % 11 = 0 THEN NULL ELSE CAST({_H} % 17 - 1 AS STRING) END AS naranjo_score,
  CASE WHEN {_H} % 5 = 2 THEN NULL ELSE l_returnflag = 'R' END AS dechallenge_response,
  l_linestatus = 'O' AS rechallenge_response,
  CASE WHEN {_H} % 2 = 0 THEN 'Form 44' ELSE 'Other' END AS form_type,
  {_pick(_EVENTS, _H)} AS adverse_event
FROM {{lineitem}}""",
)

VIEWS["cases"] = (
    ["lineitem"],
    f"""
SELECT CAST(l_orderkey AS STRING) AS doc_id,
  l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS pos,
  CASE WHEN {_H} % 21 = 0 THEN NULL ELSE {_KEY} END AS case_id,
  CASE WHEN {_H} % 17 = 0 THEN 'abc' WHEN {_H} % 23 = 0 THEN '-1' WHEN {_H} % 29 = 0 THEN '151' WHEN {_H} % 31 = 0 THEN '0' ELSE CAST(l_partkey % 90 AS STRING) END AS patient_age,
  {_pick("M,F,Other,m,Male", _H)} AS patient_gender,
  CASE WHEN {_H} % 14 = 5 THEN NULL ELSE {_pick(_EVENTS, "l_partkey")} END AS adverse_event_term,
  CASE WHEN {_H} % 6 = 0 THEN {_dmy("l_shipdate", "0", "/")} WHEN {_H} % 6 = 1 THEN '12 March 2026' ELSE {_iso("l_shipdate", "0")} END AS event_onset_date,
  {_pick("Mild,moderate,Severe symptoms,Fatal,High,Life-threatening", _H)} AS event_severity,
  CASE WHEN {_H} % 10 = 9 THEN NULL ELSE {_pick("Recovered,not yet recovered,Fatal,Unknown,Not Recovered", _H)} END AS outcome,
  'Drug-X' AS drug_name,
  CASE WHEN {_H} % 12 = 0 THEN '' ELSE '50 mg' END AS dose,
  CASE WHEN {_H} % 9 = 0 THEN NULL ELSE l_returnflag = 'R' END AS dechallenge_performed,
  {_iso("l_shipdate", "3")} AS report_date,
  CASE WHEN {_H} % 4 = 0 THEN 'Improved' ELSE NULL END AS dechallenge_response
FROM {{lineitem}}""",
)

VIEWS["narratives"] = (
    ["lineitem"],
    f"""
SELECT {_KEY} AS id,
  concat('Patient ', CAST(l_suppkey AS STRING), ' on study drug. ',
    CASE WHEN {_H} % 7 = 0 THEN 'Event occurred 3 days after the first dose. ' WHEN {_H} % 7 = 1 THEN 'Onset 14 days from start. '
         WHEN {_H} % 7 = 2 THEN 'It began immediately. ' WHEN {_H} % 7 = 3 THEN 'Seen 48  hours on. ' ELSE 'Onset unclear. ' END,
    CASE WHEN l_partkey % 4 = 0 THEN 'Worse when dose increased. ' ELSE '' END,
    CASE WHEN l_partkey % 3 = 0 THEN 'Similar cases in literature. ' WHEN l_partkey % 3 = 1 THEN 'Cause unknown. ' ELSE '' END,
    CASE WHEN l_suppkey % 4 = 0 THEN concat('Drug stopped.', chr(10)) WHEN l_suppkey % 4 = 1 THEN 'Drug discontinued, symptoms resolved. ' ELSE '' END,
    CASE WHEN l_suppkey % 5 = 0 THEN 'Later restarted and the event recurred. ' WHEN l_suppkey % 5 = 1 THEN 'Was reintroduced. ' ELSE '' END,
    CASE WHEN {_H} % 6 = 0 THEN 'Had an infection. ' WHEN {_H} % 6 = 1 THEN 'Pre-existing condition, but no real alternative. '
         WHEN {_H} % 6 = 2 THEN 'Temporal relationship is plain. ' ELSE '' END,
    CASE WHEN {_H} % 9 = 0 THEN 'Allergic in the past. ' ELSE '' END,
    CASE WHEN {_H} % 8 = 0 THEN 'Plasma level HIGH. ' ELSE '' END,
    CASE WHEN {_H} % 10 = 0 THEN 'Lasted 90 days. ' ELSE '' END) AS narrative
FROM {{lineitem}}""",
)

VIEWS["factors"] = (
    ["lineitem"],
    f"""
SELECT {_KEY} AS id,
  CASE WHEN {_H} % 13 = 0 THEN NULL ELSE CAST({_H} % 101 - 1 AS INT) END AS days,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 2 = 0 END AS dose_correlated,
  l_suppkey % 2 = 0 AS known_reaction,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey % 3 = 0 END AS resolved,
  l_linenumber % 2 = 0 AS recurred,
  l_returnflag = 'R' AS alternative
FROM {{lineitem}}""",
)

VIEWS["reports"] = (
    ["orders", "customer"],
    f"""
SELECT CAST(o_orderkey AS STRING) AS doc_id,
  CASE WHEN o_orderkey % 50 = 0 THEN concat('Drug Name: Short', chr(10), 'Age: 40') ELSE concat(
    'ADVERSE DRUG REACTION REPORT', chr(10), chr(10),
    CASE WHEN o_orderkey % 4 = 0 THEN concat('Drug Name', chr(10), '  Drug-', CAST(o_custkey AS STRING), chr(10))
         WHEN o_orderkey % 4 = 1 THEN concat('drug name = Drug-', CAST(o_custkey AS STRING), chr(10))
         WHEN o_orderkey % 4 = 2 THEN concat('Suspect Drug - Drug-', CAST(o_custkey AS STRING), chr(10)) ELSE '' END,
    'Manufacturer: Works ', CAST(c_nationkey AS STRING), ' and Batch: B-', CAST(o_orderkey AS STRING), chr(10),
    CASE WHEN o_orderkey % 3 = 0 THEN concat('Batch Number: Batch: ABC', CAST(o_orderkey AS STRING), chr(10)) ELSE '' END,
    'Expiry Date: ', {_iso("o_orderdate", "700")}, chr(10),
    CASE WHEN o_orderkey % 5 = 0 THEN concat('Date Drug Started: soon', chr(10), 'Started - ', {_dmy("o_orderdate", "0", "-")}, chr(10)) ELSE '' END,
    'Route of Administration: Oral', chr(10), 'Dosage: ', CAST(o_custkey % 90 + 10 AS STRING), ' mg daily', chr(10),
    CASE WHEN o_orderkey % 2 = 0 THEN concat('Patient Age: ', CAST(o_custkey % 90 + 5 AS STRING), ' years', chr(10)) ELSE concat('Age: very old', chr(10)) END,
    'Gender: ', CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE 'Female' END, chr(10),
    'Weight: ', CAST(o_custkey % 60 + 40 AS STRING), '.5 kg', chr(10),
    CASE WHEN o_orderkey % 6 = 0 THEN concat('Past Medical History: Diabetes with Label: none', chr(10)) ELSE '' END,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('Adverse Reaction: ', {_pick(_EVENTS, "o_custkey")}, ' after ', CAST(o_custkey % 9 + 1 AS STRING), ' doses', chr(10)) END,
    CASE WHEN o_orderkey % 8 = 0 THEN concat('Onset Date: 12 March 2026', chr(10)) WHEN o_orderkey % 8 = 1 THEN concat('Date of Onset: ', {_dmy("o_orderdate", "3", "/")}, chr(10))
         WHEN o_orderkey % 8 = 2 THEN concat('Symptom seen on ', {_iso("o_orderdate", "4")}, chr(10)) ELSE '' END,
    'Severity: ', {_pick("Mild,Moderate,Severe", "o_orderkey")}, chr(10), 'Outcome: Response: Recovering', chr(10),
    CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN concat('Seen by Dr. ', {_pick(_FIRST, "o_custkey")}, ' ', {_pick(_LAST, "o_orderkey")}, chr(10))
         ELSE concat('Reporter Name: Dr. ', {_pick(_FIRST, "o_custkey")}, ' ', {_pick(_LAST, "o_orderkey")}, chr(10)) END,
    'Phone: +91-98765', lpad(CAST(o_custkey % 100000 AS STRING), 5, '0'), chr(10), 'Email: user', CAST(o_custkey AS STRING), '@hospital.com', chr(10),
    CASE WHEN o_orderkey % 10 < 3 THEN concat('Report Date: ', {_iso("o_orderdate", "9")}, chr(10)) WHEN o_orderkey % 10 < 5 THEN concat('Filed 3 April 2026', chr(10)) ELSE '' END,
    'Previous ADR: none known') END AS text
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
)

_LISTED = " || ".join(
    f"""CASE WHEN l_linenumber >= {i} THEN concat('Case ID: AE', CAST(l_partkey AS STRING), '-{i}', chr(10),
    CASE WHEN ({_H} + {i}) % 5 = 0 THEN 'Patient Age' ELSE 'Age' END, ': ', CAST((l_partkey + {i}) % 90 + 1 AS STRING), chr(10),
    'Patient Gender: ', {_pick("M,female,Other,F,x", f"({_H} + {i})")}, chr(10), 'Adverse Event Term: ', {_pick(_EVENTS, f"({_H} * {i})")}, chr(10),
    CASE WHEN ({_H} + {i}) % 4 = 0 THEN '' ELSE concat('Event Onset Date: ', {_iso("l_shipdate", str(i))}, chr(10)) END,
    'Event Severity: Mild', chr(10), CASE WHEN ({_H} + {i}) % 3 = 0 THEN '' ELSE concat('Outcome: Recovered', chr(10)) END,
    'Drug Name: Drug-X{i}', chr(10), CASE WHEN ({_H} + {i}) % 6 = 0 THEN 'Dosage: 12' ELSE 'Dose: 50 mg' END, chr(10),
    'Dechallenge Performed: ', CASE WHEN ({_H} + {i}) % 2 = 0 THEN 'Yes' ELSE 'No' END, chr(10),
    CASE WHEN ({_H} + {i}) % 7 = 0 THEN concat('Notes: in case of doubt ask', chr(10)) ELSE '' END,
    'Report Date: ', {_iso("l_shipdate", str(i + 5))}, chr(10), chr(10)) ELSE '' END"""
    for i in (1, 3, 5)
)
VIEWS["line_listings"] = (
    ["lineitem"],
    f"""
SELECT {_KEY} AS doc_id, concat('Line Listing of Adverse Events', chr(10), chr(10)) || {_LISTED} AS text
FROM {{lineitem}}""",
)

VIEWS["drugs"] = (
    ["part"],
    """
SELECT p_partkey AS pos,
  CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) WHEN p_partkey % 10 = 1 THEN concat(p_name, 's') WHEN p_partkey % 15 = 2 THEN concat(p_name, '-', p_brand)
       WHEN p_partkey % 97 = 3 THEN '--' WHEN p_partkey % 101 = 4 THEN NULL ELSE p_name END AS drug
FROM {part}""",
)

def _name(k: str) -> str:
    parts = ", ".join(_pick(_SYL, f"CAST(floor({k} / {20 ** i}) AS BIGINT)") for i in range(4))
    return f"concat({parts})"


VIEWS["applicants"] = (
    ["customer"],
    f"""
SELECT c_custkey AS pos,
  CASE WHEN c_custkey % 53 = 0 THEN NULL
       WHEN c_custkey % 7 = 0 THEN concat('Dr. ', {_name("((c_custkey - c_custkey % 7) * 7919)")}, ' ', {_pick(_LAST, "c_custkey - c_custkey % 7")})
       WHEN c_custkey % 7 = 1 THEN concat({_name("((c_custkey - c_custkey % 7) * 7919)")}, ' ', {_pick(_LAST, "c_custkey - c_custkey % 7")})
       ELSE concat({_name("(c_custkey * 7919)")}, ' ', {_pick(_LAST, "c_custkey * 31")}) END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 29 = 1 THEN 'INFO@pharma.org' WHEN c_custkey % 29 = 2 THEN 'info@pharma.org'
       ELSE concat('u', CAST(c_custkey AS STRING), '@mail.org') END AS email,
  concat({_pick("Zenith Pharma,Apex Biologics,Orchid Remedies,Lotus Labs,Sunrise Drugs", "c_nationkey")}, ' ', c_mktsegment) AS company,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 31 = 3 THEN '9876543210' ELSE CAST(9000000000 + c_custkey AS STRING) END AS phone
FROM {{customer}}""",
)

VIEWS["batch_filings"] = (
    ["customer"],
    f"""
SELECT pos, CAST(pos AS STRING) AS id, name AS applicant_name, email AS applicant_email, company, phone,
  concat('2024-01-', lpad(CAST(pos % 28 + 1 AS STRING), 2, '0')) AS created_date,
  concat('Drug-', CAST(pos % 37 AS STRING), ',', {_pick("Aspirin,Aspirine,Ibuprofen,Paracetamol,Paracetamole,Warfarin", "pos")}) AS drug_list
FROM ({VIEWS["applicants"][1]})""",
)

VIEWS["addresses"] = (
    ["customer"],
    f"""
SELECT c_custkey AS pos,
  CASE WHEN c_custkey % 59 = 0 THEN NULL
       ELSE concat(CAST((c_custkey - c_custkey % 5) % 97 AS STRING), ' ', {_name("((c_custkey - c_custkey % 5) * 104729)")}, ' Street',
         CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN '.' ELSE concat(' Block ', {_name("(c_custkey * 7919)")}) END,
         CASE WHEN c_custkey % 11 = 0 THEN concat(', ', CAST(110000 + c_custkey % 50 AS STRING)) ELSE '' END) END AS address
FROM {{customer}}""",
)

VIEWS["filings"] = (
    ["orders"],
    f"""
SELECT o_orderkey AS pos, CAST(o_orderkey AS STRING) AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN upper({_pick(_FIRST, "o_custkey")}) WHEN o_orderkey % 3 = 1 THEN concat({_pick(_FIRST, "o_custkey")}, '.')
       ELSE {_pick(_FIRST, "o_custkey")} END AS applicant_name,
  CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS created_date,
  CAST(o_custkey % 5 AS INT) AS drug_count
FROM {{orders}}""",
)

VIEWS["files"] = (
    ["documents"],
    """
SELECT doc_id, concat('landing/', source, '/doc_', CAST(doc_id AS STRING),
    CASE WHEN doc_id % 7 = 0 THEN '.exe' WHEN doc_id % 7 = 1 THEN '.PDF' WHEN doc_id % 7 = 2 THEN '' WHEN doc_id % 7 = 3 THEN '.docx' ELSE '.pdf' END) AS path,
  n_chars * 10000 AS length,
  CASE WHEN doc_id % 5 = 0 THEN 'image/png' WHEN doc_id % 5 = 1 THEN 'text/plain' ELSE 'application/pdf' END AS mime
FROM {documents}""",
)

VIEWS["text_candidates"] = (
    ["documents"],
    """
SELECT doc_id, 1 AS method_rank, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM {documents}
UNION ALL SELECT doc_id, 2 AS method_rank, CASE WHEN doc_id % 4 = 0 THEN concat('page ', source) ELSE text END AS text FROM {documents}
UNION ALL SELECT doc_id, 3 AS method_rank, CASE WHEN doc_id % 6 = 0 THEN '  ' ELSE text END AS text FROM {documents}""",
)

VIEWS["doc_pages"] = (
    ["conversations"],
    """
SELECT CAST(conv_id AS STRING) AS doc_id, turn AS page_no,
  CASE WHEN conv_id % 4 = 0 AND turn % 2 = 1 THEN '  -  ' WHEN conv_id % 9 = 0 AND turn % 3 = 0 THEN concat('%PDF-1.4 ', text) ELSE text END AS text,
  CAST((conv_id * 7 + turn * 13) % 100 - 5 AS DOUBLE) AS ocr_confidence
FROM {conversations}""",
)

VIEWS["patients"] = (
    ["customer"],
    f"""
SELECT CAST(c_custkey AS STRING) AS id, CAST(c_custkey % 83 + 5 AS INT) AS age,
  {_pick("Delhi,Gurgaon,Mumbai,Bangalore,Hyderabad,Kolkata,Pune", "c_nationkey")} AS city,
  {_pick("AIIMS New Delhi,Max Super Specialty,Apollo Hospital,Fortis Healthcare,Government Medical College,Local Clinic", "c_custkey * 3 + c_nationkey")} AS hospital,
  {_pick("M,F", "c_custkey")} AS gender, c_mktsegment AS diagnosis,
  c_name AS patient_name, concat('u', CAST(c_custkey AS STRING), '@mail.org') AS patient_email,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE '2024-01-15' END AS visit_date
FROM {{customer}}""",
)


class Tables:
    """The shared tables of one folder and the views over them, built on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        if spark.conf.get(HUGE_METHOD) == "65535":
            spark.conf.set(HUGE_METHOD, "8000")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as a stream of its files."""
        return table_stream(self.spark, self.folder, f"{name}.parquet", self.table(name).schema)

    def dealt(self, name: str) -> DataFrame:
        """A table for costly row-local work, dealt to all cores.

        Spark splits files by their bytes, so that a table of few bytes keeps few cores busy however long a row takes. The session's ``PARTS``
        setting names the number of parts; without it a table that Spark reads in fewer parts than there are cores is dealt to two parts a core.
        """
        df, parts = self.table(name), self.spark.conf.get(PARTS, None)
        if parts:
            return df.repartition(int(parts))
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)

    def cut(self, df: DataFrame, key: str) -> DataFrame:
        """Each part of a frame cut into so many that all cores have work; rows of a part with equal keys stay together, in their order."""
        parts = df.rdd.getNumPartitions()
        wanted = int(self.spark.conf.get(PARTS, None) or 2 * self.spark.sparkContext.defaultParallelism)
        times = -(-wanted // max(1, parts))
        own = F.spark_partition_id() * times + F.pmod(F.xxhash64(key), F.lit(times)).cast("int")
        return df.withColumn("_part", own).repartitionById(parts * times, "_part").drop("_part") if times > 1 else df

    def view(self, name: str, wide: bool = False, streaming: bool = False) -> DataFrame:
        """A view; ``wide`` deals its first table, ``streaming`` reads it as a stream."""
        tables, text = VIEWS[name]
        frames = {t: self.table(t) for t in tables}
        if streaming:
            frames[tables[0]] = self.stream(tables[0])
        elif wide:
            frames[tables[0]] = self.dealt(tables[0])
        return self.spark.sql(text, **frames)


def oracle(views: list[str], body: str) -> str:
    """Oracle SQL: the views as common table expressions, then the query."""
    parts = []
    for name in views:
        tables, text = VIEWS[name]
        parts.append(f"{name} AS ({text.format(**{t: t for t in tables})})")
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {text[5:]}" if parts else text
    return f"WITH {', '.join(parts)} {text}" if parts else text
