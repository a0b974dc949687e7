"""Table schemas, vocabularies and declarative rule sets."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SUBMISSIONS = T.StructType(
    _strings("id", "filename", "submission_type", "status", "submitted_by")
    + [T.StructField("created_at", T.TimestampType())]
    + _strings("severity", "outcome", "adverse_event", "drug_name")
)

VALIDATION_RESULTS = T.StructType(
    _strings("id", "submission_id", "check_type", "result", "status")
    + [T.StructField("created_at", T.TimestampType()), T.StructField("pos", T.LongType())]
)

AUDIT_LOG = T.StructType(
    _strings("id", "operation", "user_id", "resource", "details")
    + [T.StructField("timestamp", T.TimestampType())]
)

# ---------------------------------------------------------------------------
# Vocabularies, labels and limits that decide results.
# ---------------------------------------------------------------------------

SEVERITY_BUCKETS = ["Mild", "Moderate", "Severe", "Life-threatening", "Unknown"]
OUTCOME_BUCKETS = ["Recovered", "Recovering", "Not Recovered", "Unknown", "Fatal"]
CASE_SEVERITIES = ["Mild", "Moderate", "Severe", "Life-threatening", "Fatal"]
CASE_OUTCOMES = ["Recovered", "Recovering", "Not Recovered", "Fatal", "Unknown"]
CASE_GENDERS = ["M", "F", "Other"]

PASSED_STATUSES = ["completed", "approved"]
EXPORT_PASSED_STATUSES = ["PASSED"]
APP_STATUSES = [
    "uploaded",
    "validating_duplicates",
    "validating_consistency",
    "validating_form",
    "completed",
    "failed",
    "approved",
]
TABLE_STATUSES = ["pending", "processing", "completed", "error"]

FORM_CHECKS = ["ADR Validation", "Form 44"]

MAX_UPLOAD_BYTES = 100 * 1024 * 1024
UPLOAD_MIME_TYPES = ["application/pdf", "image/jpeg", "image/png", "image/tiff"]
UPLOAD_EXTENSIONS = ["pdf", "doc", "docx", "jpg", "jpeg", "png"]
MIN_TEXT_CHARS = 100
RETENTION_DAYS = 90
K_ANONYMITY_THRESHOLD = 5

VALUE_LABELS = [
    "Term",
    "Response",
    "Description",
    "Value",
    "Result",
    "Finding",
    "Reaction",
    "Event",
    "Answer",
    "Status",
    "Batch",
    "Batch Number",
    "Lot",
    "Field",
]

TEXT_FIELDS = [
    "adverse_reaction",
    "adverse_event_term",
    "drug_name",
    "generic_name",
    "manufacturer",
    "batch_number",
    "outcome",
    "patient_name",
    "reporter_name",
    "reporter_address",
    "complaint",
    "other_relevant_history",
    "description",
    "findings",
]

DATE_FIELDS = [
    "onset_date",
    "event_onset_date",
    "report_date",
    "manufacturing_date",
    "expiration_date",
    "dob",
    "date_of_birth",
]

ADR_INDICATORS = ["patient_age", "adverse_reaction", "onset_date", "patient_gender"]
DMF_INDICATORS = ["applicant_name", "manufacturing_process", "drug_code", "clinical_data_available"]

BATCH_REPORTER = "Batch Submission - Auto-reported"
SINGLE_REPORTER = "Auto-reported (Extracted)"

# Drug master file: section -> field -> rule. Every field is mandatory unless required=False.
DMF_RULES = {
    "Section 1: Applicant Information": {
        "applicant_name": {"type": "string", "min_length": 5},
        "applicant_address": {"type": "string", "min_length": 10},
        "applicant_phone": {"type": "string", "pattern": r"^\d{10}$"},
        "applicant_email": {"type": "string", "pattern": r"^[\w\.-]+@[\w\.-]+\.\w+$"},
        "drug_name": {"type": "string", "min_length": 3},
        "drug_code": {"type": "string", "min_length": 3},
    },
    "Section 2: Drug Information": {
        "drug_strength": {"type": "string"},
        "dosage_form": {
            "type": "string",
            "enum": ["Tablet", "Capsule", "Solution", "Suspension", "Powder", "Injection", "Other"],
        },
        "route_of_administration": {
            "type": "string",
            "enum": ["Oral", "IV", "IM", "SC", "Topical", "Inhalation", "Other"],
        },
        "manufacturing_process": {"type": "string", "min_length": 50},
    },
    "Section 3: Preclinical & Stability": {
        "clinical_data_available": {"type": "boolean"},
        "animal_toxicity_data": {"type": "boolean"},
        "stability_data": {"type": "string", "enum": ["12 months", "18 months", "24 months", "36 months"]},
        "retest_period": {"type": "string", "min_length": 5},
    },
    "Section 4: Safety & Efficacy": {
        "adverse_events_reported": {"type": "boolean"},
        "safety_database_size": {"type": "integer", "min_value": 0},
        "serious_adverse_events": {"type": "integer", "min_value": 0},
        "contraindications": {"type": "string", "min_length": 10},
        "precautions": {"type": "string", "min_length": 10},
    },
}

# Adverse reaction report: mandatory and recommended fields.
ADR_MANDATORY = {
    "drug_name": {"type": "string", "min_length": 2},
    "adverse_reaction": {"type": "string", "min_length": 5},
    "patient_age": {"type": "int", "min_value": 1, "max_value": 150},
    "onset_date": {"type": "string"},
    "reporter_name": {"type": "string", "min_length": 3},
    "report_date": {"type": "string"},
}
ADR_RECOMMENDED = ["severity", "outcome", "duration", "concomitant_medications"]
ADR_OPTIONAL = ["patient_gender", "patient_weight", "medical_history", "reporter_title", "reporter_phone", "reporter_email"]

# Line listing case: the eleven mandatory fields, in report order.
CASE_RULES = {
    "case_id": {"type": "string"},
    "patient_age": {"type": "integer", "min_value": 0, "max_value": 150},
    "patient_gender": {"type": "string", "enum": CASE_GENDERS},
    "adverse_event_term": {"type": "string"},
    "event_onset_date": {"type": "date"},
    "event_severity": {"type": "string", "enum": CASE_SEVERITIES},
    "outcome": {"type": "string", "enum": CASE_OUTCOMES},
    "drug_name": {"type": "string"},
    "dose": {"type": "string"},
    "dechallenge_performed": {"type": "boolean"},
    "report_date": {"type": "date"},
}

# Line listing labels, first contained label wins.
CASE_LABELS = [
    ("case id", "case_id"),
    ("patient age", "patient_age"),
    ("age", "patient_age"),
    ("patient gender", "patient_gender"),
    ("gender", "patient_gender"),
    ("adverse event term", "adverse_event_term"),
    ("adverse event", "adverse_event_term"),
    ("event onset date", "event_onset_date"),
    ("onset date", "event_onset_date"),
    ("event severity", "event_severity"),
    ("severity", "event_severity"),
    ("outcome", "outcome"),
    ("drug name", "drug_name"),
    ("drug", "drug_name"),
    ("dose", "dose"),
    ("dosage", "dose"),
    ("dechallenge performed", "dechallenge_performed"),
    ("dechallenge", "dechallenge_performed"),
    ("report date", "report_date"),
    ("date reported", "report_date"),
]

# Report text: field -> (labels, value format). The four fields with None have their own rules.
REPORT_FIELDS = {
    "drug_name": None,
    "manufacturer": (["Manufacturer", "Mfg", "Made by"], None),
    "generic_name": (["Generic Name"], None),
    "batch_number": (["Batch Number", "Batch No", "Lot Number", "Batch", "BATCH"], "batch"),
    "manufacturing_date": (["Manufacturing Date", "Manufactured", "Mfg Date"], "date"),
    "expiration_date": (["Expiration Date", "Expiry Date", "Exp Date"], "date"),
    "strength": (["Strength", "Potency", "Concentration", "Dose"], None),
    "route_of_administration": (["Route", "Route of Administration"], None),
    "dose": (["Dose", "Dosage"], None),
    "frequency": (["Frequency", "Dosing Frequency"], None),
    "indication": (["Indication", "Indications"], None),
    "date_started": (["Date Started", "Date Drug Started", "Started"], "date"),
    "date_stopped": (["Date Stopped", "Date Drug Stopped", "Stopped"], "date"),
    "patient_id": (["Patient ID", "Patient", "ID"], None),
    "patient_age": (["Patient Age", "Age"], "age"),
    "patient_gender": (["Gender", "Sex"], None),
    "patient_weight": (["Weight"], "weight"),
    "medical_history": (["Medical History", "Past Medical History", "History"], None),
    "adverse_reaction": None,
    "onset_date": None,
    "duration": (["Duration"], None),
    "severity": (["Severity"], None),
    "outcome": (["Outcome", "Result", "Resolution"], None),
    "concomitant_medications": (["Concomitant Medications", "Other Drugs", "Co-medications"], None),
    "previous_adr": (["Previous ADR", "Previous Allergies", "Allergy"], None),
    "reporter_name": None,
    "reporter_title": (["Title", "Designation"], None),
    "reporter_phone": (["Phone", "Contact Number"], "phone"),
    "reporter_email": (["Email"], "email"),
    "report_date": None,
}
DRUG_LABELS = [
    "Drug Name", "Product Name", "Brand Name", "Suspect Drug", "Medication", "Drug", "Medicine Name",
]
REACTION_LABELS = [
    "Adverse Reaction", "Adverse Event", "Reaction Type", "Adverse Reaction:", "Adverse Event Term",
]
REPORTER_LABELS = [
    "Reporter Name", "Reported by", "Investigator", "Healthcare Provider", "Physician", "Doctor",
    "Medical Officer", "Dr.", "Submitted by", "Reporter", "Contact Person", "Submitted By", "Author",
]
ONSET_LABELS = [
    "Onset Date", "Date of Onset", "Date of Reaction", "Symptom Onset", "Reaction Date", "Symptom Date",
]
REPORT_DATE_LABELS = [
    "Report Date", "Date of Report", "Reported on", "Date Reported", "Report submission date",
    "Date Submitted", "Submission Date",
]

MONTH_NAME = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
VALUE_FORMATS = {
    "date": (
        r"(?:\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}|" + MONTH_NAME + r"\s+\d{1,2},?\s+\d{4}|"
        r"\d{1,2}\s+" + MONTH_NAME + r"\s+\d{4})"
    ),
    "age": r"\d{1,3}",
    "weight": r"\d+\.?\d*\s*(?:kg|g|lbs?|pounds)?",
    "phone": r"[\+\d\s\-()]+",
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "batch": r"[A-Z0-9\-]+",
}
NUMERIC_DATE = r"(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"

AGE_UNITS = ["years", "months", "days", "weeks"]
GENDERS = ["M", "F", "Male", "Female", "Other", "Not specified"]
FREQUENCIES = [
    "once daily", "twice daily", "three times daily", "once weekly",
    "twice weekly", "once every 12 hours", "once monthly", "as needed",
]
MAX_CUMULATIVE_DOSE = 100000
MAX_ONSET_DAYS = 152
MAX_DECHALLENGE_DAYS = 365

NARRATIVE_WORDS = {
    "onset_immediate": ["immediately", "at the time", "during", "concurrent", "same day"],
    "onset_2days": [
        "2 days", "48 hours", "day 1", "day 2", "within 48", "post-", "post dose",
        "hours post", "days post", "hours after",
    ],
    "onset_5_30days": ["5 days", "1 week", "2 weeks", "3 weeks", "4 weeks", "month", "week"],
    "dose_increase": ["dose increased", "higher dose", "when dose increased", "dose escalation"],
    "known_reaction": ["known", "reported", "documented", "literature", "case report", "fda", "similar"],
    "stopped_drug": [
        "stopped", "discontinued", "withdrew", "cessation", "stopped medication", "able to stop",
        "discontinuation", "withdrawal",
    ],
    "resolved": ["resolved", "improved", "recovered", "symptom disappeared", "remitted"],
    "restarted_drug": ["restarted", "re-exposed", "re-challenged", "reintroduced", "rechallenge"],
    "recurred": ["recurred", "reappeared", "happened again", "repeated", "returned"],
}

PRIORITY_ACTIONS = {
    "CRITICAL": "Immediate safety review - consider regulatory action (recall, contraindication, label update)",
    "HIGH": "Priority safety review - plan follow-up investigation",
    "MEDIUM": "Standard review - obtain additional data if unclear",
    "LOW": "Accept as unlikely causality - routine processing",
}

FRAMEWORK_ADJUSTMENTS = [("DPDP", 2), ("NDHM", -1), ("ICMR", 1), ("CDSCO", 0)]
FRAMEWORK_NAMES = {
    "DPDP": "Digital Personal Data Protection Act",
    "NDHM": "National Digital Health Mission",
    "ICMR": "Indian Council of Medical Research Guidelines",
    "CDSCO": "Central Drugs Standard Control Organization",
}

PROCESSING_STAGES = [
    "uploaded", "validating_duplicates", "validating_consistency", "validating_form", "completed",
]

CITY_REGIONS = {
    "Delhi": "NCR Region, India",
    "Gurgaon": "NCR Region, India",
    "Mumbai": "Western Region, India",
    "Bangalore": "Southern Region, India",
    "Hyderabad": "South-Central Region, India",
    "Kolkata": "Eastern Region, India",
}
HOSPITAL_TIERS = {
    "AIIMS New Delhi": "Tier-1 Public Hospital",
    "Max Super Specialty": "Tier-3 Private Hospital",
    "Apollo Hospital": "Tier-3 Private Hospital",
    "Fortis Healthcare": "Tier-3 Private Hospital",
    "Government Medical College": "Tier-2 Government Hospital",
}
# ------------------------------------------------------------- end fixed values
