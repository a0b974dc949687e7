import random

from pyspark.sql import functions as F

from caselight.operators import extract as X
from caselight.sources import documents

REPORT = """ADVERSE DRUG REACTION REPORT
Patient ID: PAT-77
Age: 52 years
Gender: Female
Weight: 65 kg
Drug Name: Paracetamol
Batch Number: Batch: ABC-45
Expiry Date: 2027-12-31
Date Drug Started: 15-02-2026
Dosage: 500 mg
Frequency: Twice daily and Route: none
Adverse Reaction: Severe abdominal pain
Date of Onset: 2026-02-28
Outcome: Recovered
Reporter Name: Dr. Ramesh Kumar
Email: dr.kumar@hospital.com
Phone: +91-98765
Report Date: 15 March 2026
"""

LISTING = """Line listing of events
Case ID: AE001
Patient Age: 45
Patient Gender: male
Adverse Event Term: Severe headache
Event Onset Date: 2026-03-10
Event Severity: Moderate
Outcome: Recovering
Drug Name: Drug-X1
Dose: 50 mg
Dechallenge Performed: Yes
Report Date: 2026-03-15

Case ID: AE002
Patient Age: 60
Patient Gender: ?
Adverse Event Term: Rash
Event Onset Date: 2026-03-11
Event Severity: Mild
Dosage: 12
Dechallenge Performed: No
Report Date: 2026-03-16

Case ID: AE003
Outcome: Unknown
"""


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)


def test_parse_report(spark):
    r = X.parse_reports(docs(spark, REPORT)).first()
    assert (r.drug_name, r.patient_id, r.patient_age, r.patient_gender, r.patient_weight) == (
        "Paracetamol", "PAT-77", "52", "Female", "65 kg",
    )
    # The typed date takes the last two digits of a four-digit year.
    assert (r.expiration_date, r.onset_date, r.date_started) == ("27-12-31", "26-02-28", "15-02-2026")
    assert r.report_date == "15 March 2026"
    assert (r.adverse_reaction, r.reporter_name, r.reporter_email) == (
        "Severe abdominal pain", "Dr. Ramesh Kumar", "dr.kumar@hospital.com",
    )
    assert r.batch_number == "B"
    assert r.frequency == "Twice daily  none" or r.frequency == "Twice daily none"
    assert r.generic_name is None


def test_parse_report_options(spark):
    r = X.parse_reports(docs(spark, REPORT.replace("Gender: Female", "Gender: F").replace("Age: 52 years", "Age: 7")), full_year=True, short_fields_min_chars=1).first()
    assert (r.expiration_date, r.patient_gender, r.patient_age) == ("2027-12-31", "F", "7")
    old = X.parse_reports(docs(spark, REPORT.replace("Gender: Female", "Gender: F"))).first()
    assert old.patient_gender is None


def test_short_texts_give_nothing(spark):
    rows = X.parse_reports(docs(spark, "", "Drug Name: Aspirin", None)).collect()
    assert all(r.drug_name is None and r.report_date is None for r in rows)


def test_layouts_and_label_inside_word(spark):
    pad = "\n" + "filler words " * 10
    texts = ["Manufacturer\n  Acme Works" + pad, "Manufacturer - Acme Works" + pad, "manufacturer = Acme Works" + pad, "Dosage: 12 mg" + pad]
    rows = X.parse_reports(docs(spark, *texts)).collect()
    assert [r.manufacturer for r in rows[:3]] == ["Acme Works"] * 3
    assert rows[3].patient_age == "12"
    assert X.parse_reports(docs(spark, texts[3]), whole_word=True).first().patient_age is None


def test_first_miss_closes_its_label(spark):
    df = X.with_labels(docs(spark, "Date Started: soon\nDate Started - 01-02-2026\n", "Date Started: soon\nStarted - 01-02-2026\n"))
    labels = ["Date Started", "Started"]
    got = [r[0] for r in df.select(X.labelled_field(labels, "date")).collect()]
    # The label inside the other label still finds the second line through its own search.
    assert got[1] == "01-02-2026"
    single = df.select(X.labelled_field(["Date Started"], "date")).collect()
    assert single[0][0] is None


def test_parse_cases(spark):
    rows = X.parse_cases(docs(spark, LISTING)).orderBy("pos").collect()
    assert [r.case_id for r in rows] == ["AE001", "AE002"] or [r.case_id for r in rows] == ["AE001"]
    a = rows[0]
    assert (a.patient_gender, a.dechallenge_performed, a.dose, a.patient_age) == ("M", True, "50 mg", "45")
    blocks = X.split_cases(docs(spark, LISTING)).collect()
    assert [b.marker_id for b in blocks] == ["AE001", "AE002", "AE003"]


def test_marker_inside_prose_cuts_a_block(spark):
    text = LISTING.replace("Outcome: Recovering", "Notes: in case of doubt ask")
    assert [b.marker_id for b in X.split_cases(docs(spark, text)).collect()][:2] == ["AE001", "of"]


def test_first_usable_text(spark):
    good, short = "x" * 120, "y" * 50
    df = spark.createDataFrame([(1, 1, short), (1, 2, good), (1, 3, good + "3"), (2, 1, short), (3, 1, good)], "doc_id int, method_rank int, text string")
    out = {r.doc_id: (r.method_rank, r.extraction_quality, r.status) for r in documents.extract_texts(df).collect()}
    assert out == {1: (2, "medium", "SUCCESS"), 2: (None, "low", "EXTRACTION_FAILED"), 3: (1, "high", "SUCCESS")}


def test_page_rollup(spark):
    rows = [("d", 2, "second page text"), ("d", 1, "first page text"), ("d", 3, "x")]
    r = X.roll_up_pages(spark.createDataFrame(rows, "doc_id string, page_no int, text string")).first()
    assert r.text == "first page text\nsecond page text\n"
    assert (r.pages_extracted, r.total_pages) == (2, 3)


def test_listing_that_holds_the_sentinel_itself(spark):
    mark = X._SENTINEL
    text = LISTING.replace("Severe headache", f"Severe{mark}headache{mark}1 and {mark}0{mark}") + mark
    blocks = [r["block"] for r in X.split_cases(docs(spark, text)).orderBy("pos").collect()]
    assert len(blocks) == 3 and "".join(blocks) == text[text.index("Case ID"):]
    assert X.parse_cases(docs(spark, text)).first().adverse_event_term == f"Severe{mark}headache{mark}1 and {mark}0{mark}"


def test_labels_inside_values_words_and_lines(spark):
    text = "Drug Name: Aspirin Dose: 5 mg - Age = 7\nDosage\n\n  : 9 mg\nCo-medications - none\nFrequency:\nSeverity\nhigh\nID:   \n" + "x" * 90
    df = X.with_labels(docs(spark, text))
    found = [(f["label"], f["colon"], f["below"], f["dash"]) for f in df.first()["_found"]]
    assert found == [
        ("drug name", "Aspirin Dose: 5 mg - Age = 7", None, None), ("dose", "5 mg - Age = 7", None, None), ("age", "7", None, None),
        ("dosage", "9 mg", ": 9 mg", None), ("age", "9 mg", ": 9 mg", None), ("co-medications", None, None, "none"),
        ("frequency", "Severity", None, None), ("severity", None, "high", None), ("id", "x" * 90, None, None),
    ]
    whole = X.with_labels(docs(spark, text), whole_word=True).first()["_found"]
    assert [f["label"] for f in whole] == ["drug name", "dose", "age", "dosage", "co-medications", "frequency", "severity", "id"]


def test_label_columns_hold_the_first_value_of_each_layout(spark):
    """Fields read a column per label; it must say what the places of the label say."""
    pieces = ["Drug Name", "Age", "dosage", "Co-medications", "Dr.", "Onset date", ":", " = ", "-", "\n", "\n\n ", " ", "x1", "and The Label: y", " ", "İ"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(pieces, k=14)) for _ in range(300)] + [None, ""]
    for whole_word in (False, True):
        rows = X.with_labels(docs(spark, *texts), whole_word=whole_word).collect()
        assert any(r["_found"] for r in rows)
        for r in rows:
            for label in dict.fromkeys(x.lower() for x in X.KNOWN_LABELS):
                mine = [f for f in r["_found"] or [] if f["label"] == label]
                firsts = [next((f[n] for f in mine if f[n] is not None), None) for n in ("colon", "below", "dash")]
                assert [v or None for v in r[f"_label_{label}"] or [None] * 3] == [v or None for v in firsts], (r["text"], label)


def test_labels_are_found_by_plain_text_and_tables_dealt(spark, small, tmp_path):
    """A single label's field runs no regex over all labels, and a table of one part is dealt to all cores."""
    df = X.with_labels(docs(spark, "Age: 7" + "x" * 100)).select(X.labelled_field(["Age"], "age").alias("a"))
    assert df.first()["a"] == "7"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" in plan.lower() and "regexp_extract_all" not in plan and "reporter" not in plan
    from caselight.plans.bindings import Tables
    assert Tables(spark, small).dealt("orders").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_labels_that_never_decide_are_left_out(spark):
    """The first listed label inside a name decides, whichever labels are tried."""
    labels = X.CASE_LABELS
    fewer = X._deciding(labels)
    assert len(fewer) < len(labels)
    words = sorted({w for label, _ in labels for w in label.split()} | {"x", "s"})
    rng = random.Random(3)
    for _ in range(3000):
        name = rng.choice(["", " "]).join(rng.choices(words, k=3))
        assert next((t for x, t in labels if x in name), None) == next((t for x, t in fewer if x in name), None), name


def test_texts_are_split_at_markers_once(spark):
    """Neither the number of blocks nor the filter on fields has a text split or a block parsed a second time."""
    text = "Line listing\n" + "Case ID: A-1\nAge: 5\nCase B\nnone" + " x" * 50
    out = X.parse_cases(docs(spark, text, "short", None), min_fields=2)
    assert [(r.pos, r.case_id, r.patient_age) for r in out.collect()] == [(0, "A-1", "5")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "greatest(" not in plan and plan.count("substring_index") == 1
