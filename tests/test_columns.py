import difflib

import pytest
from pyspark.sql import functions as F

from caselight.functions import dates, quality, text
from caselight.functions.presence import as_int, present_trimmed, present_truthy, strip
from caselight.functions.similarity import block_ratio, edit_similarity, match_confidence, match_reason, round3


def run(spark, build, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    return [r[0] for r in df.select(build().alias("o")).collect()]


def check(spark, build, table):
    assert run(spark, build, *[k for k, _ in table]) == [v for _, v in table]


def test_clean_text_field(spark):
    check(spark, lambda: text.clean_text_field("v"), [
        ("Term: Severe headache and nausea", "Severe headache and nausea"),
        ("Response: Yes", "Yes"),
        ("Description: Patient recovered", "Patient recovered"),
        ("Value: Moderate", "Moderate"),
        ("Finding: Severe allergic reaction", "Severe allergic reaction"),
        ("  Multiple   spaces  ", "Multiple spaces"),
        ("TERM: Uppercase prefix", "Uppercase prefix"),
        ("Term: Response: x", "x"),
        ("Response: Term: x", "Term: x"),
        ("Batch Number: Batch: A1", "Batch: A1"),
        ("Batch: Batch Number: A1", "A1"),
        ("Terminal: x", "Terminal: x"),
        ("a  b\n c", "a b c"),
        ("", ""),
        (None, ""),
    ])


def test_parse_ambiguous_date(spark):
    check(spark, lambda: dates.parse_ambiguous_date("v"), [
        ("26-03-10", "2026-03-10"),
        ("26-03-15", "2026-03-15"),
        ("10-03-26", "2010-03-26"),
        ("15-03-26", "2015-03-26"),
        ("2026-03-10", "2026-03-10"),
        ("10/03/2026", "10/03/2026"),
        ("01/05/2025", "01/05/2025"),
        ("15-06-2024", "15/06/2024"),
        ("31-1-09", "1931-01-09"),
        ("30-1-09", "2030-01-09"),
        ("26-13-10", "26-13-10"),
        ("26-03-32", "26-03-32"),
        ("26-00-10", "26-00-10"),
        ("26-03-00", "26-03-00"),
        ("5 March 2026", "5 March 2026"),
        (" 26-3-10 ", "2026-03-10"),
        (None, ""),
    ])


def test_normalize_date_format(spark):
    check(spark, lambda: dates.normalize_date_format("v"), [
        ("2026-03-10", "2026-03-10"),
        ("10/03/2026", "10/03/2026"),
        ("10-03-2026", "10/03/2026"),
        ("15-03-2026", "15/03/2026"),
        (" 1-2-2026 ", "1/2/2026"),
        ("26-03-10", "26-03-10"),
        ("", ""),
        (None, ""),
    ])


def test_cleaning_is_idempotent(spark):
    values = ["Term: a  b", "Value: Term: x", " plain ", "26-03-10", "1-2-2026", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    once = df.select(dates.parse_ambiguous_date("v").alias("d"), dates.normalize_date_format("v").alias("n"))
    twice = once.select("d", "n", dates.parse_ambiguous_date("d").alias("d2"), dates.normalize_date_format("n").alias("n2"))
    assert twice.filter("d <> d2 OR n <> n2").count() == 0


def test_date_shape_and_calendar(spark):
    check(spark, lambda: dates.is_date_shape(F.col("v")), [
        ("2026-03-15", True), ("15/03/2026", True), ("3-18-26", True), (" 2026-99-99 ", True), ("12 March 2026", False), (None, False),
    ])
    got = run(spark, lambda: dates.as_date(F.col("v")).cast("string"), "2026-3-5", "05/03/2026", "2026-02-30", "x")
    assert got == ["2026-03-05", "2026-03-05", None, None]


def test_normalize_text(spark):
    check(spark, lambda: text.normalize_text(F.col("v")), [
        ("IBP-123", "ibp123"), ("IBP 123", "ibp 123"), ("- a", " a"), ("café!", "café"), ("  A   b ", "a b"), (None, ""),
    ])


def test_enum_and_codes(spark):
    options = ["Mild", "Moderate", "Severe", "Life-threatening", "Fatal"]
    check(spark, lambda: text.normalize_enum("v", options), [
        ("Mild", "Mild"), ("mild", "Mild"), (" LIFE-THREATENING ", "Life-threatening"), ("Mild Hypotension", "Mild"),
        ("very severe and fatal", "Severe"), ("High", None), ("", None), (None, None),
    ])
    check(spark, lambda: text.normalize_enum("v", ["Recovered", "Recovering", "Not Recovered"]), [("not yet recovered", "Recovered")])
    check(spark, lambda: text.normalize_gender(F.col("v")), [("m", "M"), ("MALE", "M"), ("Female", "F"), ("x", "Other")])
    check(spark, lambda: text.code_to_bool(F.col("v")), [("Yes", True), ("TRUE", True), ("y", True), ("No", False)])


def test_status_words(spark):
    check(spark, lambda: text.status_label(F.col("v")), [("pass", "Completed"), ("fail", "Failed"), ("odd", "Pending"), ("uploaded", "Uploaded")])
    stages = ["uploaded", "validating_duplicates", "validating_consistency", "validating_form", "completed"]
    got = run(spark, lambda: text.progress_percentage(F.col("v"), stages), "completed", "failed", "uploaded", "validating_form", "odd")
    assert got == pytest.approx([100.0, 80.0, 0.0, 60.0, 0.0])


def test_presence_rules(spark):
    df = spark.createDataFrame([("0", 0, False), ("  ", 5, True), (None, None, None)], "s string, i int, b boolean").coalesce(1)
    rows = df.select(
        present_truthy(df, "s"), present_truthy(df, "i"), present_truthy(df, "b"), present_trimmed(df, "s"),
        present_trimmed(df, "i"), present_truthy(df, "absent"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (True, False, False, True, True, False), (True, True, True, False, True, False), (False,) * 6,
    ]
    assert run(spark, lambda: as_int(F.col("v")), " 45 ", "+7", "4_5", "45.0", "99999999999999999999", "") == [
        45, 7, None, None, 2**63 - 1, None,
    ]
    assert run(spark, lambda: strip(F.col("v")), " \x1c a b \n") == ["a b"]


def test_binary_junk(spark):
    long = "readable words and numbers 12345 " * 4
    check(spark, lambda: quality.is_binary_junk(F.col("v")), [
        (long, False), ("short", True), (None, True), ("%PDF-1.4 " + long, True), ("%pdf " + long, True),
        ("  \n%PDF " + long, True), ("\x00\x00\x00\x00" + long, True), ("\u0089PNG" + long, True),
        ("\x01" * 30 + "a" * 100, True), ("\x01" * 20 + "a" * 80, False), ("\t\n" * 60 + long, False),
    ])


def test_clean_text(spark):
    check(spark, lambda: quality.clean_text(F.col("v")), [
        ("a\tb", "ab"),
        ("one\n\n\n\ntwo", "one  two"),
        ("good line\n*** ### !!!\n\nend line", "good line\n\nend line"),
        ("  x  ", "x"),
        ("café \U0001f600!", "café !"),
        (None, ""),
    ])


def test_text_confidence(spark):
    got = run(spark, lambda: quality.text_confidence(F.col("v")), "", "The patient took the drug, then felt ill.", "aaaaaaaaaaaaaaaaaaaa", "!!!!! ?????")
    assert got[0] == 0.0
    assert got[1] == pytest.approx(0.4 + 0.3 + 0.3) or got[1] == pytest.approx(0.9)
    assert got[2] == pytest.approx(0.3)


def test_standard_table(spark):
    df = spark.createDataFrame([([["A", "B\nC"], [None, " x "]],), ([["only"]],), ([],)], "t array<array<string>>").coalesce(1)
    assert [r[0] for r in df.select(quality.standardize_table(F.col("t"))).collect()] == [
        "A | B C\n--- | ---\n | x", "only", "",
    ]


def test_similarity(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("abc", ""), ("drug a", "drug a"), ("aspirin", "asprin")]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(block_ratio("a", "b")).collect()]
    assert got == [0.25, 0.5, 0.0, 1.0, difflib.SequenceMatcher(None, "aspirin", "asprin").ratio()]
    edit = [r[0] for r in df.select(edit_similarity(F.col("a"), F.col("b"))).collect()]
    assert edit[3] == 1.0 and edit[2] == 0.0 and edit[4] == pytest.approx(1 - 1 / 7)
    row = spark.range(1).select(round3(F.lit(0.8625)), match_confidence(F.lit(0.8)), match_reason(F.lit(0.5))).first()
    assert tuple(row) == (round(0.8625, 3), "LOW", "Possible match (similarity: 50.0%)")


def test_postal_codes(spark):
    assert run(spark, lambda: text.postal_codes(F.col("v")), "Delhi 110001, box 12345 and 1234567") == [["110001", "12345"]]


def test_strip_takes_linear_time(one):
    import time

    from caselight.functions.presence import strip

    start = time.time()
    long = "a" + " " * 1_000_000 + "b"
    assert one(strip, "  x\t", long, " " * 500_000, "　y\x1c") == ["x", long, "", "y"]
    assert time.time() - start < 5


def test_pseudonyms_stand_where_the_hits_are(one):
    from caselight.operators.privacy import pseudonymize

    assert one(pseudonymize, "Name: A\nAll About AADHAAR 1234 5678 9012 a@b.cc x@y.zz a@b.cc", "plain", None) == [
        "Name: [PERSON_1]\nAll About AADHAAR [AADHAAR_1] [EMAIL_1] [EMAIL_2] [EMAIL_1]", "plain", None,
    ]
