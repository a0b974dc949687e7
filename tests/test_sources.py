import datetime as dt
import json

from pyspark.sql import functions as F

from caselight.operators import privacy as Y
from caselight.operators import relations as R
from caselight.schemas import SUBMISSIONS
from caselight.sources import changes, documents, sinks
from caselight.streaming import intake
from caselight.streaming.sinks import append_to, drain, finish

NOW = dt.datetime(2024, 5, 1, 12, 0)


def test_files_and_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿Drug Name: Aspirin\nline", encoding="utf-8")
    (tmp_path / "b.exe").write_text("x")
    files = documents.landed_files(spark, str(tmp_path))
    assert {documents_row.path.rsplit("/", 1)[1]: documents_row.length > 0 for documents_row in files.collect()} == {"a.txt": True, "b.exe": True}
    rows = documents.submission_rows(files)
    assert rows.columns == SUBMISSIONS.fieldNames()
    assert rows.select("id").distinct().count() == 2
    checked = {r.path.rsplit("/", 1)[1]: r.accepted for r in documents.intake_check(files).collect()}
    assert checked == {"a.txt": False, "b.exe": False}
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in documents.whole_texts(spark, str(tmp_path)).collect()}
    assert texts["a.txt"] == "Drug Name: Aspirin\nline"


def test_json_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"id": "1", "extra": 2}) + "\n" + json.dumps({"id": "2"}) + "\n")
    assert documents.json_records(spark, str(tmp_path), SUBMISSIONS).count() == 2
    df = spark.createDataFrame([("k", '{"records": [{"a": 1}, {"a": 2}]}'), ("n", "{}")], "key string, body string")
    assert [(r.key, r.pos, r.a) for r in documents.records_of(df, "body", "records", "struct<a:int>").collect()] == [("k", 0, 1), ("k", 1, 2)]


def test_result_and_audit_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "failed"), ("2", "completed")], "id string, status string")
    rows = sinks.result_rows(df, "Status Check", F.col("status"), ["status"])
    path = str(tmp_path / "res")
    other = sinks.result_rows(df, "Form 44", F.col("status"), ["status"])
    for part, run in ((rows, "a/1"), (rows.unionByName(other), "a/1"), (rows, "b"), (rows, "a/1")):
        sinks.write_results(part, path, run)
    rows.withColumns({"run": F.lit("c"), "attempt": F.lit("cut off")}).write.partitionBy("run", "attempt", "check_type").mode("append").parquet(f"{path}/rows")
    back = sinks.read_results(spark, path)
    counts = lambda: {(r["run"], r["check_type"]): r["count"] for r in sinks.read_results(spark, path).groupBy("run", "check_type").count().collect()}
    assert counts() == {("a/1", "Status Check"): 2, ("b", "Status Check"): 2} and back.filter("check_type = 'Form 44'").count() == 0
    plan = back.filter("check_type = 'Form 44'")._jdf.queryExecution().executedPlan().toString()
    assert "check_type" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert sinks.drop_superseded(spark, path) == 3 and counts() == {("a/1", "Status Check"): 2, ("b", "Status Check"): 2}
    entries = sinks.audit_entries(df, "UPLOAD", F.lit("u"), F.col("id"), F.struct("status"), NOW)
    sinks.write_audit(entries, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).select("id").distinct().count() == 2
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    sinks.write_texts(df.select("id", F.col("status").alias("text")), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt"), lineSep="\n\f\n").count() == 2


def test_snapshot_changes_with_nulls(spark):
    old = spark.createDataFrame([("1", "a"), ("2", None), ("3", "c")], "id string, v string")
    new = spark.createDataFrame([("1", "a"), ("2", "b"), ("4", "d")], "id string, v string")
    got = {r.entity_id: r.action for r in changes.snapshot_changes(old, new, "t", NOW).collect()}
    assert got == {"2": "UPDATE", "3": "DELETE", "4": "INSERT"}
    some = changes.snapshot_changes(old, new, "t", NOW, operations=("INSERT", "UPDATE"))
    assert {r.action for r in some.collect()} == {"INSERT", "UPDATE"}


def test_status_upsert(spark):
    subs = spark.createDataFrame([("1", "uploaded"), ("2", "uploaded")], "id string, status string")
    moves = spark.createDataFrame([("1", 2, "failed"), ("1", 1, "completed")], "id string, changed_at int, status string")
    assert sorted(tuple(r) for r in sinks.upsert_status(subs, moves, ["status"]).collect()) == [("1", "failed"), ("2", "uploaded")]


def test_erasure(spark):
    child = spark.createDataFrame([("1",), ("2",)], "submission_id string")
    gone = spark.createDataFrame([("1",)], "id string")
    assert [r[0] for r in R.cascade_delete(child, gone).collect()] == ["2"]
    assert [r[0] for r in R.orphans(child, gone).collect()] == ["2"]


def test_masking(spark):
    text = (
        "Patient Name: John Smith\nDate of Birth: 15-05-1990\nEmail: john.smith@hospital.com, again john.smith@hospital.com and x@y.org\n"
        "Phone: +91-98765-43210\nAadhaar: 1234 5678 9012\nPAN: ABCDE1234F\n"
    )
    df = spark.createDataFrame([(text,)], "text string")
    row = Y.anonymize(df).first()
    assert row.safe_for_regulatory_review
    for secret in ("John Smith", "15-05-1990", "john.smith", "98765", "5678", "ABCDE"):
        assert secret not in row.anonymized
    assert "Date of Birth: [DATE-REMOVED]" in row.anonymized and "Patient Name: [PII-REMOVED]" in row.anonymized
    tagged = df.select(Y.pseudonymize(F.col("text"))).first()[0]
    assert "Email: [EMAIL_1], again [EMAIL_1] and [EMAIL_2]" in tagged
    assert "Aadhaar: [AADHAAR_1]" in tagged and "Patient Name: [PERSON_1]" in tagged
    counts = Y.count_pii(df).first()
    assert (counts.n_email, counts.n_aadhaar, counts.n_phone, counts.n_pan, counts.n_date) == (3, 1, 1, 1, 1)


def test_k_anonymity(spark):
    rows = [("a", "x", i) for i in range(6)] + [("b", "y", i) for i in range(2)] + [(None, "x", 9)]
    df = spark.createDataFrame(rows, "q string, s string, i int")
    r = Y.k_anonymity(df, ["q"]).first()
    assert (r.classes, r.k_value, r.classes_below_k, r.rows_below_k, r.status) == (3, 1, 2, 3, "FAIL")
    kept = Y.suppress_small_classes(df, ["q"])
    assert kept.filter("suppressed").count() == 3 and kept.filter("q = 'a'").count() == 6
    t = {x.q: x.t_value for x in Y.t_closeness(df, ["q"], "s").collect()}
    assert abs(t["b"] - 7 / 9) < 1e-9


def test_tokens(spark):
    key = F.lit("0123456789abcdef0123456789abcdef")
    df = spark.createDataFrame([("1", "Raj"), ("1", "Raj"), ("2", "Raj")], "submission_id string, name string")
    tokens = Y.tokenize(df, "name", "PERSON", "s", key)
    assert tokens.count() == 2 and tokens.select("token").distinct().count() == 1
    assert {r.value for r in Y.reveal(tokens, key).collect()} == {"Raj"}
    purged = Y.purge_tokens(tokens, spark.createDataFrame([("1",)], "id string"), "asked", NOW)
    assert R.purged(purged).count() == 1
    assert {r.submission_id: r.value for r in Y.reveal(purged, key).collect()} == {"1": None, "2": "Raj"}


def test_text_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    body = "Drug Name: Aspirin {i}\nPatient Age: 4{i}\nAdverse Reaction: Severe rash\nOnset Date: 01-02-2026\nReporter Name: Dr. Smith\nReport Date: 02-02-2026\n" + "notes " * 20
    for i in range(4):
        (landing / f"r{i}.txt").write_text(body.format(i=i))
    stream = intake.checked_reports(intake.text_stream(spark, str(landing), max_files=2))
    columns = ["doc_id", "drug_name", "patient_age", "onset_date", "overall_status"]
    got = drain(spark, stream.select(*columns), "test")
    batch = documents.whole_texts(spark, str(landing)).select(F.sha2("path", 256).alias("doc_id"), "text")
    want = intake.checked_reports(batch).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.overall_status for r in got.collect()} == {"PASS"}


def test_restarted_sink_writes_once(spark, tmp_path):
    src = tmp_path / "src"
    spark.range(10).write.parquet(str(src))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        finish(append_to(spark.readStream.schema("id long").parquet(str(src)), out, ck))
    assert spark.read.parquet(out).count() == 10


def test_streamed_changes_look_up_their_own_keys(spark, tmp_path):
    table = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, status string")
    spark.createDataFrame([("1", "a"), ("2", "x"), ("9", "n")], "id string, status string").write.parquet(str(tmp_path / "src"))
    arriving = spark.readStream.schema("id string, status string").parquet(str(tmp_path / "src"))
    finish(changes.streamed_changes(table, arriving, "t", str(tmp_path / "out"), str(tmp_path / "ck")))
    rows = spark.read.parquet(str(tmp_path / "out/batch=*")).collect()
    assert {(r.action, r.entity_id) for r in rows} == {("UPDATE", "2"), ("INSERT", "9")}
    assert {r.action for r in changes.snapshot_changes(table, arriving_rows(spark), "t", NOW, operations=("DELETE",)).collect()} == {"DELETE"}


def arriving_rows(spark):
    return spark.createDataFrame([("1", "a")], "id string, status string")


def test_expired_rows_and_stored_tables(spark, tmp_path):
    spark.range(3).write.orc(str(tmp_path / "t"))
    assert documents.table(spark, str(tmp_path / "t"), "orc").count() == 3


def _side(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, n long")


def test_only_ranges_that_differ_are_compared(spark):
    old = [(f"k{i}", "x", i if i % 3 else None) for i in range(2000)]
    new = [r for r in old if r[0] not in ("k5", "k1500")] + [("new", None, 1), (None, "no key", 1)]
    new[7] = ("k8", "y", new[7][2])
    a, b = _side(spark, old + [(None, "no key", 1)]), _side(spark, new).repartition(3)
    ranges = changes.differing_ranges(a, b).count()
    assert 1 <= ranges <= 4
    got = changes.range_changes(a, b, "t", NOW).select("action", "entity_id").collect()
    assert {tuple(r) for r in got} >= {("DELETE", "k5"), ("DELETE", "k1500"), ("INSERT", "new"), ("UPDATE", "k8")}
    assert {r["action"] for r in got if r["entity_id"] not in ("k5", "k1500", "new", "k8")} <= set()
    assert changes.range_changes(a, a.repartition(5), "t", NOW).count() == 0


def test_tombstones_delete_in_streams(spark, tmp_path):
    table = _side(spark, [("a", "x", 1), ("b", "x", 2), ("c", "x", 3)])
    rows = [("a", "x", 1, False), ("b", None, None, True), ("c", "y", 3, None), ("d", "z", 4, False), ("e", None, None, True)]
    spark.createDataFrame(rows, "id string, status string, n long, gone boolean").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, status string, n long, gone boolean").parquet(f"{tmp_path}/in")
    changes.streamed_changes(table, stream, "t", f"{tmp_path}/out", f"{tmp_path}/check", tombstone="gone").awaitTermination()
    got = {(r["action"], r["entity_id"], r["new_data"] is None) for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()}
    assert got == {("DELETE", "b", True), ("UPDATE", "c", False), ("INSERT", "d", False)}


def test_landed_files_equal_the_batch_form(spark, tmp_path):
    from test_extract import REPORT

    texts = {"one.pdf": REPORT, "two.doc": REPORT.replace("52", "61"), "short.pdf": "too short", "three.exe": REPORT + "more", "copy.pdf": REPORT}
    for name, text in texts.items():
        folder = tmp_path / "landing" / f"name={name}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_bytes(("\ufeff" if name == "two.doc" else "").encode() + text.encode() + b"\n")
    out = lambda df, name: sorted(map(str, drain(spark, df, name).collect()))
    parsed = intake.parsed_uploads(intake.landed_uploads(spark, f"{tmp_path}/landing"))
    rows = drain(spark, parsed.select("name", "reason", "status", "patient_age", "text"), "landed").collect()
    assert len(rows) == 4 and {r["text"] for r in rows} == set(texts.values())
    assert {(r["reason"], r["status"], r["patient_age"]) for r in rows} == {
        (None, "SUCCESS", "52"), (None, "SUCCESS", "61"), (None, "EXTRACTION_FAILED", None), ("File extension not allowed: exe", "SUCCESS", "52"),
    }
    checked = intake.checked_uploads(intake.landed_uploads(spark, f"{tmp_path}/landing")).select("patient_age", "overall_status", "completeness_score")
    batch = intake.checked_reports(spark.createDataFrame([(str(i), t) for i, t in enumerate([REPORT, texts["two.doc"], "too short"])], "doc_id string, text string"))
    assert out(checked, "checked") == sorted(map(str, batch.select("patient_age", "overall_status", "completeness_score").collect()))


def test_sql_functions(spark):
    from caselight.functions import registered

    assert set(registered.register(spark)) == set(registered.FUNCTIONS)
    registered.register(spark)
    (r,) = spark.sql("""SELECT edit_similarity('abcd', 'abce') AS s, edit_similarity('', '') AS none, edit_similarity(NULL, 'a') AS missing, normalized_text('  A-b  C ') AS t, match_confidence(0.96) AS c,
        narrative_score('Symptoms 2 days after; stopped drug, resolved') AS n, narrative_score(NULL) AS nothing, causality_probability(5) AS p, priority_level(9) AS level""").collect()
    assert (r.s, r.none, r.missing, r.t, r.c, r.n, r.nothing, r.p, r.level) == (0.75, 0.0, 0.0, "ab c", "HIGH", 4, 0, "Possible", "CRITICAL")
