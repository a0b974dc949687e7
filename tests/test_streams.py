"""Streams that keep tables of their own, with many rows of one key in shuffled order."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselight.plans import load_catalog
from caselight.streaming import keyed, state, toplists
from caselight.streaming.intake import table_stream
from caselight.streaming.sinks import append_to, current, drain, finish, write_batches


def _files(spark, tmp_path, rows, schema, parts):
    """Rows as parquet files that arrive one after the other, one per micro-batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        [f] = list((tmp_path / f"in{i}").glob("part-*"))
        (tmp_path / "src").mkdir(exist_ok=True)
        f.rename(tmp_path / "src" / f"{i}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "src"))


def _pairs(spark, stream, path, **options):
    keep = {k: v for k, v in options.items() if k == "keep_days"}
    finish(state.same_day_pairs(stream, f"{path}/out", f"{path}/check", **options))
    finish(state.same_day_pairs_across(spark, f"{path}/out", f"{path}/check_across", **keep))
    return sorted((r.submission_1_id, r.submission_2_id, r.drug_count_diff) for r in state.written_pairs(spark, f"{path}/out").collect())


_FILING = "pos long, id string, applicant_name string, created_date string, drug_count int"


@pytest.mark.parametrize("batches", [1, 4])
def test_same_day_pairs_of_a_hot_applicant(spark, tmp_path, batches):
    rows = [(i, f"s{i}", "Dr. A" if i % 2 else "dr a", "2024-01-05", i % 7) for i in range(30000)]
    parts = [list(range(k * 30000 // batches, (k + 1) * 30000 // batches)) for k in range(batches)]
    for part in parts:
        random.Random(1).shuffle(part)
    got = _pairs(spark, _files(spark, tmp_path, rows, _FILING, parts), tmp_path, bucket=1000)
    assert got == sorted((f"s{i}", f"s{i + 1}", abs(i % 7 - (i + 1) % 7)) for i in range(29999))


@pytest.mark.parametrize("cuts", [[], [7], [3, 5, 11, 40], list(range(5, 60, 5))])
def test_same_day_pairs_in_any_split(spark, tmp_path, cuts):
    rng = random.Random(6)
    rows = [(i, f"s{i}", rng.choice("ABC"), rng.choice(["2024-01-01", "2024-01-02", None, "odd"]), rng.randrange(9)) for i in range(60)]
    parts = [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, 60])]
    last, want = {}, []
    for r in rows:
        key = (r[2], r[3])
        if key in last:
            want.append((last[key][1], r[1], abs(last[key][4] - r[4])))
        last[key] = r
    assert _pairs(spark, _files(spark, tmp_path, rows, _FILING, parts), tmp_path) == sorted(want)


def test_same_day_pairs_across_batches_and_forgetting(spark, tmp_path):
    rows = [(0, "a", "X", "2024-01-01", 1), (1, "b", "X", "2024-01-01", 4), (2, "c", "Y", None, 0), (3, "d", "X", "2024-01-01", 9), (4, "e", "X", "2024-03-01", 0), (5, "f", "X", "2024-01-01", 0), (6, "g", "Y", None, 2)]
    stream = _files(spark, tmp_path, rows, _FILING, [[1, 0, 2], [3], [4], [6, 5]])
    assert _pairs(spark, stream, tmp_path, keep_days=10) == [("a", "b", 3), ("b", "d", 5), ("c", "g", 2)]


def test_state_is_cleared_by_timers_and_grows_with_batches_only(spark, tmp_path):
    """Days that are past leave the state store, and a batch updates the keys it holds, not all."""
    rows = [(i, f"s{i}", f"N{i % 50}", f"2024-{1 + i // 200:02d}-10", 1) for i in range(800)]
    stream = _files(spark, tmp_path, rows, _FILING, [range(0, 200), range(200, 400), range(400, 600), range(600, 610)])
    finish(state.same_day_pairs(stream, f"{tmp_path}/out", f"{tmp_path}/check", keep_days=10))
    rows = state.summaries(spark, f"{tmp_path}/out/ends", ["date_key", "applicant_key"], max_files=1)
    met = state.before_each_batch(rows, ["date_key", "applicant_key"], state._later, "10 days 12 hours")
    query = append_to(met, f"{tmp_path}/met", f"{tmp_path}/check_met")
    finish(query)
    kept = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    updated = [s.numRowsUpdated for p in query.recentProgress for s in p.stateOperators]
    assert max(kept) < 4 * 3 * 60 and kept[-1] <= 3 * 60  # a key has a value and its timer's rows
    assert sum(updated) < 4 * 160 * 3


def test_a_batch_that_is_written_again_counts_once(spark, tmp_path):
    frame = lambda n, ids: spark.createDataFrame([(i, f"v{n}{i}", False, False, None, None) for i in ids], "id string, value string, lost boolean, gone boolean, expires timestamp, seen timestamp")
    def run():
        met = keyed.before_each_batch(keyed.summaries(spark, f"{tmp_path}/in", ["id"]), ["id"], lambda old, new: f"{old or ''}+{new}")
        finish(append_to(met, f"{tmp_path}/met", f"{tmp_path}/check"))
        return sorted((r["id"], r["batch"], r["before"]) for r in spark.read.parquet(f"{tmp_path}/met").collect())

    frame(0, "ab").write.parquet(f"{tmp_path}/in/batch=0")
    assert run() == [("a", 0, None), ("b", 0, None)]
    frame(0, "ab").write.mode("overwrite").parquet(f"{tmp_path}/in/batch=0")
    frame(1, "bc").write.parquet(f"{tmp_path}/in/batch=1")
    assert run() == [("a", 0, None), ("b", 0, None), ("b", 1, "+v0b"), ("c", 1, None)]


def _steps(spark, stream, path):
    finish(state.stage_order_violations(stream, f"{path}/out", f"{path}/check"))
    finish(state.stage_order_violations_across(spark, f"{path}/out", f"{path}/check_across"))
    return sorted((r["id"], r["status"], r["changed_at"].timestamp()) for r in state.written_steps(spark, f"{path}/out").collect())


@pytest.mark.parametrize("cuts", [[], [15000], [1, 2000, 2001, 29000]])
def test_stage_order_of_a_hot_submission_in_any_split(spark, tmp_path, cuts):
    from caselight.schemas import PROCESSING_STAGES as S

    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choices([*S, "odd", None], [30, 20, 10, 5, 0.002, 0.0005, 3])[0], 1700000000 + i) for i in range(30000)]
    parts = [list(range(a, b)) for a, b in zip([0, *cuts], [*cuts, 30000])]
    for part in parts:
        rng.shuffle(part)
    stream = _files(spark, tmp_path, rows, "id string, status string, s long", parts).select("id", "status", F.timestamp_seconds("s").alias("changed_at"))
    want, reached = [], {}
    for i, status, s in rows:
        if i is not None and status is not None:
            rank = S.index(status) if status in S else len(S)
            if rank < reached.get(i, -1):
                want.append((i, status, float(s)))
            reached[i] = max(reached.get(i, -1), rank)
    assert _steps(spark, stream, tmp_path) == sorted(want)


def test_counts_include_open_windows_and_late_rows_are_counted(spark, tmp_path):
    rows = [("x", 0), ("x", 60), ("x", 7200), ("x", 10), ("x", 7300)]
    stream = _files(spark, tmp_path, rows, "event_type string, s long", [[0, 1], [2], [4], [3]]).select("event_type", F.timestamp_seconds("s").alias("ts"))
    counted = state.windowed_counts(stream, "ts", ["event_type"], "1 hour")
    assert finish(write_batches(counted, str(tmp_path / "out"), str(tmp_path / "check"))) == 1
    written = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out/batch=*"))
    got = {(r.window_start.minute, r.n) for r in current(written, ["window_start", "window_end", "event_type"]).collect()}
    assert got == {(0, 2)} and written.count() >= 2
    assert drain(spark, counted, "t", "update", ["window_start", "window_end", "event_type"]).agg(F.sum("n")).first()[0] == 4


def test_top_values_per_window_equal_a_full_count(spark, tmp_path):
    """A window with few common values and a long tail, one without any common value, one with fewer than k values."""
    rng = random.Random(3)
    tail = lambda: f"rare {rng.randrange(5000)}"
    rows = [(100, rng.choice(["a", " b", "c ", "d", "e", "f", tail()]) if rng.random() < 0.7 else tail()) for _ in range(9000)]
    rows += [(5000, tail()) for _ in range(6000)] + [(9000, rng.choice(["x", "y", " ", None])) for _ in range(50)] + [(None, "a")]
    rng.shuffle(rows)
    parts = [list(range(a, min(a + 4000, len(rows)))) for a in range(0, len(rows), 4000)]
    stream = _files(spark, tmp_path, rows, "s long, value string", parts).select("value", F.timestamp_seconds("s").alias("at"))
    finish(toplists.top_values_stream(stream, "at", "value", "1 hour", f"{tmp_path}/out", f"{tmp_path}/check"))
    want = []
    for w in (0, 3600, 7200):
        counts = Counter(v.strip() for s, v in rows if s is not None and w <= s < w + 3600 and v and v.strip())
        best = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:5]
        want += [(w, i, v, n) for i, (v, n) in enumerate(best, 1)]
    got = toplists.top_values_per_window(spark, f"{tmp_path}/out").collect()
    assert sorted((int(r["window_start"].timestamp()), r["rank"], r["value"], r["n"]) for r in got) == want


def test_a_table_that_is_a_folder_of_files_is_streamed(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).selectExpr("id AS event_id", "id % 7 AS user_id", "concat('t', id % 3) AS event_type", "timestamp_seconds(id) AS ts")
    rows.write.parquet(str(tmp_path / "many/events.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "many/others.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "one/events.parquet")
    for kind in ("many", "one"):
        stream = table_stream(spark, str(tmp_path / kind), "events.parquet", rows.schema)
        assert sorted(r[0] for r in drain(spark, stream.select("event_id"), "folder").collect()) == list(range(40))
        last = load_catalog()["st2_latest_status"](spark, str(tmp_path / kind)).collect()
        assert sorted(map(tuple, last)) == sorted((i % 7, f"t{i % 3}") for i in range(33, 40))


def test_landing_files_are_written_by_all_parts(spark, tmp_path):
    """One file is made for each document; with the table's own few parts few cores would write them."""
    import glob

    from caselight.plans import load_catalog
    from caselight.plans.bindings import PARTS
    from caselight.sources.staging import work_dir

    rows = [(i, f"Drug Name: D{i}\n" + "x" * 120, "en", "s", 140) for i in range(24)]
    rows += [(1, "second text under an id", "en", "s", 23)]  # goes to the same file, as before
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{work_dir(spark).removeprefix('file:')}/caselight-st1f-*"))
    spark.conf.set(PARTS, "4")
    try:
        out = load_catalog()["st1_landed_files"](spark, str(tmp_path))
        assert out.count() == 24
    finally:
        spark.conf.unset(PARTS)
    made = set(glob.glob(f"{work_dir(spark).removeprefix('file:')}/caselight-st1f-*")) - before
    parts = {f.rsplit("/", 1)[-1][:10] for d in made for f in glob.glob(f"{d}/landing/name=*/part-*")}
    assert len(parts) > 1
