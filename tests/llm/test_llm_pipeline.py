"""Every stage of the pipeline, and all of them, on a planted folder against what plain code expects."""

import random

import pytest

import corpus_pipeline as P
from caselight.llm import packing

EN = "the of and to in is that for it was on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
FR = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais pouvoir avec tout aller voir bien où sans tu ou leur homme si deux mari moi vouloir te femme venir quand grand celui notre jour même prendre rien petit encore aussi quelque dont fois donner main trouver arriver regarder appeler".split()
PASSAGE = "what colour is the sky on a clear day when nobody looks at it at all"


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(i, text(rng, EN if i % 2 else FR, 90), "en" if i % 2 else "fr") for i in range(60)]
    clean = {i for i, _, _ in rows}
    base = rows[1][1].split()
    near = " ".join([*base[:-2], "changed", "ending"])
    rows += [(100, rows[1][1], "en"), (101, near, "en"), (102, rows[7][1].upper(), "en")]  # copies of 1 and 7
    rows += [(200, text(rng, EN, 60) + " " + PASSAGE.upper() + " " + text(rng, EN, 60), "en"), (201, text(rng, EN, 70) + " " + " ".join(PASSAGE.split()[:9]), "en")]
    rows += [(300, text(rng, EN, 60) + " write to jane.doe@example.org now", "en")]
    rows += [(400, None, "en"), (401, "", None), (402, "1234 ½ ² -- 5", "en")]
    rows += [(3, text(rng, EN, 80), "en"), (5, rows[5][1], "en"), (None, text(rng, FR, 80), None)]  # a used id, a repeated row, no id
    folder = str(tmp_path_factory.mktemp("pipeline"))
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    frame.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, PASSAGE), (8, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, clean


def ids(frame):
    return sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


def test_stages_one_by_one(spark, planted):
    folder, rows, clean = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = P.identify_language(spark, docs, folder)
    assert told.columns == docs.columns
    stay = [i for i, t, _ in rows if t and any(map(str.isalpha, t))]
    assert ids(told) == sorted(stay, key=lambda i: (i is None, i or 0))
    single = P.drop_near_duplicates(spark, told, folder)
    assert single.columns == docs.columns
    left = sorted([*clean, 3, 200, 201, 300])
    assert ids(single) == [*left, None]
    fresh = P.drop_contaminated(spark, single, folder)
    assert fresh.columns == docs.columns and ids(fresh) == [*(i for i in left if i != 200), None]
    masked = P.mask_personal_data(spark, fresh, folder)
    assert masked.columns == docs.columns and ids(masked) == ids(fresh)
    before = {(r["doc_id"], r["text"]) for r in fresh.collect()}
    after = masked.collect()
    assert [r["doc_id"] for r in after if (r["doc_id"], r["text"]) not in before] == [300]
    (changed,) = [r for r in after if r["doc_id"] == 300]
    assert "jane.doe" not in changed["text"] and "write to" in changed["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_run_packs_what_the_stages_keep(spark, planted):
    folder, rows, clean = planted
    got = P.run(spark, folder).collect()
    kept = {i for i in clean if i != 3} | {3, 201, 300, None}
    assert {r["doc_id"] for r in got} == kept
    encode = packing.encoder(packing.vocabulary())
    by_id = {i: t for i, t, _ in rows if i in kept and i not in (3, 300)}
    lengths = {}
    for r in got:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert all(lengths[i] == len(encode(t)) + 1 for i, t in by_id.items())
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_documents(spark, planted, tmp_path):
    folder, _, _ = planted
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
