"""Language identification: held-out accuracy and odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselight.llm import langid
from caselight.llm.common import remainder

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = remainder(F.col("doc_id"), 5) == 0
    model = langid.learn(docs.where(~held))
    assert set(model) == {"de", "en", "es", "fr"} and all(len(v) <= langid.DICTIONARY + 300 for v in model.values())
    found = langid.identify(docs.where(held), model)
    right, n, accepted = found.select(F.sum((F.col("language.lang") == F.col("lang")).cast("int")), F.count("*"), F.sum(F.col("language.accepted").cast("int"))).first()
    assert right / n > 0.95 and accepted / n > 0.95


def test_odd_rows(spark):
    model = {"de": langid.dictionary({b"der": 3, b"und": 2, b"nicht": 1}), "en": langid.dictionary({b"the": 3, b"and": 2, b"not": 1})}
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !! \n", "x"), (4, "the and not the", "x"), (4, "the and not the", "x"), (None, "der und nicht", "x"), (6, "qqq", "x"), (7, "not the and " * 90000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string")
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["language"] for r in got}
    assert [by[i]["lang"] for i in (1, 2, 3)] == ["und"] * 3 and not any(by[i]["accepted"] for i in (1, 2, 3))
    assert by[4]["lang"] == "en" and by[None]["lang"] == "de" and by[7]["lang"] == "en"
    assert by[6]["lang"] == "de" and not by[6]["accepted"]  # a tie
    assert all(0 <= r["language"]["score"] <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.learn(df) == {} and langid.learn(df.limit(0)) == {}
    assert [r["language"]["lang"] for r in langid.identify(df, {}).collect()] == ["und", "und"]
    assert langid.identify(df.limit(0), {}).collect() == []


def test_one_language(spark):
    df = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    row = langid.identify(df, langid.learn(df)).first()["language"]
    assert (row["lang"], row["score"], row["accepted"]) == ("en", 1.0, True)


@pytest.mark.parametrize("text", [None, "", " \n", "²", "½ 12", "Ⅷ", "①", "_ 1 .", "\u0301", "１２"])
def test_texts_without_a_letter_are_undetermined(text):
    model = {"en": langid.dictionary(Counter([b"the", b"and"] * 50)), "fr": langid.dictionary(Counter([b"les", b"des"] * 50))}
    assert langid.classify(text, list(model), langid.compressors(model)) == ("und", 0.0, 0.0, False)
    assert langid.classify("ª the", list(model), langid.compressors(model))[0] == "en"
