"""Toxicity network: inputs and windows against plain code, gradients against differences, held-out accuracy, odd rows."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from caselight.llm import toxicity as t
from caselight.llm.common import buffers, remainder

TEXTS = ["You clown, é!", None, "", "ab abc abcd abcde Abcdef x", "...", "a" * 50 + " \n" + "b", "last"]


def made(texts):
    return t.inputs(*buffers(pa.array(texts, pa.string())))


def test_words_and_their_sequences():
    found = made(TEXTS)
    words = [(d, w) for d, x in enumerate(TEXTS) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (x or "").encode())]
    assert found["doc"].tolist() == [d for d, _ in words]
    assert np.diff(found["offset"]).tolist() == [max(1, len(w) - 3) + 1 for _, w in words]
    again = made([" ".join(w.decode() for _, w in words).swapcase().replace("É", "é")])
    assert again["word"].tolist() == found["word"].tolist() and again["grams"].tolist() == found["grams"].tolist()


def test_equal_sequences_share_buckets():
    a, b = made(["xloserx"]), made(["loser"])
    assert set(b["grams"][1:].tolist()) <= set(a["grams"][1:].tolist())
    assert made(["abcdeX"])["grams"][0] == made(["abcdeYZ"])["grams"][0] != made(["abcdfX"])["grams"][0]
    assert made(["ab"])["grams"][1] == made(["ab cd"])["grams"][1] != made(["abc"])["grams"][1]


def test_windows_cover_every_word():
    for sizes in ([0], [1], [31, 32, 33, 0, 56, 57, 200], [5] * 4):
        doc = np.repeat(np.arange(len(sizes)), sizes)
        first, end, owner = t.windows(doc, len(sizes))
        covered = {i: set() for i in range(len(sizes))}
        for f, e, o in zip(first, end, owner):
            assert f < e <= f + t.WINDOW and (doc[f:e] == o).all()
            covered[o] |= set(range(f, e))
        assert [len(covered[i]) for i in range(len(sizes))] == sizes
        assert all(b - a == t.STRIDE for a, b, o, p in zip(first, first[1:], owner, owner[1:]) if o == p)


def test_passages_lie_whole_in_a_window_and_logits_are_those_of_the_network():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{rng.integers(0, 300)}" for _ in range(n)) for n in (1, 7, 31, 32, 33, 40, 41, 400)]
    words, model = made(texts), t.initial(4)
    first, end, owner = t.windows(words["doc"], len(texts))
    sizes = np.bincount(words["doc"])
    for i, n in enumerate(sizes):
        base = sizes[:i].sum()
        for a in range(base, base + max(1, n - 24)):
            assert any(f <= a and min(a + 25, base + n) <= e for f, e, o in zip(first, end, owner) if o == i)
    at = first[:, None] + np.arange(t.WINDOW)
    x = t.embedded(model, words["word"], words["grams"], words["offset"])
    plain = t.forward(model, x, np.minimum(at, len(x) - 1), at < end[:, None])[0]
    assert np.allclose(t.window_logits(model, words, first, end), plain, atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(3)
    model = {k: v.astype(np.float64) for k, v in t.initial(2).items()}
    words = made(["some words here and there", "a few more of them, and yet more words to read"])
    first, end, _ = t.windows(words["doc"], 2)
    table, at, mask = t._picked(words, first, end)
    y = np.array([1.0, 0.0])
    _, grad = t.gradients(model, table, at, mask, y)
    for k, v in model.items():
        places = [tuple(rng.integers(0, s) for s in v.shape) for _ in range(4)]
        if k in ("words", "grams"):
            places = [(int(table["word" if k == "words" else "grams"][i]), int(rng.integers(0, 8))) for i in range(4)]
        for p in places:
            old, eps = v[p], 1e-5
            v[p] = old + eps
            up = t.gradients(model, table, at, mask, y)[0]
            v[p] = old - eps
            down = t.gradients(model, table, at, mask, y)[0]
            v[p] = old
            assert abs((up - down) / (2 * eps) - grad[k][p]) < 1e-6, k


def test_padding_does_not_matter():
    model = t.initial()
    logit = t.document_logits(model, pa.array(["short text", "short text", "word " * 100]))
    assert logit[0] == logit[1]
    words = made(["short text"])
    x = t.embedded(model, words["word"], words["grams"], words["offset"])
    exact = t.forward(model, x, np.array([[0, 1]]), np.ones((1, 2), bool))[0]
    assert np.allclose(exact, logit[0], atol=1e-5)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    keep = remainder(F.col("doc_id"), 4) != 2
    model = t.learn(docs, labels, keep)
    found = t.score(docs, model).join(labels.where(~keep), "doc_id").select("score", "toxic").toPandas()
    toxic = found[found.toxic == 1].score
    clean = found[found.toxic == 0].score
    assert (toxic >= 0.3).mean() > 0.8 and (clean >= 0.3).mean() < 0.02


def test_odd_rows(spark):
    rows = [(i, x, "x") for i, x in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, "last", "x"), (50, "word " * 300000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({"__id": F.lit("x"), "__y": F.lit(1)})
    labels = spark.createDataFrame([(0, 1), (3, 0), (5, 0), (1, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    got = t.score(docs, t.learn(docs, labels, F.lit(True))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] == "last"}) == 1
    one = t.learn(docs, labels.where("toxic = 1"), F.lit(True))
    assert {round(r["score"], 6) for r in t.score(docs, one).collect()} == {round(2.5 / 3, 6)}
    assert t.score(docs.limit(0), t.learn(docs.limit(0), labels.limit(0), F.lit(True))).collect() == []
