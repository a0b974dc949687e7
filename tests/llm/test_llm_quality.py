"""Quality classifier: features against plain code, trees against search, held-out accuracy, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselight.llm import quality
from caselight.llm.common import remainder

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    raw = (text or "").encode()
    words = raw.lower().split()
    lines = [x for x in re.split(rb"[\r\n]+", raw.lower()) if x]
    n, solid = len(raw), max(1, sum(c not in b" \t\n\r\x0b\x0c" for c in raw))
    some = lambda f: sum(1 for c in raw if f(c))
    alpha = some(lambda c: 65 <= c <= 90 or 97 <= c <= 122)
    w, ln = max(1, len(words)), max(1, len(lines))
    counts = Counter(raw)
    return [
        math.log1p(len(words)), solid * bool(words) / w, (alpha + some(lambda c: c >= 128)) / solid, some(lambda c: 65 <= c <= 90) / max(1, alpha), some(lambda c: 48 <= c <= 57) / solid,
        some(lambda c: c in b".,;:'\"()-") / solid, some(lambda c: c in b"#$%&*@+=<>[]{}\\^_`~/") / solid, some(lambda c: c == 124) / solid, some(lambda c: c in b"!?") / solid,
        some(lambda c: c >= 128) / solid, some(lambda c: c in b".!?") / w, math.log1p(len(words) / ln), math.log(max(1, len(set(words)))) / math.log(max(2, len(words))),
        max(Counter(words).values(), default=0) / w, (len(lines) - len(set(lines))) / ln, -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0,
        some(lambda c: c in b" \t\n\r\x0b\x0c") / max(1, n), math.log1p(max(map(len, words), default=0)),
    ]


TEXTS = [None, "", "a", " \n ", "The The the é", "One two\nOne two\n\nthree | four!! 12 #$%", "É\r\nx\x0by", "w " * 4000, "word", "line\nline\nline"]


def test_features_follow_their_definitions():
    assert np.allclose(quality.features(pa.array(TEXTS, pa.string())), [plain(t) for t in TEXTS])
    assert np.allclose(quality.features(pa.array(TEXTS[::-1], pa.string()))[::-1], [plain(t) for t in TEXTS])


def test_tree_takes_the_best_cut():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, w = rng.normal(size=9), rng.random(9) + 0.1
        loss = {}
        for at in range(1, 9):
            loss[at] = sum(g[s].sum() ** 2 / (w[s].sum() + quality.SHRINK) for s in (slice(0, at), slice(at, 9)))
        at = max(loss, key=loss.get)
        line = quality.tree(g, w, 2)
        assert np.allclose(line[:at], g[:at].sum() / (w[:at].sum() + quality.SHRINK)) and np.allclose(line[at:], g[at:].sum() / (w[at:].sum() + quality.SHRINK))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (2, 0) in [(i, j) for i, j, _ in model["pairs"]]
    assert ((quality.predict(model, x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("y", [[], [1.0], [0.0, 0.0]])
def test_without_both_labels(y):
    model = quality.fit(np.zeros((len(y), len(quality.FEATURES))), np.array(y))
    p = quality.predict(model, np.zeros((3, len(quality.FEATURES))))
    assert np.allclose(p, (sum(y) + 0.5) / (len(y) + 1))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    keep = remainder(F.col("doc_id"), 5) != 0
    found = quality.score(docs, quality.learn(docs, labels, keep)).join(labels.where(~keep), "doc_id").select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in found]) > 0.9


def test_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x"), (None, "word", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(3, 1), (3, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] == "word"}) == 1
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels.limit(0), F.lit(True))).collect() == []
