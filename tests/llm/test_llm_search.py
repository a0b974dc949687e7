"""Ranked lexical search against scores of every document and item."""

import math
import random
import re

import pytest

from caselight.llm import search
from caselight.llm.queries import op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    found = [(i, terms(t)) for i, t in docs]
    n_docs = sum(bool(w) for _, w in found)
    length = sum(len(w) for _, w in found)
    df = {}
    for _, w in found:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in found:
            if not w:
                continue
            m = 100 - 90 + (90 * len(w) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in set(terms(text)) & set(w))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Énigme", "ñu", "ÀB", "İx", "x_y", "don't", "42"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [None, "", "...", "w1", "W1 w1", *(text(rng.randrange(1, 40)) for _ in range(200)), text(5000)]
    docs = list(zip(rng.sample(range(-100, 9000), len(texts)), texts))
    docs += [docs[8]] * 3 + [(None, texts[9]), (None, texts[9]), (docs[3][0], "another w2 text under a used id")] + [(10000 + i, "w3 w4 tie") for i in range(15)]
    items = [(1, "w1 w2 w1"), (2, None), (3, ""), (4, "nothing that any document holds"), (None, "w5"), (5, "énigme ÉNIGME w7"), (6, "w3 tie"), (6, "w3 tie"), (7, " ".join(vocabulary)), (8, "42 x y don t")]
    return docs, items


def order(r):
    return [(x is None, x or 0) for x in r]


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "a", 0) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(5), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [search.INDEX, 150])
def test_against_scores_of_all(spark, limit):
    docs, items = planted(limit)
    got = search.ranked(*frames(spark, docs, items), limit=limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(plain(docs, items), key=order)


def test_text_in_parts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 7)
    raw = ("abc " * 50 + "Abcdefghijklmnop" + " é" * 9).encode()
    assert [t.decode() for part in search.terms(raw) for t in part] == terms(raw.decode())
    heaps = search.Heaps(1, 2)
    import numpy as np
    for ids, scores in (([5, 4, None], [7, 7, 9]), ([3], [7]), ([9, 1], [0, 8])):
        heaps.add(ids, np.array(scores)[:, None])
    assert sorted(heaps.rows[0], reverse=True) == [(9, False, 0), (8, True, -1)]


def test_query_on_planted_folder(spark, tmp_path):
    docs, items = planted(3)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op12_lexical_search(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=order) == sorted(plain(docs, items), key=order)


def test_empty_tables(spark):
    docs, items = planted(4)
    assert search.ranked(*frames(spark, [], items)).collect() == []
    assert search.ranked(*frames(spark, docs, [])).collect() == []
    assert search.ranked(*frames(spark, [(1, None)], items)).collect() == []
