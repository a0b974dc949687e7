"""Decontamination against a brute-force window search."""

import random
import re

import pytest

from caselight.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, size):
    words = WORD.findall(folded(text))
    hit, ids = set(), set()
    for key, item in items:
        other = WORD.findall(folded(item))
        grams = {tuple(other[i : i + size]) for i in range(max(1, len(other) - size + 1))} if other else set()
        for g in grams:
            for i in range(len(words) - len(g) + 1):
                if tuple(words[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    if key is not None:
                        ids.add(str(key))
    return len(words), hit, sorted(ids)


def material(seed=3):
    rng = random.Random(seed)
    vocab = ["Ab", "ab", "é", "É", "c1", "DD", "9", "ß", "x"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 10, 14, 25])))) for i in range(12)]
    items += [(None, "null key item here"), (50, None), (51, ""), (52, "... !!"), (12, items[3][1]), (10, items[3][1])]
    docs = []
    for i in range(60):
        words = rng.choices(vocab + ["zz", "qq", "und"], k=rng.randint(0, 40))
        if rng.random() < 0.5:
            _, t = rng.choice(items[:12])
            words[5:5] = [w.upper() if rng.random() < 0.3 and w.isascii() else w for w in t.split()]
        docs.append((i, "".join(w + rng.choice([" ", "\n", " - ", "_", ", "]) for w in words)))
    return items, docs + [(60, None), (61, ""), (62, "..."), (63, "null KEY item_here!"), (5, docs[5][1])]


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_against_brute_force(spark, limit):
    items, docs = material()
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, contamination string")
    got = d.contamination(df, b, limit=limit).collect()
    assert len(got) == len(docs)
    want = {}
    for i, t in docs:
        want[i] = brute(t, items, 10)
    for r in got:
        n, hit, ids = want[r["doc_id"]]
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["items"]) == (n, len(hit), ids), r["doc_id"]
        text = r["text"] or ""
        spans = [(s["start"], s["end"]) for s in c["spans"]]
        inside = [m.span() for m in WORD.finditer(folded(text))]
        assert {i for i, (a, z) in enumerate(inside) if any(x <= a and z <= y for x, y in spans)} == hit
        assert all(any(x == a for a, _ in inside) and any(y == z for _, z in inside) for x, y in spans)


def test_long_text_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    filler = "word " * 400000
    df = spark.createDataFrame([(1, filler + "ONE two-three four five six seven eight nine ten. eleven " + filler)], "doc_id long, text string")
    c = d.contamination(df, items).first()["contamination"]
    assert (c["n_words"], c["n_hit"], c["items"]) == (800011, 11, ["1"])
    assert [tuple(s) for s in c["spans"]] == [(len(filler), len(filler) + 56)]
    assert d.contamination(df.limit(0), items).collect() == []
    clean = d.contamination(df, items.limit(0)).first()["contamination"]
    assert (clean["n_words"], clean["n_hit"], clean["items"]) == (800011, 0, [])


def test_a_column_named_like_one_used_on_the_way_stays(spark):
    docs = spark.createDataFrame([(1, "one two three", "a"), (2, None, None)], "doc_id long, text string, __hits string")
    tests = spark.createDataFrame([("i", "two three"), ("j", "nothing")], "item_id string, text string")
    for limit in (1 << 24, 4):
        got = {r["doc_id"]: (r["__hits"], r["c"]["n_hit"]) for r in d.contamination(docs, tests, column="c", limit=limit).collect()}
        assert got == {1: ("a", 2), 2: (None, 0)}
