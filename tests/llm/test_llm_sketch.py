"""Threshold-scaled fingerprints: definition, containment, next documents, odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from caselight.llm import sketch


def shingles(text):
    words, word = [], ""
    for c in text + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def made(seed, n, vocab=500):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, vocab)}é" for _ in range(n))


def test_equal_shingle_sets_have_equal_sketches_and_sizes_scale():
    texts = [made(i, n) for i, n in enumerate([1, 3, 5, 6, 40, 900, 5000])] + ["", None, " \n", "A b C d E f", "a  B\tc d\ne F"]
    found = sketch.sketches(pa.array(texts), 1)
    assert [len(f) for f in found] == [len(shingles(t or "")) for t in texts]
    assert (found[-1] == found[-2]).all()
    scaled = sketch.sketches(pa.array(texts), 8)
    for f, s in zip(found, scaled):
        assert s.tolist() == [h for i, h in enumerate(sorted(f.tolist())) if h < 2**61 or i < sketch.FLOOR]
    assert 450 < len(scaled[6]) < 800


def test_order_and_neighbours_in_a_batch_do_not_matter():
    texts = [made(i, 30) for i in range(50)] + ["", "x", ""]
    one = [sketch.sketches(pa.array([t]))[0].tolist() for t in texts]
    assert [s.tolist() for s in sketch.sketches(pa.array(texts))] == one
    assert [s.tolist() for s in sketch.sketches(pa.array(texts[::-1]))] == one[::-1]


def test_long_text_in_runs_equals_the_whole(monkeypatch):
    text = made(1, 3000) + "  " + "q" * 400 + "\n" + made(2, 3000)
    whole = sketch.sketches(pa.array([text]))[0].tolist()
    monkeypatch.setattr(sketch, "SLAB", 300)
    assert sketch.sketches(pa.array([text]))[0].tolist() == whole


def test_containment_of_unequal_documents_and_merging():
    small, large = made(3, 800, 10**6), made(4, 40000, 10**6)
    a, b, both = sketch.sketches(pa.array([small, large, large + " " + small]))
    assert sketch.containment(a, b) < 0.05 and sketch.containment(a, both) > 0.95
    union = sketch.merged(a, b)
    assert len(set(both.tolist()) ^ set(union.tolist())) <= 4
    assert sketch.containment(a, a) == 1 and sketch.containment(a, a[:0]) == 0 and sketch.containment(a[:0], a[:0]) == 1


def test_short_texts_are_compared_in_full():
    for n in (5, 9, 40, 200):
        for seed in range(20):
            text = made(seed, n, 10**6)
            cut = " ".join(text.split()[: n - n // 3])
            longer = made(seed + 100, 50, 10**6) + " " + text
            a, b, c = sketch.sketches(pa.array([text, cut, longer]))
            exact = len(shingles(text) & shingles(cut)) / min(len(shingles(text)), len(shingles(cut)))
            assert abs(sketch.containment(a, b) - exact) < 1e-9
            assert sketch.containment(a, c) == 1


def test_a_short_text_in_a_longer_one():
    lost = 0
    for seed in range(100):
        text, rest = made(seed, 14, 10**6), made(seed + 1000, 500, 10**6)
        a, b = sketch.sketches(pa.array([text, rest + " " + text]))
        got = sketch.containment(a, b)
        lost += got == 0
        assert got in (0, 1)
    assert lost <= 3


def test_merging_gives_the_fingerprint_of_the_union():
    for i, (m, n) in enumerate([(3, 9), (100, 170), (200, 3000), (4000, 2500), (0, 30), (0, 0)]):
        one, two = shingle_hash_set(made(i, m, 10**6)), shingle_hash_set(made(i + 50, n, 10**6))
        limit = 2**61 - 1
        rule = lambda h: [x for k, x in enumerate(sorted(h)) if x <= limit or k < sketch.FLOOR]
        union = sketch.merged(np.array(rule(one), np.uint64), np.array(rule(two), np.uint64))
        assert union.tolist() == rule(one | two)


def shingle_hash_set(text):
    return set(sketch.sketches(pa.array([text]), 1)[0].tolist())


def test_column_functions(spark):
    texts = [made(3, 800), made(3, 800) + " " + made(5, 400), made(3, 30), made(3, 9), "one word", made(9, 5000), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sketch.fingerprints(df).collect()
    own = sketch.sketches(pa.array(texts))
    assert [r["fingerprint"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [sketch.as_hex(s) for s in own]
    pairs = spark.createDataFrame([(sketch.as_hex(x), sketch.as_hex(y)) for x in own for y in own], "a string, b string")
    got = [r[0] for r in pairs.select(sketch.likeness(pairs["a"], pairs["b"])).collect()]
    assert np.allclose(got, [sketch.containment(x, y) for x in own for y in own])


def brute(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(ordered):
        t, other = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        m = len(t) // 3
        new = t[: len(t) - m] + other[:m]
        a, b, c = sketch.sketches(pa.array([t, new, other]))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), sketch.as_hex(a), sketch.as_hex(b), sketch.containment(a, b), sketch.containment(a, c)))
    return out


def test_compared_against_brute_force(spark):
    rng = random.Random(6)
    ids = rng.sample(range(-1000, 100000), 400)
    rows = [(i, made(i, rng.choice([0, 1, 4, 30, 200])) + rng.choice(["", "\U0001f600é"])) for i in ids]
    rows += [(None, "no id"), (None, None), (ids[3], rows[3][1]), (ids[3], rows[3][1]), (ids[4], "same id, other text"), (10**12, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(7)
    got = [tuple(r) for r in sketch.compared(df).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(7, "a b c d e f g h i")], "doc_id long, text string")
    assert [tuple(r) for r in sketch.compared(df).collect()] == brute([(7, "a b c d e f g h i")])
    assert sketch.compared(df.limit(0)).collect() == []
