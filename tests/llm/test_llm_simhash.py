"""SimHash near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash

from caselight.llm import simhash

RNG = np.random.default_rng(5)


def planted(n=3000, groups=30, most=6):
    """Random fingerprints and groups whose members lie a few bits from a centre."""
    out = [RNG.integers(0, 2**64, n, dtype=np.uint64)]
    for _ in range(groups):
        centre = RNG.integers(0, 2**64, dtype=np.uint64)
        for _ in range(12):
            flips = RNG.choice(64, RNG.integers(0, most), replace=False)
            out.append(np.array([centre ^ np.uint64(sum(1 << int(f) for f in flips))], np.uint64))
    return np.unique(np.concatenate(out))


def brute_links(fps, radius):
    found = set()
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)
        found |= {(i, i + 1 + int(j)) for j in near}
    return found


def brute_components(ids, fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(fps))]


def test_compare_finds_exactly_the_pairs_within_the_radius():
    fps = planted(700)
    want = brute_links(fps, 4)
    got = set()
    for q, m in simhash.compare(fps, fps, np.arange(len(fps)) + 1, np.full(len(fps), len(fps)), 4):
        got |= set(zip(q.tolist(), m.tolist()))
    assert got == want and len(want) > 300


@pytest.mark.parametrize("radius", [1, 2, 3, 7])
def test_compare_with_other_radii(radius):
    fps = planted(200, 10, 9)
    got = {(int(a), int(b)) for q, m in simhash.compare(fps, fps, np.arange(len(fps)) + 1, np.full(len(fps), len(fps)), radius) for a, b in zip(q, m)}
    assert got == brute_links(fps, radius)


def test_blocks_share_bits_with_every_link():
    masks = simhash.blocks(4)
    assert len(masks) == 15
    for _ in range(300):
        flips = sum(1 << int(f) for f in RNG.choice(64, 4, replace=False))
        assert any(int(m) & flips == 0 for m in masks)


def reference_fingerprint(text):
    words = []
    word = ""
    for c in (text or "") + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A b C d e É é x", "x " * 50, "a\x0bb\x0cc\x1cd\x85e f", "w%d " * 9 % tuple(range(9))])
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text) == reference_fingerprint(text)


def test_components_against_brute_force(spark):
    base = [" ".join(f"w{RNG.integers(0, 60)}" for _ in range(80)) for _ in range(25)]
    texts = [None, "", "one", "One", "one"]
    for t in base:
        texts.append(t)
        for _ in range(4):
            words = t.split()
            for k in RNG.integers(0, 80, RNG.integers(0, 4)):
                words[k] = "changed"
            texts.append(" ".join(words))
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    ids = [None if i == 7 else int(i) for i in ids]
    rows = list(zip(ids, texts, ["x"] * len(ids), [1] * len(ids)))
    df = spark.createDataFrame(rows + [rows[5]], "doc_id long, text string, fp string, component int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    fps = [simhash.fingerprint(t) for t in texts]
    want = brute_components(ids, fps, 4)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = list(zip(ids, signed, want))
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected + [expected[5]], key=key)


def test_large_buckets_are_dealt_as_pairs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 8192)
    centre = int(RNG.integers(0, 2**62))
    fps = {centre} | {centre ^ (1 << i) ^ (1 << j) ^ (1 << k) for i in range(64) for j in range(i) for k in range(j)}
    fps = np.array(sorted(fps), np.uint64).view(np.int64)
    assert len(fps) > 3 * simhash.PART
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    roots = simhash.components(simhash.links(df))
    assert roots.count() == len(fps)
    assert roots.select("root").distinct().count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
