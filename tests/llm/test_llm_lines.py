"""Line deduplication against plain code, minimal perfect hashes against dictionaries."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import lines
from caselight.llm.queries import op11_line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(rows, chars=lines.CHARS, least=lines.LEAST):
    holders = {}
    for i, t in rows:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holders.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        gone = lambda k: len(holders.get(k, ())) >= least and (known := [x for x in holders[k] if x is not None]) and max(known) != i
        kept = [x for x in parts if not gone(key_of(x))]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def planted(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["alpha", "béta", "GAMMA", "δέλτα", "x", "-"]) for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    pool += ["", " ", "x" * 19, "x" * 20, "é" * 19, "é" * 20, "😀" * 20, "a line that nearly everybody holds", " " + "y" * 25, "y" * 25]
    texts = [None, "", "\n", "\n\n", "A line that nearly everybody HOLDS", "\r\n".join(pool)]
    for _ in range(150):
        some = [rng.choice(pool) for _ in range(rng.randrange(0, 9))] + ["a line that nearly everybody holds"] * (rng.random() < 0.8)
        rng.shuffle(some)
        texts.append("\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " ", "\r"]) for x in some))
    texts.append("\n".join(f"line number {i} of a very long text" for i in range(30000)))
    ids = rng.sample(range(-500, 5000), len(texts))
    rows = list(zip(ids, texts)) + [(None, texts[20]), (None, "only rows without an id hold this\n" + "z" * 30)] + [(None, "only rows without an id hold this")] * 3
    return rows + [(ids[30], texts[30])] * 4 + [(ids[31], "another text under a used id\n" + "y" * 25)]


@pytest.mark.parametrize("common,size", [(lines.COMMON, lines.SHARD), (0, 4), (3, 50)])
def test_against_plain_code(spark, common, size):
    rows = planted(common + 1)
    frame = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], "doc_id long, text string, key string, lines string, own string, deduplicated string").repartition(7)
    found = lines.without_repeats(frame, common=common, size=size)
    assert found.columns == ["doc_id", "text", "key", "lines", "own", "deduplicated"]
    got = [(r["doc_id"], *r["deduplicated"]) for r in found.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=order) == sorted(plain(rows), key=order)
    assert {tuple(r) for r in found.select("key", "lines", "own").distinct().collect()} == {("a", "b", "c")}


def test_query_on_planted_folder(spark, tmp_path):
    rows = planted(9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_line_dedup(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in plain(rows)]
    assert sorted(map(tuple, found.collect()), key=order) == sorted(want, key=order)


def test_other_id_types_and_no_rows(spark):
    rows = [("a", "x" * 30), ("b", "x" * 30 + "\nshort"), ("c", "X" * 30)]
    got = lines.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "deduplicated.*").collect()
    assert sorted(map(tuple, got)) == [("a", "", 1, 1), ("b", "short", 2, 1), ("c", "X" * 30, 1, 0)]
    assert lines.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_an_index_serves_other_documents(spark):
    line = "a line that was counted in other texts"
    counts = lines.line_counts(spark.createDataFrame([(i, line) for i in range(5)], "doc_id long, text string"))
    other = spark.createDataFrame([(1, line + "\n" + "never seen before, but long enough"), (2, "nothing here that was counted")], "key long, text string")
    for common in (0, 10):
        (got,) = lines.repeated_lines(other, "key", "text", counts, common=common).collect()
        assert got["key"] == 1 and len(got["lines"]) == 1 and got["lines"][0]["top"] == 4


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**64, (2, n), dtype=np.uint64)
    h1[: n // 2] = h1[0] if n else 0  # hashes that differ in their second half only
    counts = rng.integers(1, 1000, n)
    shard = lines.build(h1, h2, counts, pa.array(np.arange(n) * 7))
    slot = shard.slots(h1, h2)
    assert sorted(slot.tolist()) == list(range(n))
    assert (shard.counts[slot] == counts).all() and (shard.tops.to_numpy(zero_copy_only=False)[slot] == np.arange(n) * 7).all()
    assert sum(shard.levels) <= 6 * n + 64 * len(shard.levels)
    f1, f2 = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    assert (shard.slots(f1, f2) == -1).all()
