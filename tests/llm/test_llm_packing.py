"""Packing: round trips, token ids, and bin counts against exact search."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from caselight.llm import packing as p


def check_plan(counts, plan, capacity):
    used = Counter()
    for bins, filling in plan:
        assert bins > 0 and sum(filling) <= capacity
        for x in filling:
            used[x] += bins
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(b for b, _ in plan)


def fewest(sizes, capacity):
    sizes = tuple(sorted(sizes, reverse=True))

    @lru_cache(None)
    def solve(left):
        if not left:
            return 0
        best, first, rest = len(left), left[0], left[1:]

        def fill(i, room, chosen):
            nonlocal best
            other = tuple(x for j, x in enumerate(rest) if j not in chosen)
            best = min(best, 1 + solve(other))
            for j in range(i, len(rest)):
                if rest[j] <= room and j not in chosen:
                    fill(j + 1, room - rest[j], chosen | {j})

        fill(0, capacity - first, frozenset())
        return best

    return solve(sizes)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_optimal_on_small_instances(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 31])
    sizes = [rng.randint(1, capacity - 1) for _ in range(rng.randint(1, 9))]
    counts = Counter(sizes)
    assert check_plan(counts, p.plan(dict(counts), capacity), capacity) == fewest(sizes, capacity)


@pytest.mark.parametrize("seed", range(4))
def test_plan_meets_the_lower_bound_on_large_instances(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(n) for x, n in enumerate(rng.integers(0, 2000, 1024)) if x and n}
    bins = check_plan(counts, p.plan(counts), 1024)
    assert bins <= min(p.lower_bound(counts, 1024) * 1.003, sum(b for b, _ in p.best_fit(counts, 1024)))


def test_plan_of_small_pieces_and_of_one_length():
    assert check_plan({1: 5000}, p.plan({1: 5000}), 1024) == 5
    assert check_plan({600: 7}, p.plan({600: 7}), 1024) == 7
    assert check_plan({512: 7, 3: 1}, p.plan({512: 7, 3: 1}), 1024) == 4
    assert p.plan({}) == []


def test_bounds_never_exceed_the_optimum():
    for seed in range(60):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 19) for _ in range(rng.randint(1, 8))]
        assert p.lower_bound(Counter(sizes), 20) <= fewest(sizes, 20) <= sum(b for b, _ in p.best_fit(Counter(sizes), 20))


def test_cut():
    assert p.cut(1, 4) == [(0, 1)]
    assert p.cut(4, 4) == [(0, 4)]
    assert p.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert p.cut(8, 4) == [(0, 4), (4, 4)]


TEXTS = [None, "", "a", "<|endoftext|> x", " " * 5000, "Hello, wörld! " * 700, "日本語 \U0001f600 'S 'll\r\n\t x" * 40, "1234567890" * 300, "é" * 3000]


def reference_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_ids_equal_the_tokenizer_file(spark, small):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    encode = p.encoder(p.vocabulary())
    assert encode("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    assert [[*encode(t or ""), 2] for t in texts] == reference_ids(texts)


def test_ids_of_very_long_blank_runs_equal_the_tokenizer_file(spark):
    texts = [" " * 2_000_000, "a b" + "\n" * 1_200_000 + " c", "x" + "\u3000 " * 600_000 + "y <|endoftext|>", " " * 99_999 + "z", "q" + "\t" * 100_000]
    want = reference_ids(texts)
    encode = p.encoder(p.vocabulary())
    assert [[*encode(t), 2] for t in texts] == want
    got = p.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    crcs = {(i, n): zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes()) for i, ids in enumerate(want) for n, (s, length) in enumerate(p.cut(len(ids), 1024))}
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got} == crcs


def test_pack_round_trip(spark, small):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (3, TEXTS[3], "x"), (3, TEXTS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(5)
    got = p.pack(df).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for (i, _, _), ids in zip(rows, reference_ids([t for _, t, _ in rows])):
        for n, (s, length) in enumerate(p.cut(len(ids), 1024)):
            want[i, n, s, length, zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    full = sum(r["length"] for r in got)
    assert len(bins) <= -(-full // 1024) + 3


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_tokenizer_file_is_loaded_for_the_texts_that_need_it_only(monkeypatch):
    path, loaded, load = p.vocabulary(), [], p.tokenizer_file
    whole = load(path)
    assert sorted(p.added_tokens(path)) == sorted(x.content for x in whole.get_added_tokens_decoder().values())
    monkeypatch.setattr(p, "tokenizer_file", lambda at: loaded.append(at) or load(at))
    encode = p.encoder(path)
    assert encode("plain text") == whole.encode("plain text", add_special_tokens=False).ids and not loaded
    for text in (f"a{p.added_tokens(path)[0]}b",) * 2:
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
    assert loaded == [path]
