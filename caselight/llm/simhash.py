"""SimHash near-duplicates with a bit-sliced comparison.

A document's fingerprint is the majority of the bits of its shingles' hashes. Two fingerprints link if they differ in
at most ``radius`` bits. Candidates share the bits of all but ``radius`` of ``radius + 2`` blocks, which no link can
miss; a bucket of candidates is compared in bit planes, 64 fingerprints to a word, and components follow from
repeated minimum steps over the links.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import applied
from caselight.sources.shipping import ship
from caselight.sources.staging import stage

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Members of a bucket that one task compares; a larger bucket is dealt out as pairs of parts of this size.
PART = 8192
#: Query-word pairs compared at once.
CHUNK = 1 << 18
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text: lower-cased words, overlapping shingles, a bit set if in over half of the hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):  # a long text's bits a part at a time
        rows = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(rows, axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Add the fingerprint of every whole text as a signed long; null and wordless texts get 0."""

    def run(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t, shingle, seed) for t in texts.to_pylist()), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return docs.withColumn(column, applied(docs, run, "long", text))


# ---------------------------------------------------------------- bit-sliced comparison

def blocks(radius: int) -> list[np.uint64]:
    """Masks of the bits that pairs must share: all choices of 2 of ``radius + 2`` blocks."""
    edges = np.linspace(0, BITS, radius + 3).round().astype(int)
    parts = [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]
    return [np.uint64(a | b) for a, b in combinations(parts, 2)]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints: row b holds bit b of all of them, 64 to a word."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def compare(members: np.ndarray, queries: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = RADIUS):
    """Yield arrays (query number, member number) of pairs at most ``radius`` bits apart.

    Query i is compared with members[first[i]:last[i]]. The mismatches of 64 members are counted side by side in
    bitwise counters with carry-save additions; a word whose members have all passed the radius is abandoned.
    """
    planar = planes(members)
    digits = radius.bit_length()
    offset = (1 << digits) - 1 - radius  # a counter that starts here overflows at radius + 1
    words = np.where(last > first, (last + 63) // 64 - first // 64, 0)
    ends = np.cumsum(words)
    a = 0
    while a < len(queries):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        q = np.repeat(np.arange(a, b), words[a:b])
        before = np.repeat(ends[a:b] - words[a:b], words[a:b])
        w = np.repeat(first[a:b] // 64, words[a:b]) + (np.arange(len(q)) + (ends[a - 1] if a else 0) - before)
        low = np.clip(first[q] - w * 64, 0, 64)
        high = np.clip(last[q] - w * 64, 0, 64)
        alive = _mask(high) & ~_mask(low)
        counters = [np.full(len(q), _ALL if offset >> d & 1 else 0, np.uint64) for d in range(digits)]
        for bit in range(BITS):
            carry = planar[bit][w] ^ (np.uint64(0) - (queries[q] >> np.uint64(bit) & np.uint64(1)))
            for d in range(digits):
                counters[d], carry = counters[d] ^ carry, counters[d] & carry
            alive &= ~carry
            if bit % 8 == 7:
                keep = alive != 0
                if not keep.all():
                    q, w, alive = q[keep], w[keep], alive[keep]
                    counters = [c[keep] for c in counters]
                    if not len(q):
                        break
        if len(q):
            lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            yield q[row], w[row] * 64 + lane
        a = b


def _mask(n: np.ndarray) -> np.ndarray:
    """Words whose lowest n bits are set, n from 0 to 64."""
    full = n >= 64
    return np.where(full, _ALL, (np.uint64(1) << np.where(full, 0, n).astype(np.uint64)) - np.uint64(1))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member of its component) that join what the links a-b join."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


_LINKS = "a long, b long, task long, side int, fp long"


def _links(a, b) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none(pa.int64()), none(pa.int32()), none(pa.int64())], ["a", "b", "task", "side", "fp"])


def _parts(fps: np.ndarray, seed: int) -> pa.RecordBatch:
    """A large bucket as pairs of parts: every member of part i goes to the tasks (i, j) for all j."""
    part = np.arange(len(fps)) // PART
    n = int(part[-1]) + 1
    i, j = np.triu_indices(n)
    rng = np.random.default_rng(seed)
    number = rng.integers(-(2**62), 2**62, len(i))
    out: list[list[np.ndarray]] = [[], [], []]
    for k, (p, q) in enumerate(zip(i, j)):
        for side, which in ((0, p), (1, q)):
            chosen = fps[part == which]
            out[0].append(np.full(len(chosen), number[k]))
            out[1].append(np.full(len(chosen), side, np.int32))
            out[2].append(chosen.view(np.int64))
    task, side, fp = (np.concatenate(x) for x in out)
    none = pa.nulls(len(task), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, pa.array(task), pa.array(side), pa.array(fp)], ["a", "b", "task", "side", "fp"])


def _within(fps: np.ndarray, starts: np.ndarray, radius: int):
    """Links inside buckets that follow one another in ``fps``; a query looks only at later members of its bucket."""
    stop = np.append(starts[1:], len(fps))
    last = np.repeat(stop, stop - starts)
    for q, m in compare(fps, fps, np.arange(len(fps)) + 1, last, radius):
        yield forest(fps[q], fps[m])


def bucket_links(radius: int):
    """Task: rows sorted by (mask number, shared bits) in, links and parts of large buckets out."""
    masks = blocks(radius)

    def run(batches):
        held_table, held = np.zeros(0, np.int32), np.zeros(0, np.uint64)

        def flush(table, fps, end):
            """Compare all buckets but, unless at the end, the last, which may go on in the next batch."""
            key = fps & np.array(masks)[table]
            new = np.ones(len(fps), bool)
            new[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            if not end:
                cut = starts[-1]
                rest, starts = (table[cut:], fps[cut:]), starts[:-1]
                fps, table = fps[:cut], table[:cut]
            else:
                rest = (table[:0], fps[:0])
            stop = np.append(starts[1:], len(fps))
            size = stop - starts
            out = [_parts(fps[s:e], int(table[s]) * 1000003 + int(key[s] % np.uint64(1000003))) for s, e in zip(starts[size > PART], stop[size > PART])]
            small = np.repeat((size > 1) & (size <= PART), size)
            kept = fps[small]
            counts = size[(size > 1) & (size <= PART)]
            if len(kept):
                out += [_links(a, b) for a, b in _within(kept, np.cumsum(counts) - counts, radius) if len(a)]
            return out, rest

        for batch in batches:
            table = np.concatenate([held_table, batch.column("mask").to_numpy(zero_copy_only=False).astype(np.int32)])
            fps = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(fps):
                out, (held_table, held) = flush(table, fps, False)
                yield from out
        if len(held):
            yield from flush(held_table, held, True)[0]

    return run


def part_links(radius: int):
    """Task: rows sorted by (task, side) in, links between the two parts of each task out."""

    def run(batches):
        task, side, fps = (np.zeros(0, k) for k in (np.int64, np.int32, np.uint64))
        for batch in list_then_none(batches):
            if batch is not None:
                task = np.concatenate([task, batch.column("task").to_numpy(zero_copy_only=False)])
                side = np.concatenate([side, batch.column("side").to_numpy(zero_copy_only=False)])
                fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(task):
                continue
            done = len(task) if batch is None else int(np.flatnonzero(task == task[-1])[0])
            cuts = np.flatnonzero(np.append(True, task[1:done] != task[: done - 1])) if done else []
            for s, e in zip(cuts, np.append(cuts[1:], done)):
                left, right = fps[s:e][side[s:e] == 0], fps[s:e][side[s:e] == 1]
                if not len(left) or not len(right):
                    continue
                for q, m in compare(right, left, np.zeros(len(left), int), np.full(len(left), len(right)), radius):
                    a, b = left[q], right[m]
                    a, b = forest(a[a != b], b[a != b])
                    if len(a):
                        yield _links(a, b)
            task, side, fps = task[done:], side[done:], fps[done:]

    return run


def list_then_none(batches):
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between different fingerprints that join all that lie within ``radius`` of each other.

    ``distinct`` has one column ``fp`` without repeats. A bucket gives at most one link for each member and comparison, not all its pairs.
    """
    spark = distinct.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = [int(m.view(np.int64)) for m in blocks(radius)]
    keyed = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"), "fp")
    dealt = keyed.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key").select("mask", "fp")
    first = stage(dealt.mapInArrow(bucket_links(radius), _LINKS))
    large = first.where("task is not null").select("task", "side", "fp").repartition(parts, "task").sortWithinPartitions("task", "side")
    second = large.mapInArrow(part_links(radius), _LINKS)
    return first.where("a is not null").select("a", "b").unionByName(second.select("a", "b")).distinct()


# ---------------------------------------------------------------- components

def components(edges: DataFrame, stage: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """(fp, root): the smallest node reachable, for every node of the edges (a, b).

    Alternates two steps until nothing changes: each node links its larger neighbours to the smallest of its
    neighbourhood, then its smaller ones. Both reduce neighbourhoods to their minimum before joining, so no
    neighbourhood is gathered; each round is a written table, which ``stage`` writes.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stage(small.distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Return id, fp (signed long) and component (the smallest id reachable over links, itself included), a row per row.

    Null texts, and texts without a word, have fingerprint 0 and link like any other. Fewer words than a shingle make one
    shingle. Repeated rows share a component. A null id takes part and is passed over for the smallest; a component of nulls only
    is null. An empty table gives an empty one. Other columns are not read.
    """
    marked = stage(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("t")), "t").select("id", "fp"))
    lowest = stage(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(lowest.select("fp"), radius))
    joined = lowest.join(roots, "fp")
    best = joined.groupBy("root").agg(F.min("low").alias("component"))
    linked = joined.join(best, "root").select("fp", "component")
    # written, so that the join below deals both sides itself and Spark can split the rows of a common fingerprint
    final = stage(lowest.join(linked, "fp", "left").select("fp", F.coalesce("component", "low").alias("component")))
    return marked.join(final, "fp").select(F.col("id").alias(id), "fp", "component")
