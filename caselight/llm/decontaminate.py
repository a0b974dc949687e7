"""Benchmark decontamination with an Aho-Corasick automaton.

Windows of consecutive words of all benchmark items go into one automaton. A document is normalised once, scanned
once, and the words inside occurrences are mapped back to places in the original text.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import applied, cached, free
from caselight.sources.staging import stage

WINDOW = 10
#: Bytes of benchmark text that one automaton holds; a larger benchmark is scanned for in several passes.
AUTOMATON = 16 << 20

_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "struct<n_words:long,runs:array<struct<first:int,last:int>>,items:array<string>>"
RESULT = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<start:int,end:int>>>"


def normalised(text: str | None) -> str:
    """Words of a text, lower-cased in ASCII, each followed by a space and the first preceded by one; empty without words.

    A character stands for a byte, so that the automaton sees the UTF-8 form.
    """
    words = (text or "").encode().translate(_FOLD).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows(text: str | None, size: int = WINDOW) -> set[str]:
    """All runs of ``size`` words of an item; the whole item if it is shorter."""
    words = normalised(text).split(" ")[1:-1]
    return {f" {' '.join(words[i : i + size])} " for i in range(max(1, len(words) - size + 1))} if words else set()


def automaton(items: list[tuple[str | None, str]], size: int):
    """Automaton over the windows of (item id, text); a window's value is its word count and its items."""
    import ahocorasick

    owners: dict[str, list] = {}
    for key, text in items:
        for w in windows(text, size):
            owners.setdefault(w, []).append(key)
    if not owners:
        return None
    built = ahocorasick.Automaton()
    for w, keys in owners.items():
        built.add_word(w, (w.count(" ") - 1, tuple(k for k in keys if k is not None)))
    built.make_automaton()
    return built


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs [first, last) of words without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str | None, tree, runs=(), items=()) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Word count, hit runs of words and item ids of one text, added to those of earlier passes."""
    line = normalised(text)
    n = line.count(" ") - 1 if line else 0
    if tree is None or not n:
        return n, list(runs), list(items)
    found = list(tree.iter(line))
    if not found:
        return n, list(runs), list(items)
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]).tolist()
    return n, merged([*runs, *((b - k, b) for b, (_, (k, _)) in zip(last, found))]), sorted({*items, *(i for _, (_, owned) in found for i in owned)})


def places(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans in the original text of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", column: str = "contamination", size: int = WINDOW, limit: int = AUTOMATON) -> DataFrame:
    """Add a struct ``column``: n_words, n_hit (words inside any occurrence of a window), items (sorted ids), spans.

    Null and empty texts have no words, and items without words match nothing. An item's null id is left out of
    ``items``, its words still hit. Items with equal windows are all reported. The automaton is sent to the workers only up to ``limit`` bytes
    of benchmark text; a larger benchmark is split by item and scanned for in several passes, each a written table.
    An empty benchmark leaves every document clean. A column named like ``column`` is replaced, others stay.
    """
    tests = benchmark.select(F.col(item).cast("string").alias("k"), F.col(item_text).alias("t")).where("t is not null")
    total = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-total // limit))
    (hits,) = free(docs.withColumn(column, F.lit(None)), "__hits")
    out = docs.withColumn(hits, F.lit(None).cast(HITS))
    for p in range(passes):
        part = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("k", "t"), F.lit(passes)) == p)
        rows = [(r["k"], r["t"]) for r in part.toLocalIterator()]
        out = out.withColumn(hits, _scanned(out, rows, text, hits, size, with_spans=False)) if p < passes - 1 else out.withColumn(column, _scanned(out, rows, text, hits, size, with_spans=True))
        if p < passes - 1:
            out = stage(out)
    return out.drop(hits)


def _scanned(docs: DataFrame, rows: list, text: str, hits: str, size: int, with_spans: bool):
    sent, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    run_kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array, before: pa.Array) -> pa.Array:
        tree = cached(("decontaminate", key), lambda: automaton(sent.value, size))
        out = []
        for t, old in zip(texts.to_pylist(), before.to_pylist()):
            old = old or {"runs": [], "items": []}
            n, runs, items = scan(t, tree, [(r["first"], r["last"]) for r in old["runs"]], old["items"])
            out.append((n, sum(b - a for a, b in runs), items, places(t, runs)) if with_spans else (n, [{"first": a, "last": b} for a, b in runs], items))
        items = pa.array([r[2] for r in out], pa.list_(pa.string()))
        counts = pa.array([r[0] for r in out], pa.int64())
        if not with_spans:
            return pa.StructArray.from_arrays([counts, pa.array([r[1] for r in out], run_kind), items], ["n_words", "runs", "items"])
        spans = pa.array([[{"start": a, "end": b} for a, b in r[3]] for r in out], span_kind)
        return pa.StructArray.from_arrays([counts, pa.array([r[1] for r in out], pa.int64()), items, spans], ["n_words", "n_hit", "items", "spans"])

    return applied(docs, run, RESULT if with_spans else HITS, text, hits)
