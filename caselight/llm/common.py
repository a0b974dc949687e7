"""Helpers shared by the operators: table access, held-out split, Arrow text buffers, worker caches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.sources.shipping import ship

#: Upper and lower case of the ASCII letters, for lower-casing that leaves other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CACHE: dict = {}


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it needs to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def shares(columns: list[Column]) -> Column:
    """Seeded 64-bit hash of columns as a fraction in [0, 1), for sampling that any run repeats."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def cached(key, build: Callable):
    """A value built once in a Python worker, such as an automaton or a compressor.

    Workers outlive a stage: what other operators keep, by the first member of their keys, goes before a new operator builds its own.
    """
    if key not in _CACHE:
        others = [k for k in _CACHE if k[0] != key[0]]
        if others or len(_CACHE) >= 8:
            for k in others or list(_CACHE):
                del _CACHE[k]
            released()
        _CACHE[key] = build()
    return _CACHE[key]


def released() -> None:
    """Give freed memory of this process back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def applied(docs: DataFrame, run: Callable, kind: str, *columns: str) -> Column:
    """A column made by a function on Arrow arrays; the package is sent to the workers with it."""
    ship(docs.sparkSession)
    return F.arrow_udf(run, kind)(*[F.col(c) for c in columns])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # ASCII capitals hash like small letters
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values, so that any of their bits can be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the runs of bytes that ``inside`` (a table of 256) marks; none spans two documents."""
    n = len(raw)
    marked = np.zeros(n + 2, bool)
    marked[1:-1] = inside[raw]
    begins, ends = marked[1:-1] & ~marked[:-2], marked[1:-1] & ~marked[2:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = marked[1:-1][edge]
    edge = edge[edge > 0] - 1
    ends[edge] = marked[1:-1][edge]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal bytes but for the case of ASCII letters.

    A hash is a polynomial modulo 2^64, taken as a difference of one running sum and shifted back to the span's start.
    """
    n = len(raw)
    if len(_powers[0]) <= n:
        for i, base in enumerate(_BASE):
            steps = np.full(max(n, 1 << 20) + 4096, base)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers[0][:n], out=total[1:])
    return mixed((total[stop] - total[start]) * _powers[1][start] + (stop - start).astype(np.uint64))


def slabs(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``size`` bytes, so that temporary arrays stay small."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b
