"""Threshold-scaled document fingerprints.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, and never fewer than a document's FLOOR
smallest ones. It holds all hashes of a short document, grows with a long one, and unions of fingerprints give the
fingerprints of unions. Two are compared below the lower of their thresholds, where both know every hash: the share of a small
document's hashes found in a large one's estimates containment however unequal they are.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import applied, buffers, mixed, slabs, span_hashes, word_spans
from caselight.sources.shipping import ship

SHINGLE, SCALE, FLOOR = 5, 8, 256
#: Bytes handled at once; a longer document is handled in overlapping runs of words of this size.
SLAB = 1 << 20
#: Rows taken out of an Arrow batch at once.
ROWS = 256

_PLACE = np.random.default_rng(11).integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of several documents, and the document of each.

    A shingle's hash combines those of its words, by place. A document of fewer words than a shingle gives one hash of them all.
    """
    start, stop, doc = word_spans(raw, offsets, _INSIDE)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = span_hashes(raw, start, stop)
    # every word starts a window of SHINGLE places; those beyond its document stay empty
    padded = np.concatenate([word, np.zeros(SHINGLE - 1, np.uint64)])
    owner = np.concatenate([doc, np.full(SHINGLE - 1, -1)])
    whole = owner[SHINGLE - 1 :] == doc
    first = np.append(True, doc[1:] != doc[:-1])
    at = np.flatnonzero(whole | first)  # a short document has its first word's window
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        h += np.where(owner[at + j] == doc[at], padded[at + j] * _PLACE[j], np.uint64(0))
    return mixed(h), doc[at]


def _runs(raw: np.ndarray):
    """Byte ranges of a long document that overlap by SHINGLE - 1 words and hold all its shingles."""
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw.tobytes())]
    a = 0
    while a < len(words):
        b = a + SHINGLE
        while b < len(words) and words[b][1] - words[a][0] <= SLAB:
            b += 1
        b = min(b, len(words))
        yield words[a][0], words[b - 1][1]
        if b == len(words):
            return
        a = b - SHINGLE + 1


def sketches(texts: pa.Array, scale: int = SCALE) -> list[np.ndarray]:
    """Fingerprint of every text: its sorted distinct hashes that are below 2^64 / scale or among its FLOOR smallest; empty without words."""
    raw, offsets = buffers(texts)
    limit = np.uint64(2**64 // scale - 1)
    out: list[np.ndarray] = []
    for a, b in slabs(offsets, SLAB):
        part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if len(part) > 2 * SLAB:  # one long document
            found = [_kept(*shingle_hashes(part[s:e], np.array([0, e - s])), 1, limit)[0] for s, e in _runs(part)]
            joined = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            out.append(_trimmed(joined, limit))
        else:
            out += _kept(*shingle_hashes(part, off), b - a, limit)
    return out


def _trimmed(h: np.ndarray, limit: np.uint64) -> np.ndarray:
    return h[: max(FLOOR, int(np.searchsorted(h, limit, "right")))]


def _kept(h: np.ndarray, doc: np.ndarray, n: int, limit: np.uint64) -> list[np.ndarray]:
    ends = np.searchsorted(doc, np.arange(n + 1))
    return [_trimmed(np.unique(h[a:b]), limit) for a, b in zip(ends, ends[1:])]


def as_hex(sketch: np.ndarray) -> str:
    """16 hexadecimal digits for each hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def _known(h: np.ndarray, limit: np.uint64) -> np.uint64:
    """The hash up to which a fingerprint holds all hashes of its document."""
    return np.uint64(2**64 - 1) if len(h) < FLOOR else max(limit, h[-1])


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Share of the smaller fingerprint's hashes that the other has too, among hashes that both know.

    1 for equal fingerprints, two empty ones included; 0 if one is empty or has no hash that both know.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    limit = np.uint64(2**64 // scale - 1)
    top = min(_known(a, limit), _known(b, limit))
    a, b = a[: np.searchsorted(a, top, "right")], b[: np.searchsorted(b, top, "right")]
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, min(len(a), len(b)))


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The fingerprint of two documents taken together, short of the shingles that would span both."""
    return _trimmed(np.union1d(a, b), np.uint64(2**64 // scale - 1))


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint", scale: int = SCALE) -> DataFrame:
    """Add the fingerprint of every whole text as hexadecimal text.

    Null, empty and wordless texts have the empty fingerprint. Equal texts have equal ones. A column named like ``column`` is replaced.
    """
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([as_hex(s) for s in sketches(texts, scale)], pa.string())

    return docs.withColumn(column, applied(docs, run, "string", text))


def hashes_of(fingerprint: Column) -> Column:
    """A fingerprint's hashes as an array, for set functions."""
    return F.filter(F.regexp_extract_all(fingerprint, F.lit("([0-9a-f]{16})"), F.lit(1)), lambda h: h != "")


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Containment of two fingerprint columns, as ``containment`` has it; null if one is null."""
    limit = f"{2**64 // scale - 1:016x}"

    def known(h: Column) -> Column:
        return F.when(F.size(h) < FLOOR, "f" * 16).otherwise(F.greatest(F.lit(limit), F.element_at(h, -1)))

    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        top = F.least(known(x), known(y))
        x, y = F.filter(x, lambda h: h <= top), F.filter(y, lambda h: h <= top)
        least = F.least(F.size(x), F.size(y))
        shared = F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))
        return F.when((F.size(pair["x"]) == 0) & (F.size(pair["y"]) == 0), F.lit(1.0)).otherwise(shared)

    both = F.struct(hashes_of(a).alias("x"), hashes_of(b).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), F.element_at(F.transform(F.array(both), of), 1))


# ---------------------------------------------------------------- documents and the one that follows

def successors(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (bucket, copy, id, text) such that, sorted, each row that is not a copy is followed by its next document.

    The next document is the one with the next smaller id; ties are ordered by text, null ids come last, and the last
    document is followed by the first. Ids are dealt to buckets by quantiles, four for each shuffle partition, and the first
    document of a bucket is copied to the end of the bucket before it. Per bucket one id reaches the driver.
    """
    ship(docs.sparkSession)
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    steps = ",".join(str(i / n) for i in range(1, n))
    edges = np.unique(np.array(rows.agg(F.expr(f"percentile_approx(id, array({steps}), {20 * n})")).first()[0] or [], np.int64))

    def run(ids: pa.Array) -> pa.Array:
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        found = np.searchsorted(edges, values, "left") + 1
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, found), pa.int32())

    rows = rows.withColumn("bucket", applied(rows, run, "int", "id"))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect())
    if not tops:
        return rows.withColumn("copy", F.lit(0))
    targets = [(top, bucket, tops[(i + 1) % len(tops)][0]) for i, (bucket, top) in enumerate(tops)]
    heads = docs.sparkSession.createDataFrame(targets, "top long, own int, target int")
    firsts = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("top")) & (F.col("bucket") == F.col("own")))
    copies = firsts.groupBy("target", "id").agg(F.min("text").alias("text")).select(F.col("target").alias("bucket"), F.lit(1).alias("copy"), "id", "text")
    return rows.select("bucket", F.lit(0).alias("copy"), "id", "text").unionByName(copies)


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following text, or all of it."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def compared(docs: DataFrame, id: str = "doc_id", text: str = "text", scale: int = SCALE) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the next document's.

    Null texts count as empty. A single document follows itself. Rows of one id follow each other by text. An empty table gives an
    empty one. Very long texts are hashed in runs; other columns are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = successors(docs, id, text).repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", F.col("id").desc_nulls_last(), "text")

    def run(batches):
        ids, copies, texts, size = [], [], [], 0
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            for i, copy, t in zip(batch.column("id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i), copies.append(copy), texts.append(t)
                size += len(t)
                if size > SLAB and len(texts) > 1:
                    yield _compared(ids, copies, texts, scale)
                    ids, copies, texts = ids[-1:], copies[-1:], texts[-1:]
                    size = len(t)
        if len(texts) > 1:
            yield _compared(ids, copies, texts, scale)

    return rows.select("id", "copy", "text").mapInArrow(run, PAIRS)


def _compared(ids: list, copies: list, texts: list[str], scale: int) -> pa.RecordBatch:
    """Results of all rows but the last and the copies; each is followed by the next one in the lists."""
    own = sketches(pa.array(texts, pa.large_string()), scale)
    keep = [i for i in range(len(ids) - 1) if not copies[i]]
    new = [edited(texts[i], texts[i + 1]) for i in keep]
    other = sketches(pa.array(new, pa.large_string()), scale)
    columns = [
        pa.array([ids[i] for i in keep], pa.int64()), pa.array([len(texts[i]) for i in keep], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
        pa.array([as_hex(own[i]) for i in keep], pa.string()), pa.array([as_hex(s) for s in other], pa.string()),
        pa.array([containment(own[i], s, scale) for i, s in zip(keep, other)], pa.float64()),
        pa.array([containment(own[i], own[i + 1], scale) for i in keep], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
