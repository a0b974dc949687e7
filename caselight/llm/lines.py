"""Line deduplication by a sharded minimal perfect hash.

The distinct hashes of all lines are counted once and dealt to shards. A shard is a minimal perfect hash: a few bit arrays, one below
the other, in which every hash finds a bit of its own; the rank of that bit is the hash's slot in compact arrays of fingerprints, counts and
largest document ids. Shards and the documents' line hashes are dealt to the same tasks, a shard ahead of its hashes, which stream past
and probe the arrays; lines themselves are never joined. The commonest lines form a shard of a fixed size that every task holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.llm.common import LOWER, UPPER, applied, free, mixed
from caselight.sources.shipping import ship
from caselight.sources.staging import stage

#: Code points that a line's key needs, and documents that must hold it.
CHARS, LEAST = 20, 3
#: Line hashes of a shard, and lines of the shard that every task holds.
SHARD, COMMON = 16384, 4096
#: Bits for each hash that is left, on each level of a minimal perfect hash.
GAMMA = 2
#: Rows taken out of an Arrow batch at once.
ROWS = 512

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_BLANK = b" \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- lines

def keys_of(raw: bytes) -> list[bytes]:
    """Keys of a text's lines: without ASCII white space at both ends, ASCII capitals in lower case."""
    return [line.strip(_BLANK) for line in raw.translate(_LOWER).split(b"\n")]


def counts_as_line(key: bytes, chars: int) -> bool:
    """Whether a key has enough code points; a code point takes one to four bytes."""
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode()) >= chars)


def digest(key: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(key)


def _distinct(raw: bytes | None, chars: int) -> set[bytes]:
    return {digest(k) for k in set(keys_of(raw)) if counts_as_line(k, chars)} if raw else set()


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


# ---------------------------------------------------------------- minimal perfect hash

@dataclass
class Shard:
    """``levels`` has the sizes of the bit arrays, ``bits`` all of them in 64-bit words; the other arrays have a place for each slot."""

    levels: np.ndarray
    bits: np.ndarray
    prints: np.ndarray
    counts: np.ndarray
    tops: pa.Array

    def __post_init__(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

    def ranks(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Rank of the bit that each hash finds, -1 for one that finds none."""
        out, at, start = np.full(len(h1), -1), np.arange(len(h1)), 0
        for level, size in enumerate(self.levels):
            place = _place(h1[at], h2[at], level, int(size)) + start
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[at[hit]] = (self.before[place >> 6] + below)[hit]
            at, start = at[~hit], start + int(size)
        return out

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 for one that is not in the shard; a foreign hash passes with odds of one in 2^32."""
        out = self.ranks(h1, h2)
        held = np.flatnonzero(out >= 0)
        wrong = self.prints[out[held]] != fingerprints(h1[held], h2[held])
        out[held[wrong]] = -1
        return out


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64))
    return (mixed(h1 + mixed(h2 ^ salt)) % np.uint64(size)).astype(np.int64)


def fingerprints(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mixed(h1 ^ mixed(h2)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def build(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, tops: pa.Array) -> Shard:
    """The shard of distinct hashes with their counts and largest ids.

    On each level the hashes that meet no other one keep their bits, and the others go to the next level.
    """
    levels, words, at = [], [], np.arange(len(h1))
    while len(at):
        size = -(-GAMMA * len(at) // 64) * 64
        place = _place(h1[at], h2[at], len(levels), size)
        alone = np.bincount(place, minlength=size)[place] == 1
        bits = np.zeros(size, np.uint8)
        bits[place[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        levels.append(size)
        at = at[~alone]
    n = len(h1)
    shard = Shard(np.array(levels, np.int64), np.concatenate(words or [np.zeros(0, np.uint64)]), np.zeros(n, np.int32), np.zeros(n, np.int64), tops)
    slot = shard.ranks(h1, h2)
    shard.prints[slot], shard.counts[slot] = fingerprints(h1, h2), counts
    shard.tops = tops.take(pa.array(np.argsort(slot)))
    return shard


# ---------------------------------------------------------------- the index

def line_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: int = CHARS) -> DataFrame:
    """(h1, h2, n, top): the documents that hold a line's key, and the largest of their ids; for keys of ``chars`` code points or more.

    Keys are told apart by 128 bits of hash. A row is a document, whatever its id; null ids are passed over for the largest, which is null if
    all are. Lines are counted where they are read before they are dealt. The result is a written table.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType

    def run(batches):
        for part in _slices(batches):
            found = [_distinct(t, chars) for t in part.column("t").to_pylist()]
            h1, h2 = halves([d for s in found for d in s])
            at = np.repeat(np.arange(len(found)), [len(s) for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column("id").take(pa.array(at))], ["h1", "h2", "id"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("binary").alias("t"))
    found = rows.mapInArrow(run, T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", kind)]))
    return stage(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("top")))


def _built(table: pa.Table) -> Shard:
    h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    return build(h1, h2, table.column("n").to_numpy(), table.column("top").combine_chunks())


_PARTS = {"levels": "array<long>", "bits": "binary", "prints": "binary", "counts": "binary"}


def shards(counts: DataFrame, number: int) -> DataFrame:
    """(deal, levels, bits, prints, counts, tops): a row for each shard of the hashes, which their first half deals to it."""
    top = counts.schema["top"].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        s = _built(table)
        arrays = [table.column("deal")[:1].combine_chunks(), pa.array([s.levels]), *(pa.array([x.tobytes()], pa.binary()) for x in (s.bits, s.prints, s.counts)), pa.ListArray.from_arrays(pa.array([0, len(s.tops)], pa.int32()), s.tops)]
        return pa.Table.from_arrays(arrays, ["deal", *_PARTS, "tops"])

    schema = "deal long, " + ", ".join(f"{n} {k}" for n, k in _PARTS.items()) + f", tops array<{top}>"
    return counts.withColumn("deal", F.pmod("h1", F.lit(number))).groupBy("deal").applyInArrow(one, schema)


def _shard(row: pa.RecordBatch) -> Shard:
    """The shard of the first row of a batch."""
    raw = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), kind)
    return Shard(np.array(row.column("levels")[0].as_py(), np.int64), raw("bits", np.uint64), raw("prints", np.int32), raw("counts", np.int64), row.column("tops")[0].values)


# ---------------------------------------------------------------- probing

def _probed(shard: Shard, batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """Key, hashes and largest id of the asked hashes that at least ``least`` documents hold."""
    h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
    slot = shard.slots(h1, h2)
    keep = np.flatnonzero(slot >= 0)
    keep = keep[shard.counts[slot[keep]] >= least]
    chosen = batch.select(["key", "h1", "h2"]).take(pa.array(keep))
    return pa.RecordBatch.from_arrays([*chosen.columns, shard.tops.take(pa.array(slot[keep]))], ["key", "h1", "h2", "top"])


def repeated_lines(docs: DataFrame, key: str, text: str, counts: DataFrame, chars: int = CHARS, least: int = LEAST, common: int = COMMON, size: int = SHARD) -> DataFrame:
    """(key, lines): of documents told by a long ``key``, the hashes of lines that ``least`` documents of ``counts`` hold, each with their largest id.

    Lines among the ``common`` commonest are answered where the text is read; the hashes of the others are dealt to the shards, so no shard is
    asked for a line that a large part of all documents hold. Documents need not be those that were counted.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = max(4 * parts, -(-counts.count() // size))
    often = _built(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h1", "h2").limit(common).toArrow())
    kept = spark.sparkContext.broadcast((often.levels, often.bits, often.prints, often.counts, often.tops))
    top = counts.schema["top"].dataType
    asked = T.StructType([T.StructField(n, T.LongType()) for n in ("deal", "key", "h1", "h2")] + [T.StructField("known", T.BooleanType()), T.StructField("top", top)])

    def ask(batches):
        often = Shard(*kept.value)
        for part in _slices(batches):
            found = [_distinct(t, chars) for t in part.column("t").to_pylist()]
            h1, h2 = halves([d for s in found for d in s])
            keys = np.repeat(part.column("key").to_numpy(zero_copy_only=False), [len(s) for s in found])
            slot = often.slots(h1, h2)
            known = slot >= 0
            deal = np.where(known, number + (keys.view(np.uint64) % np.uint64(number)).astype(np.int64), h1.view(np.int64) % number)
            tops = often.tops.take(pa.array(slot, mask=~known))
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(keys), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(known), tops], asked.names)

    def probe(batches):
        current, deal = None, None
        for batch in batches:
            heads = np.flatnonzero(batch.column("bits").is_valid().to_numpy(zero_copy_only=False))
            cuts = [0, *heads.tolist(), batch.num_rows]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if i:
                    current, deal = _shard(batch.slice(a, 1)), batch.column("deal")[a].as_py()
                    a += 1
                part = batch.slice(a, b - a)
                known = part.column("known").to_numpy(zero_copy_only=False).astype(bool)
                yield part.filter(pa.array(known)).select(["key", "h1", "h2", "top"])
                mine = part.filter(pa.array(~known & (part.column("deal").to_numpy(zero_copy_only=False) == deal))) if current else part.slice(0, 0)
                if mine.num_rows:
                    yield _probed(current, mine, least)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("t")).mapInArrow(ask, asked)
    index = shards(counts, number)
    both = rows.unionByName(index, allowMissingColumns=True).repartition(parts, "deal").sortWithinPartitions("deal", F.col("bits").isNull())
    answer = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "h1", "h2")] + [T.StructField("top", top)])
    return both.mapInArrow(probe, answer).groupBy("key").agg(F.collect_set(F.struct("h1", "h2", "top")).alias("lines"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", column: str = "deduplicated", chars: int = CHARS, least: int = LEAST, common: int = COMMON, size: int = SHARD) -> DataFrame:
    """Add a struct ``column``: text (the lines that stay, joined), n_lines (before), n_dropped.

    A line's key is the line without ASCII white space at both ends, ASCII capitals in lower case. Keys of ``chars`` code points or more that
    ``least`` documents hold lose their lines, but for the documents with the largest id that holds the key. Each row is a document: repeated rows count,
    and rows that share the largest id all keep their lines. Rows without an id keep a line only if no document with an id holds it. A null
    or empty text is one empty line, which stays. Texts of any length are read as a whole, a text at a time. An empty table gives an empty one;
    a column named like ``column`` is replaced, all others stay.
    """
    counts = line_counts(docs, id, text, chars)
    key, lines, own = free(docs, "key", "lines", "own")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id), F.col(text)))
    found = repeated_lines(keyed, key, text, counts, chars, least, common, size)
    found = found.select(F.col("key").alias(own), F.col("lines").alias(lines))

    def run(texts: pa.Array, ids: pa.Array, drops: pa.Array) -> pa.Array:
        out: list[list] = [[], [], []]
        for raw, i, dropped in zip(texts.cast(pa.binary()).to_pylist(), ids.to_pylist(), drops.to_pylist()):
            raw = raw or b""
            gone = {(d["h1"], d["h2"]) for d in dropped or () if d["top"] is not None and d["top"] != i}
            n, parts = raw.count(b"\n") + 1, None
            if gone:
                keys = keys_of(raw)
                h1, h2 = (h.view(np.int64).tolist() for h in halves([digest(k) for k in keys]))
                parts = [line for line, k, pair in zip(raw.split(b"\n"), keys, zip(h1, h2)) if pair not in gone or not counts_as_line(k, chars)]
            out[0].append(raw if parts is None else b"\n".join(parts))
            out[1].append(n)
            out[2].append(0 if parts is None else n - len(parts))
        return pa.StructArray.from_arrays([pa.array(out[0], pa.binary()).cast(pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["text", "n_lines", "n_dropped"])

    joined = keyed.join(found, F.col(key) == F.col(own), "left")
    return joined.withColumn(column, applied(docs, run, "struct<text:string,n_lines:long,n_dropped:long>", text, id, lines)).drop(*(x for x in (key, lines, own) if x != column))
