"""Ranked lexical search the other way round: documents stream through an index of the queries.

The terms of all items form an inverted index that every task holds. One pass over the documents counts them, their terms and the documents of
each indexed term; a second pass takes a document's term counts through the index and updates, for each item, a heap of the best documents so
far. A task gives its heaps when it ends, and heaps are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.llm.common import cached
from caselight.sources.shipping import ship

TOP = 10
#: Percent of a document's length that its weight follows.
SLOPE = 90
#: Bytes of item text, with 64 for each item, that one index holds; more items are searched for in several passes.
INDEX = 16 << 20
#: Bytes of a text that are split into words at once, and (document, item) scores that are held at once.
CHUNK, CELLS = 1 << 20, 1 << 21
#: Groups that the heaps of all tasks are merged in before they are merged as a whole.
SALTS = 32

_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(raw: bytes):
    """Lists of a text's terms, a part of the text at a time: runs of ASCII letters and digits and other characters, ASCII capitals in lower case."""
    line, a = raw.translate(_FOLD), 0
    while a < len(line):
        b = line.find(b" ", a + CHUNK)
        b = len(line) if b < 0 else b
        yield line[a:b].split()
        a = b


class Index:
    """Terms of items, numbered, and the items of each term one after the other."""

    def __init__(self, texts: list[bytes]) -> None:
        self.number: dict[bytes, int] = {}
        owners: list[list[int]] = []
        for i, raw in enumerate(texts):
            for t in {t for part in terms(raw) for t in part}:
                k = self.number.setdefault(t, len(owners))
                if k == len(owners):
                    owners.append([])
                owners[k].append(i)
        self.items = len(texts)
        self.start = np.cumsum([0, *map(len, owners)])
        self.postings = np.array([i for o in owners for i in o], np.int64)

    def counts(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """A text's number of terms, and the indexed terms with their counts."""
        n, found = 0, []
        for part in terms(raw):
            n += len(part)
            found += [k for k in map(self.number.get, part) if k is not None]
        which, times = np.unique(np.array(found, np.int64), return_counts=True)
        return n, which, times


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _slices(batches, rows: int):
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part.column("id").to_pylist(), part.column("t").to_pylist()


class Heaps:
    """The best documents of each item; of equal scores the smaller id is better, and no id is worst."""

    def __init__(self, items: int, top: int) -> None:
        self.rows: list[list[tuple]] = [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)  # a score must be above 0, and not below the worst of a full heap
        self.top = top

    def add(self, ids: list, scores: np.ndarray) -> None:
        """Scores (documents, items) of some documents; of one item's only those that can be among its best here are looked at."""
        floor = self.floor
        if len(ids) > self.top:
            floor = np.maximum(floor, np.partition(scores, len(ids) - self.top, axis=0)[len(ids) - self.top])
        for d, i in zip(*(x.tolist() for x in np.nonzero(scores >= floor))):
            entry = (int(scores[d, i]), ids[d] is not None, -(ids[d] or 0))
            if len(self.rows[i]) < self.top:
                heapq.heappush(self.rows[i], entry)
            else:
                heapq.heappushpop(self.rows[i], entry)
        for i, heap in enumerate(self.rows):
            if len(heap) == self.top:
                self.floor[i] = heap[0][0]


def _best(index: Index, weights: np.ndarray, total: int, length: int, batches, top: int):
    """Heaps of one task as a record batch."""
    heaps = Heaps(index.items, top)
    rows = max(1, min(512, CELLS // max(1, index.items)))
    for ids, texts in _slices(batches, rows):
        found = [index.counts(t or b"") for t in texts]
        size = [len(which) for _, which, _ in found]
        doc = np.repeat(np.arange(len(ids)), size)
        which = np.concatenate([w for _, w, _ in found])
        times = np.concatenate([t for _, _, t in found])
        m = np.array([100 - SLOPE + SLOPE * n * total // length if length else 0 for n, _, _ in found], np.int64)[doc]
        gain = weights[which] * (1_000_000_000 * times // (1000 * times + 8 * m))
        spread = index.start[which + 1] - index.start[which]
        at = np.repeat(np.arange(len(which)), spread)
        item = index.postings[index.start[which][at] + np.arange(len(at)) - np.repeat(np.cumsum(spread) - spread, spread)]
        scores = np.zeros(len(ids) * index.items, np.int64)
        np.add.at(scores, doc[at] * index.items + item, gain[at])
        heaps.add(ids, scores.reshape(len(ids), index.items))
    flat = [(i, -low if known else None, score) for i, heap in enumerate(heaps.rows) for score, known, low in heap]
    columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])


def _pass(rows: DataFrame, texts: list[bytes], top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each item, by its number, in the order of its rank among ``rank``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(texts)
    own = ("search", uuid.uuid4().hex)

    def count(batches):
        index = cached(own, lambda: Index(sent.value))
        total, length, df = 0, 0, np.zeros(len(index.number), np.int64)
        for _, part in _slices(batches, 512):
            for t in part:
                n, which, _ = index.counts(t or b"")
                total += n > 0
                length += n
                df[which] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], some)), pa.array(np.append([total, length], df[some]))], ["term", "n"])

    counted = {r["term"]: r["n"] for r in rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total, length = counted.get(-1, 0), counted.get(-2, 0)
    weights = np.zeros(max(counted, default=-1) + 1, np.int64)
    for term, df in counted.items():
        if term >= 0:
            weights[term] = weight(total, df)

    def score(batches):
        index = cached(own, lambda: Index(sent.value))
        all_weights = np.zeros(len(index.number), np.int64)
        all_weights[: len(weights)] = weights
        yield _best(index, all_weights, total, length, batches, top)

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    heaps = rows.mapInArrow(score, "item long, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    for by in (["item", "salt"], ["item"]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return heaps.select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, limit: int = INDEX) -> DataFrame:
    """(item, rank, doc_id, score): the ``top`` highest-scoring documents of each item with a score above 0, all if there are fewer.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), over the N documents with a term and the df that hold it; a document's score sums
    weight * (10^9 tf div (1000 tf + 8 m)) over an item's distinct terms, m being 10 + 90 n N div L for its n of all L terms. Equal
    scores rank by ascending id, those without an id last. Null texts have no terms; items without one have no rows. Each row is an item or a document of
    its own, also if it repeats another. Texts of any length are read a part at a time. Empty tables give an empty result. Ids of documents
    are integers. The items' index is sent to all tasks up to ``limit`` bytes of items; more items are searched for in several passes over the documents.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = items.schema[item].dataType
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    tests = items.select(F.col(item).alias("k"), F.col(item_text).cast("binary").alias("t")).where(F.octet_length("t") > 0)
    size = tests.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    passes = max(1, -(-size // limit))
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("k", kind)])
    out = None
    for p in range(passes):
        part = tests if passes == 1 else tests.where(F.pmod(F.xxhash64("k", "t"), F.lit(passes)) == p)
        held = sorted(((r["k"], bytes(r["t"])) for r in part.toLocalIterator()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
        names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(held)], schema)
        best = _pass(rows, [t for _, t in held], top).join(F.broadcast(names), "item")
        best = best.select(F.col("k").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id), "score")
        out = best if out is None else out.unionByName(best)
    return out
