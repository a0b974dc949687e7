"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most ``capacity`` tokens. How many pieces have which length is all the plan depends on: a branch-and-bound
over that histogram fills bins around the largest piece that is left. The plan says how many bins of each filling there are, and each
piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.common import cached
from caselight.sources.shipping import ship
from caselight.sources.staging import stage

CAPACITY, END = 1024, 2
#: Nodes the branch-and-bound may open beyond the first descent, and fillings it tries at each.
NODES, WIDTH = 300, 3
#: Sums that are looked at for further fillings of one bin, the fullest first, once there is one, and runs of lengths tried for a sum.
LOOKS, TRIES = 4, 8
#: Run of white space from which on the tokenizer file is used; tiktoken's regex gives up on a run of about a million.
BLANKS = 100_000
_BLANK_RUN = re.compile(rf"(?<!\s)\s{{{BLANKS}}}")


# ---------------------------------------------------------------- pieces

def tokenizer(path: str):
    """Byte-level BPE from a rank file; on texts without an added token its ids equal those of the tokenizer file with the same vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_file(path: str):
    """The tokenizer file beside a rank file, with its default settings: slower, but it knows added tokens and has no limit to runs of white space."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def added_tokens(path: str) -> list[str]:
    """The added tokens of the tokenizer file beside a rank file; the rest of the file is not parsed."""
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
        content = file.read()
    # A quote inside a token is escaped, so this is the member itself.
    found = re.search(r'"added_tokens"\s*:\s*(?=\[)', content)
    return [t["content"] for t in json.JSONDecoder().raw_decode(content, found.end())[0]] if found else []


def encoder(path: str):
    """Function from a text to the ids that the tokenizer file gives it.

    Texts that hold an added token, which the file takes as one id, and texts with a very long run of white space go to the file itself.
    """
    whole = cache(lambda: tokenizer_file(path))  # many times the size of the ranks, and most workers never need it
    added = re.compile("|".join(map(re.escape, added_tokens(path))) or r"(?!)")
    quick = tokenizer(path).encode_ordinary

    def encode(text: str) -> list[int]:
        if added.search(text) or len(text) >= BLANKS and _BLANK_RUN.search(text):
            return whole().encode(text, add_special_tokens=False).ids
        return quick(text)

    return encode


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end: int = END) -> DataFrame:
    """Pieces of every whole text, with crc32 of their ids, and a rank among the pieces of one length in one task."""
    ship(docs.sparkSession)

    def run(batches):
        place = path or vocabulary()
        encode = cached(("encoder", place), lambda: encoder(place))
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0), batch.column(1)):  # a text at a time, as a batch of them takes much memory
                key, t = key.as_py(), t.as_py()
                ids = np.array([*encode(t or ""), end], "<u4")
                for n, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((key, n, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- plan

Plan = list[tuple[int, tuple[int, ...]]]  # bins and the lengths in each


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces too large to share a bin, for all thresholds."""
    size = np.arange(capacity + 1)
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        n[length] = c
    number, volume = np.cumsum(n), np.cumsum(n * size)
    best, half = -(-int(volume[-1]) // capacity), capacity // 2
    for k in range(half + 1):
        alone = number[capacity] - number[capacity - k]
        big, big_volume = number[capacity - k] - number[half], volume[capacity - k] - volume[half]
        rest = volume[half] - (volume[k - 1] if k else 0)
        best = max(best, int(alone + big + max(0, -(-(rest - (big * capacity - big_volume)) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on the histogram: bins that are alike are filled together."""
    groups: dict[int, Counter] = {capacity: Counter()}  # room left -> filling -> bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in groups if r >= length and r < capacity and groups[r]), default=capacity)
            k = min(left, room // length)
            if room == capacity:
                bins, filling = left // k, ()
            else:
                filling, there = next(iter(groups[room].items()))
                bins = min(there, left // k)
                groups[room][filling] -= bins
                if not groups[room][filling]:
                    del groups[room][filling]
            groups.setdefault(room - k * length, Counter())[filling + (length,) * k] += bins
            left -= bins * k
    return [(bins, filling) for room in groups for filling, bins in groups[room].items() if filling]


def sums(lengths: list[int], capacity: int) -> list[int]:
    """Bit sets of what one, two and three of the lengths add up to."""
    keep = (1 << capacity + 1) - 1
    one = two = three = 0
    for x in lengths:
        one |= 1 << x
    for x in lengths:
        two |= one << x & keep
    for x in lengths:
        three |= two << x & keep
    return [1, one, two, three]


def fillings(room: int, counts: dict[int, int], lengths: list[int], reach: list[int], width: int) -> list[tuple[int, ...]]:
    """Up to ``width`` fillings of the room that no other dominates, fullest first, then with fewest and largest pieces.

    Each starts with at most three pieces that add up to a reachable sum; room that is left is filled in the same way.
    """

    def exact(total: int, k: int, top: int):
        """Falling runs of k lengths, none above ``top``, with this total; larger first pieces first."""
        if k == 0:
            if total == 0:
                yield ()
            return
        for x in lengths:
            if x <= top and x <= total and x * k >= total and reach[k - 1] >> (total - x) & 1:
                for rest in exact(total - x, k - 1, x):
                    yield (x, *rest)

    def valid(filling):
        return all(counts.get(x, 0) >= n for x, n in Counter(filling).items())

    found: list[tuple[int, ...]] = []
    able = (reach[1] | reach[2] | reach[3]) & ((1 << room + 1) - 1)
    looks = 0
    while able and len(found) < width and (looks < LOOKS or not found):
        looks += 1
        total = able.bit_length() - 1
        able &= ~(1 << total)
        if not total:
            break
        for k in (1, 2, 3):
            tries = 0
            for f in exact(total, k, total) if reach[k] >> total & 1 else ():
                tries += 1
                if valid(f) and not any(dominated(f, g) for g in found):
                    found.append(f)
                    break
                if tries >= TRIES:
                    break
            if len(found) >= width:
                break
    return found


def dominated(f: tuple[int, ...], g: tuple[int, ...]) -> bool:
    """Whether the pieces of f fit into places of the pieces of g."""
    places = sorted(g)
    for x in sorted(f, reverse=True):
        at = next((i for i, p in enumerate(places) if p >= x), None)
        if at is None:
            return False
        places[at] -= x
        places.sort()
    return True


def complete(room: int, counts: dict[int, int], lengths: list[int], reach: list[int], first: tuple[int, ...]) -> tuple[int, ...]:
    """A filling, with what room it leaves filled best-fit until nothing fits."""
    used, room = Counter(first), room - sum(first)
    filling = first
    while room and lengths and lengths[-1] <= room:
        left = {x: counts[x] - used[x] for x in lengths if x <= room and counts[x] > used[x]}
        if not left:
            break
        more = fillings(room, left, sorted(left, reverse=True), reach, 1)
        x = more[0] if more else (max(left),)
        times = max(1, min(room // sum(x), min(left[y] // n for y, n in Counter(x).items())))
        filling += x * times
        used.update(x * times)
        room -= sum(x) * times
    return filling


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> Plan:
    """Bins of each filling, as few as the search finds.

    Depth first: the largest length left is completed by undominated fillings, and a filling is taken for as many
    bins as pieces allow. A branch ends when its waste leaves no better result than the incumbent, which starts
    as best-fit decreasing; all ends at the lower bound.
    """
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    volume, floor = sum(x * n for x, n in counts.items()), lower_bound(counts, capacity)
    incumbent = best_fit(counts, capacity)
    bins = sum(n for n, _ in incumbent)
    stack = [(counts, None, 0)]
    budget = nodes + 4 * len(counts)
    while stack and budget and bins > floor:
        left, made, waste = stack.pop()
        if waste > (bins - 1) * capacity - volume:
            continue
        if not left:
            incumbent = []
            while made:
                made, step = made
                incumbent.append(step)
            bins = sum(n for n, _ in incumbent)
            continue
        budget -= 1
        lengths = sorted(left, reverse=True)
        top = lengths[0]
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        usable = [x for x in sorted(rest, reverse=True) if x <= capacity - top]
        reach = sums(usable, capacity)
        options = fillings(capacity - top, rest, usable, reach, width) or [()]
        for first in reversed(options):
            filling = (top, *complete(capacity - top, rest, usable, reach, first))
            need = Counter(filling)
            times = min(left[x] // n for x, n in need.items())
            after = {x: n - need[x] * times for x, n in left.items() if n > need[x] * times}
            stack.append((after, (made, (times, filling)), waste + times * (capacity - sum(filling))))
    return incumbent


def slots(packing: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first bin, offset): the places of the pieces of each length."""
    out, ranks, start = [], Counter(), 0
    for bins, filling in packing:
        offset = 0
        for length in filling:
            out.append((length, ranks[length], ranks[length] + bins, start, offset))
            ranks[length] += bins
            offset += length
        start += bins
    return out


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Return doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every document.

    A null or empty text is the end token alone. Repeated rows are packed like others, also with equal or null ids. An empty
    table gives an empty one. Other columns are not read. The driver sees the number of pieces per length, at most
    ``capacity`` rows, and the plan's places, which are as many as lengths and fillings, not pieces.
    """
    spark = docs.sparkSession
    cuts = stage(pieces(docs, id, text, capacity, path))
    counts = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    offsets = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    packing = plan(histogram, capacity)
    if full:
        packing = [(full, (capacity,)), *packing]
    places = spark.createDataFrame(slots(packing), "l int, low long, high long, first_bin long, offset long")
    ranked = cuts.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(
        F.col("doc_id").alias(id), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_bin") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset",
    )
