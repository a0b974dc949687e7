"""URL filters: prefix rules, and a Bloom filter cascade for long lists of keys.

A key is host and path. The first filter of a cascade encodes the listed keys, the second the keys of the corpus that
the first takes wrongly, the third the listed keys that the second takes, and so on until none is left. As the
cascade is made over all keys of the corpus, it answers for each of them exactly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.llm.common import LOWER, UPPER, mixed
from caselight.sources.shipping import ship
from caselight.sources.staging import stage

#: Keys of the corpus that one cascade covers, on average; there are as many cascades as that takes.
SHARD = 16384
#: Parts that the pages of a cascade are dealt to, so that a common key's pages do not meet in one task.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """A prefix rule: it fits its host and all subdomains, if the path starts with its path."""

    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, ASCII letters lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to a question mark or hash; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """Struct (name, allow) of the longest rule that fits; of equally long ones that with the longer host, then one that blocks."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.allow, r.name))
    out = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<name:string,allow:boolean>") if out is None else out


# ---------------------------------------------------------------- cascades

def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int):
    """Bit places of keys in the filter of a level, one array per hash function."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    a, b = mixed(h1 ^ salt), mixed(h2 + salt) | np.uint64(1)
    for i in range(hashes):
        yield ((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)


def _passes(filter: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    ok = np.ones(len(h1), bool)
    for at in _places(h1, h2, level, bits, hashes):
        ok &= (filter[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> bytes:
    """The cascade of a set of keys, given by two hashes each, of which some are listed."""
    inside, outside = (h1[listed], h2[listed]), (h1[~listed], h2[~listed])
    levels = []
    while len(inside[0]):
        n, other = len(inside[0]), max(1, len(outside[0]))
        rate = min(0.5, n / other * 0.7) if not levels else 0.5
        hashes = max(1, round(-np.log2(rate)))
        bits = max(8, int(np.ceil(n * hashes / np.log(2))))
        filter = np.zeros(bits + 7 >> 3, np.uint8)
        for at in _places(*inside, len(levels), bits, hashes):
            np.bitwise_or.at(filter, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        wrong = _passes(filter, *outside, len(levels), bits, hashes)
        levels.append((bits, hashes, filter.tobytes()))
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return b"".join([struct.pack("<I", len(levels)), *(struct.pack("<QI", b, k) + f for b, k, f in levels)])


def parse(raw: bytes) -> list[tuple[np.ndarray, int, int]]:
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        bits, hashes = struct.unpack_from("<QI", raw, at)
        size = bits + 7 >> 3
        out.append((np.frombuffer(raw, np.uint8, size, at + 12), bits, hashes))
        at += 12 + size
    return out


def member(cascade: list, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys are listed: those that pass an odd number of filters before the first they fail."""
    out, at = np.zeros(len(h1), bool), np.arange(len(h1))
    for level, (filter, bits, hashes) in enumerate(cascade):
        at = at[_passes(filter, h1[at], h2[at], level, bits, hashes)]
        out[at] = level % 2 == 0
    return out


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def cascades(universe: DataFrame, listed: DataFrame, key: str = "key", shard_size: int = SHARD) -> tuple[DataFrame, int]:
    """Cascades (shard, filters) over all keys of the corpus, dealt by hash, and their number.

    Keys are told apart by 128 bits of hashes. Null keys are left out. Repeated keys are reduced where they are read.
    """
    ship(universe.sparkSession)
    both = universe.select(F.col(key).alias("k"), F.lit(0).alias("x")).unionByName(listed.select(F.col(key).alias("k"), F.lit(1).alias("x"))).where("k is not null")
    keys = stage(both.select(*_hashes(F.col("k")), "x").groupBy("h1", "h2").agg(F.max("x").alias("x")))
    shards = max(1, -(-keys.count() // shard_size))

    def one(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        raw = build(h1, h2, table.column("x").to_numpy() == 1)
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "filters": pa.array([raw], pa.binary())})

    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(one, "shard long, filters binary"), shards


def listed_rows(rows: DataFrame, found: DataFrame, shards: int, id: str, key: str, salts: int = SALTS) -> DataFrame:
    """Rows (as given) with a column ``listed``: whether the key is in the cascade's list.

    Cascades and rows are dealt to the same tasks, a cascade ahead of its rows, so that a task holds one cascade at a time and streams the
    rows past it; nothing is broadcast, whatever the list's size. The rows of a cascade are spread over ``salts`` copies of it by their id.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    filters = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumns(
        {n: F.lit(None).cast(rows.schema[n].dataType) for n in names} | {"h1": F.lit(None).cast("long"), "h2": F.lit(None).cast("long")}
    )
    h1, h2 = _hashes(F.col(key))
    keyed = rows.select("*", h1, h2).withColumns({"shard": F.pmod("h1", F.lit(shards)).cast("long"), "salt": F.pmod(F.xxhash64(F.lit(3), F.col(id), F.col(key)), F.lit(salts)).cast("int"), "filters": F.lit(None).cast("binary")})
    dealt = filters.unionByName(keyed).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filters").isNull())
    schema = T.StructType([*(T.StructField(n, rows.schema[n].dataType) for n in names), T.StructField("listed", T.BooleanType())])

    def run(batches):
        current: list = []
        for batch in batches:
            raw = batch.column("filters")
            heads = np.flatnonzero(raw.is_valid().to_numpy(zero_copy_only=False))
            cuts = [0, *heads.tolist(), len(raw)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if n:
                    current = parse(raw[a].as_py())
                    a += 1
                if a < b:
                    part = batch.slice(a, b - a)
                    h1, h2 = (part.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(member(current, h1, h2))], [*names, "listed"])

    return dealt.mapInArrow(run, schema)


def judge(pages: DataFrame, listed: DataFrame, rules: Iterable[Rule], id: str = "page_id", url: str = "url", key: str = "key") -> DataFrame:
    """Return id, host, path, rule and verdict (allow or block) of every page.

    The longest fitting rule decides; without one, a page is blocked if its key, host and path, is listed. A null url, or one
    without ``://``, has an empty host and path and is allowed, as an empty key cannot be listed. Repeated rows and null ids
    are judged like others; empty pages give an empty result, an empty list blocks nothing. Other columns are not read.
    """
    parsed = pages.select(F.col(id), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    parsed = parsed.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    keyed = parsed.withColumn("key", F.concat("host", "path"))
    found, shards = cascades(keyed.select("key"), listed.select(F.col(key).alias("key")).where("key != ''"))
    ruled = parsed.where("rule is not null").select(id, "host", "path", F.col("rule.name").alias("rule"), F.col("rule.allow").alias("allow"))
    rest = listed_rows(keyed.where("rule is null").select(id, "host", "path", "key"), found, shards, id, "key")
    rest = rest.select(id, "host", "path", F.lit(None).cast("string").alias("rule"), (~F.col("listed")).alias("allow"))
    return ruled.unionByName(rest).select(id, "host", "path", "rule", F.when(F.col("allow"), "allow").otherwise("block").alias("verdict"))
