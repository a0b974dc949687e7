"""URL filters: hosts, paths and rules against plain code, cascades against sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.llm import urls

RULES = [urls.Rule(True, "org", "/"), urls.Rule(False, "example.org", "/es/"), urls.Rule(False, "example.org", "/en/1"), urls.Rule(True, "com", "/fr/"), urls.Rule(False, "com", "/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain(url, listed):
    host, path = split(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, "allow" if best.allow else "block"
    return host, path, None, "block" if host + path in listed and host + path else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "http://ORG/x", "https://a.b.Example.ORG/es/x?q#f", "https://example.org/en/1", "https://example.org/en/2", "x://notexample.org/es/",
    "http://É.com/fr/", "http://com/de/a", "http://com", "ftp://h.net?x=/y", "ftp://h.net#://z/", "http://u@h.net:80/p//q", "a\nb://h.net/p\nq?r", "http://h.net/p", "http://h.net/p?utm", "http://xorg/", "://h.net/p",
]


def test_against_plain_code(spark):
    rng = random.Random(2)
    more = [f"http://h{rng.randint(0, 40)}.net/p{rng.randint(0, 60)}" + rng.choice(["", "?a=1", "#b"]) for _ in range(3000)] + ["http://h1.net/p1"] * 2000
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS + more)] + [(None, "http://h1.net/p1", "x", "y"), (3, URLS[3], "x", "y")]
    keys = [f"h{rng.randint(0, 40)}.net/p{rng.randint(0, 60)}" for _ in range(300)] + ["h1.net/p1", "h.net/p", "not/there", "", None]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    listed = spark.createDataFrame([(k,) for k in keys], "key string")
    got = urls.judge(pages, listed, RULES).collect()
    want = [(i, *plain(u, set(keys))) for i, u, _, _ in rows]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("share", [0, 0.01, 0.3, 0.9, 1])
def test_cascade_is_exact(share):
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(0, 2**64, (2, 20000), dtype=np.uint64)
    listed = rng.random(20000) < share
    cascade = urls.parse(urls.build(h1, h2, listed))
    assert (urls.member(cascade, h1, h2) == listed).all()
    if 0 < share < 0.5:
        assert sum(len(f) for f, _, _ in cascade) < 2.5 * listed.sum() + 64  # bytes, far below a list of keys


def test_many_shards(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    found, shards = urls.cascades(keys.select("key"), keys.where("id % 7 = 0").select("key"), shard_size=300)
    assert shards == 17
    got = urls.listed_rows(keys, found, shards, "id", "key", salts=3)
    assert got.count() == 5000 and got.where("listed != (id % 7 = 0)").count() == 0


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://h.net/p")], "page_id long, url string")
    listed = spark.createDataFrame([("h.net/p",)], "key string")
    assert urls.judge(pages.limit(0), listed, RULES).collect() == []
    assert urls.judge(pages, listed.limit(0), []).first()["verdict"] == "allow"
    assert urls.judge(pages, listed, []).first()["verdict"] == "block"


def test_equally_long_rules(spark):
    df = spark.createDataFrame([("a.bc", "/d/e")], "host string, path string")
    rules = [urls.Rule(True, "bc", "/d/e"), urls.Rule(True, "a.bc", "/d"), urls.Rule(False, "a.bc", "/d")]
    assert tuple(df.select(urls.longest_rule(F.col("host"), F.col("path"), rules).alias("r")).first()["r"]) == ("a.bc/d", False)
    assert tuple(df.select(urls.longest_rule(F.col("host"), F.col("path"), rules[:2]).alias("r")).first()["r"]) == ("a.bc/d", True)
