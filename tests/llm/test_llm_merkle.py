"""Merkle manifests against trees built by plain code."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from caselight.llm import merkle
from caselight.llm.queries import op13_merkle_manifest


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root of the nodes, and for each node the (before, after) digests on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a // 16 * 16
            run = nodes[first : first + 16]
            paths[i].append(("".join(run[: a - first]), "".join(run[a - first + 1 :])))
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [a // 16 for a in at]
    return nodes[0], paths


def lower(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = [sorted(((leaf(r), r) for r in groups[k]), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for k in keys]
    trees = [tree([h for h, _ in m]) for m in members]
    root, tops = tree([r for r, _ in trees])
    out = []
    for m, (subroot, paths), top in zip(members, trees, tops):
        for (h, r), path in zip(m, paths):
            way = path + top
            fold = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else h
            for before, after in way:
                fold = digest(before, fold, after)
            out.append((r[0], h, subroot, root, digest(*(b + a for b, a in way)), fold, fold == root))
    return out


def planted(seed, sizes):
    rng = random.Random(seed)
    texts = [None, "", "lower only", "Some Text", "É À", "x" * 100000 + "Y"]
    rows, ids = [], rng.sample(range(-3000, 30000), sum(sizes.values()))
    for source, n in sizes.items():
        rows += [(ids.pop(), source, rng.choice([None, "en", "fr"]), rng.choice([None, 7]), rng.choice(texts[:5])) for _ in range(n)]
    rows.append((40001, "a", "en", 1, texts[5]))
    rows += [rows[0]] * 3 + [(None, "a", None, None, "No id")] * 2 + [(None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
SIZES = [{"a": 5, "b": 1, "é": 17, None: 2}, {"hot": 700, "": 16, "Z": 256, "a": 257, "b": 1, None: 1} | {f"s{i}": 1 + i % 3 for i in range(40)}, {"a": 12}]


def order(r):
    return [(x is None, x or 0) for x in r]


@pytest.mark.parametrize("sizes", SIZES)
def test_query_against_plain_code(spark, tmp_path, sizes):
    rows = planted(len(sizes), sizes)
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_merkle_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got, want = sorted(map(tuple, found.collect()), key=order), sorted(plain(rows), key=order)
    assert got == want
    assert len(rows) < 500 or {r[6] for r in want} == {True, False}


def test_one_row_and_none(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "doc_id long, low string")
    (got,) = merkle.manifest(one, "doc_id", "low", [F.col("doc_id")]).collect()
    assert (got["leaf"], got["path"]) == (leaf([1]), []) and got["leaf"] == got["subroot"] == got["root"]
    assert merkle.manifest(one.limit(0), "doc_id", "low", [F.col("doc_id")]).collect() == []


def test_names_that_are_made_here(spark):
    clash = spark.createDataFrame([(i, "x", 5, "r") for i in range(20)], "rank long, tree string, leaf int, path string")
    got = merkle.manifest(clash, "rank", "tree", [F.col("leaf")], {"kept": F.col("path")}).collect()
    assert len(got) == 20 and {r["kept"] for r in got} == {"r"} and len({r["root"] for r in got}) == 1
    with pytest.raises(ValueError):
        merkle.manifest(clash, "rank", "tree", [F.col("leaf")], {"root": F.col("path")})
