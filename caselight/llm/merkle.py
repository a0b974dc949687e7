"""Merkle manifest of a table, with trees labelled by nested intervals.

Leaves are ranked per group, and every node of a tree carries the interval of leaf ranks it covers. A node's ancestor one level up is the
node of that level whose interval holds its own; as a level's intervals have one width, the join is by the bucket that the interval falls
in. What an ancestor's interval has beyond a node's own, on either side, are the node's siblings, so their digests are cut out of the run that the
ancestor was hashed from. The trees' roots, in group order, are the leaves of one more tree. Each level is one grouping into runs of ``WIDTH``
nodes, whatever the size of a group.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.sources.shipping import ship
from caselight.sources.staging import stage

#: Consecutive nodes that become one.
WIDTH = 16
DIGITS = 64
_OWN = {"id", "part", "leaf", "tie", "range", "tree", "rank", "base", "before", "low", "high", "path", "subroot", "root"}
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as text with its length in bytes before it, so that no two rows of fields give the same text; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


# ---------------------------------------------------------------- labels

def ranked(rows: DataFrame) -> DataFrame:
    """Add tree, the number of the row's ``part`` in ascending order, and rank, the row's place in its part by (id, leaf).

    Nulls come first. Rows are sorted in ranges, so that a large part is spread over many; a range numbers its own rows, and one row for each
    range, with its first and last part, tells what to add. The result is a written table.
    """
    spark = rows.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("part"), F.asc_nulls_first("id"), F.col("leaf"), F.col("tie")]
    dealt = stage(rows).withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *order).sortWithinPartitions(*order[:-1]).drop("tie")

    def run(batches):
        from pyspark import TaskContext

        number, last, tree, rank = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            trees, ranks = [], []
            for part in batch.column("part").to_pylist():
                if tree < 0 or part != last:
                    tree, last, rank = tree + 1, part, 0
                trees.append(tree)
                ranks.append(rank)
                rank += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([number] * len(trees), pa.int32()), pa.array(trees, pa.int64()), pa.array(ranks, pa.int64())], [*batch.schema.names, "range", "tree", "rank"])

    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("tree", T.LongType()), T.StructField("rank", T.LongType())])
    numbered = stage(dealt.mapInArrow(run, schema))
    ends = numbered.groupBy("range").agg(F.min_by("part", "tree").alias("first"), F.max_by("part", "tree").alias("last"), F.max(F.struct("tree", "rank")).alias("end"))
    add, tree, count, last = [], -1, 0, None
    for r in sorted(ends.collect(), key=lambda r: r["range"]):
        goes_on = tree >= 0 and r["first"] == last
        base, before = (tree, count) if goes_on else (tree + 1, 0)
        add.append((r["range"], base, before))
        tree, last = base + r["end"]["tree"], r["last"]
        count = r["end"]["rank"] + 1 + (before if r["end"]["tree"] == 0 else 0)
    added = F.broadcast(spark.createDataFrame(add, "range int, base long, before long"))  # a row for each range
    joined = numbered.join(added, "range")
    whole = joined.withColumn("rank", F.col("rank") + F.when(F.col("tree") == 0, F.col("before")).otherwise(0)).withColumn("tree", F.col("tree") + F.col("base"))
    return whole.select(*rows.columns, "tree", "rank")


# ---------------------------------------------------------------- trees

def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels above nodes (tree, low, high, digest), and the roots (tree, level, high, digest) of all trees.

    A level has a row (tree, bucket, low, high, run, digest) for each run of nodes below it, ``run`` being their digests one after
    the other. A tree ends at the level where one node is left: its first run then has that node alone. Levels are written tables.
    """
    levels, roots, step = [], [], 1
    while True:
        step *= WIDTH
        bucket = F.floor(F.col("low") / F.lit(step)).cast("long") if step < 1 << 52 else F.expr(f"low div {step}")
        runs = nodes.groupBy("tree", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("low", "high", "digest"))).alias("run"))
        runs = runs.select("tree", "bucket", F.col("run")[0]["low"].alias("low"), F.element_at("run", -1)["high"].alias("high"), F.size("run").alias("n"), F.array_join("run.digest", "").alias("run"))
        runs = stage(runs.withColumn("digest", F.when((F.col("bucket") == 0) & (F.col("n") == 1), F.col("run")).otherwise(F.sha2("run", 256))))
        alone = (F.col("bucket") == 0) & (F.col("n") == 1)
        roots.append(runs.where(alone).select("tree", F.lit(len(levels)).alias("level"), "high", "digest"))
        nodes = runs.where(~alone).select("tree", "bucket", "low", "high", "run", "digest")
        if nodes.isEmpty():
            break
        levels.append(nodes)
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, stage(out)


def attach(nodes: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """Nodes of a level with the path, and the other columns, of the ancestor one level above, and their siblings before that path.

    A path is a list of the digests before and after the node, then before and after its parent, and so on.
    """
    width = WIDTH**level
    up = above.select(F.col("tree").alias("_tree"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("bucket").alias("_bucket"), F.col("run").alias("_run"), F.col("path").alias("_path"), "subroot", "root")
    inside = (F.col("_low") <= F.col("low")) & (F.col("high") <= F.col("_high"))
    met = nodes.join(up, (F.col("tree") == F.col("_tree")) & (F.expr(f"low div {width * WIDTH}") == F.col("_bucket")) & inside)
    place = F.expr(f"cast((low - _low) div {width} as int)") * DIGITS
    beside = F.struct(F.substring("_run", F.lit(1), place).alias("before"), F.substring("_run", place + DIGITS + 1, F.length("_run")).alias("after"))
    return met.select(*(F.col(c) for c in nodes.columns), F.concat(F.array(beside), "_path").cast(_PATH).alias("path"), "subroot", "root")


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes (tree, low, high) with their paths, from the paths of their trees' roots, ``tops`` (tree, level, path, subroot, root)."""
    found = None
    for level in range(len(levels), -1, -1):
        here = levels[level - 1] if level else nodes
        ends = tops.where(F.col("level") == level).select(F.col("tree").alias("_tree"), F.col("path"), "subroot", "root")
        first = here.where("low = 0").join(ends, F.col("tree") == F.col("_tree")).select(*here.columns, F.col("path").cast(_PATH).alias("path"), "subroot", "root")
        found = first if found is None else attach(here, found, level).unionByName(first)
    return found


def manifest(docs: DataFrame, id: str, part: str, values: list[Column], also: dict[str, Column] | None = None) -> DataFrame:
    """Return id, leaf, subroot, root, path, and the columns of ``also``, a row per row.

    A leaf is the digest of ``values``. Leaves of a part ascend by id, no id first, equal ids by leaf; every ``WIDTH`` consecutive nodes become one until one
    is left, the subroot, and the subroots, in ascending order of their parts, no part first, become the root likewise. A lone leaf is its
    part's subroot, a lone subroot the root. ``path`` lists, from the leaf to the root, the digests before and after in each run. Null values
    have a leaf of their own. Repeated rows have equal leaves at different places. Texts of any length are hashed as a whole. An empty table gives
    an empty result. The table's columns may have any names; ``also`` must not name those that are made here.
    """
    also = also or {}
    if set(also) & _OWN:
        raise ValueError(f"columns of these names are made here: {sorted(set(also) & _OWN)}")
    rows = docs.select(F.col(id).alias("id"), F.col(part).alias("part"), leaf(*values).alias("leaf"), *(c.alias(n) for n, c in also.items()))
    leaves = ranked(rows).withColumns({"low": F.col("rank"), "high": F.col("rank") + 1})
    levels, roots = grow(leaves.select("tree", "low", "high", F.col("leaf").alias("digest")))
    subroots = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("low"), (F.col("tree") + 1).alias("high"), "digest", F.col("level").alias("own"))
    above, root = grow(subroots)
    top = root.select("tree", "level", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    paths = descend(subroots, above, top)
    tops = paths.select(F.col("low").alias("tree"), F.col("own").alias("level"), "path", F.col("digest").alias("subroot"), "root")
    found = descend(leaves.select("id", "leaf", *also, "tree", "low", "high"), levels, stage(tops))
    return found.select(F.col("id").alias(id), "leaf", "subroot", "root", "path", *also)


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the digests beside its path."""
    return F.aggregate(path, start, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests beside a path, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")
