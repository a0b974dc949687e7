"""Mondrian k-anonymity: boxes of records, cut in half at one attribute after another while each half keeps k of them.

Records with equal quasi-identifiers are one cell. All open boxes are cut in one step: counts per box, attribute and bin give each box its
widest attribute that can be cut, and the cut nearest to the middle; cells then move to the halves. A step costs one aggregation, however many
boxes there are, and the number of steps grows with the logarithm of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselight.operators.ordering import running_total
from caselight.operators.privacy import _join_null_safe
from caselight.schemas import K_ANONYMITY_THRESHOLD
from caselight.sources.staging import stage

#: Bins of an attribute: values share a bin only if they hold fewer than one in so many of the records together.
BINS = 1024
#: Cuts that are sent to every task; more are joined.
SENT = 8192


def _binned(cells: DataFrame, quasi: list[str], bins: int) -> DataFrame:
    """Cells with a bin number per attribute: the share of records that have a smaller value, nulls first."""
    total = cells.agg(F.sum("n")).first()[0] or 1
    for i, name in enumerate(quasi):
        values = cells.groupBy(name).agg(F.sum("n").alias("_rows"))
        placed = running_total(values, [F.asc_nulls_first(name)], "_rows", "_before")
        bin_ = F.expr(f"_before * {bins} div {total}").cast("int").alias(f"_bin{i}")
        cells = _join_null_safe(cells, placed.select(name, bin_), [name])
    return stage(cells)


def _cuts(cells: DataFrame, count: int, widest: list[int], k: int) -> DataFrame:
    """(box, dim, cut): the attribute and last bin of the lower half for every box that can be cut."""
    by_dim = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"_bin{i}").alias("bin")) for i in range(count)])).alias("d")
    bins = cells.select("box", "n", by_dim).groupBy("box", "d.dim", "d.bin").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("box", "dim")
    lower, all_ = F.sum("n").over(whole.orderBy("bin")), F.sum("n").over(whole)
    sums = bins.select("box", "dim", "bin", lower.alias("lower"), all_.alias("all"))
    allowed = (F.col("lower") >= k) & (F.col("all") - F.col("lower") >= k)
    off = F.struct(F.abs(F.col("lower") * 2 - F.col("all")), "bin")
    span = F.element_at(F.array(*[F.lit(w) for w in widest]), F.col("dim") + 1)
    found = sums.groupBy("box", "dim").agg(F.min_by("bin", F.when(allowed, off)).alias("cut"), (F.max("bin") - F.min("bin")).alias("width"))
    ranked = found.filter(F.col("cut").isNotNull()).withColumn("share", F.col("width") / span)
    return ranked.groupBy("box").agg(F.max_by(F.struct("dim", "cut"), F.struct("share", -F.col("dim"))).alias("c")).select("box", "c.*")


def boxed(cells: DataFrame, quasi: list[str], k: int, bins: int = BINS) -> DataFrame:
    """Cells (quasi, n) with the box they end in.

    The attribute with the widest range of bins, against that of the whole table, is cut, the first one of equals; the cut is the one nearest
    to half the box's records that leaves k or more on both sides, the lowest one of equals.
    """
    cells = _binned(cells, quasi, bins)
    tops = cells.agg(*[F.max(f"_bin{i}") for i in range(len(quasi))]).first()
    widest = [max(1, t or 0) for t in tops]
    open_, closed = cells.withColumn("box", F.lit(1).cast("long")), []
    while True:
        cuts = stage(_cuts(open_, len(quasi), widest, k))
        number = cuts.count()
        if not number:
            closed.append(open_)
            break
        moved = open_.join(F.broadcast(cuts) if number <= SENT else cuts, "box", "left")
        own: Column = F.element_at(F.array(*[F.col(f"_bin{i}") for i in range(len(quasi))]), F.col("dim") + 1)
        moved = stage(moved.withColumn("upper", F.when(F.col("dim").isNotNull(), (own > F.col("cut")).cast("int"))).drop("dim", "cut"))
        closed.append(moved.filter("upper is null").drop("upper"))
        open_ = moved.filter("upper is not null").withColumn("box", F.col("box") * 2 + F.col("upper")).drop("upper")
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.drop(*[f"_bin{i}" for i in range(len(quasi))])


def _range_text(low: str, high: str, missing: str) -> Column:
    span = F.when(F.col(low) == F.col(high), F.col(low).cast("string")).otherwise(F.concat(F.col(low).cast("string"), F.lit("-"), F.col(high).cast("string")))
    return F.concat_ws(" or ", F.when(F.col(missing), F.lit("unknown")), span)


def mondrian(df: DataFrame, quasi: list[str], k: int = K_ANONYMITY_THRESHOLD, bins: int = BINS) -> DataFrame:
    """Records with their quasi-identifiers widened to the range of their box, its ``class_size``, and ``suppressed``.

    Every box holds ``k`` records or more. Only a table of fewer than ``k`` cannot be split into such boxes: its quasi-identifiers are
    blanked. A range is ``low-high``, one value alone if they are equal; a box with missing values says ``unknown or`` before it. Records with
    equal quasi-identifiers stay together, nulls matching nulls.
    """
    cells = stage(df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n")))
    named = boxed(cells, quasi, k, bins)
    ends = [x for i, q in enumerate(quasi) for x in (F.min(q).alias(f"_low{i}"), F.max(q).alias(f"_high{i}"), F.bool_or(F.col(q).isNull()).alias(f"_none{i}"))]
    boxes = named.groupBy("box").agg(F.sum("n").alias("class_size"), *ends)
    texts = [_range_text(f"_low{i}", f"_high{i}", f"_none{i}").alias(f"_text{i}") for i in range(len(quasi))]
    wide = stage(named.select("box", *quasi).join(boxes.select("box", "class_size", *texts), "box").drop("box"))
    joined = _join_null_safe(df, wide, quasi)
    enough = F.col("class_size") >= k
    shown = {q: F.when(enough, F.col(f"_text{i}")) for i, q in enumerate(quasi)}
    return joined.withColumns(shown | {"suppressed": ~enough}).drop(*[f"_text{i}" for i in range(len(quasi))])
