"""Order indexes against sorted lists, Mondrian boxes against the same cuts in plain code."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselight.operators.mondrian import BINS, mondrian
from caselight.operators.ordering import open_order_index, rows_between, running_total, write_order_index
from caselight.operators.privacy import suppress_small_classes


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(9)) for i in rng.sample(range(100000), 3000)] + [(None, 4)]
    got = running_total(spark.createDataFrame(rows, "v long, n long"), [F.asc_nulls_first("v")], "n", "before").collect()
    want, before = {}, 0
    for v, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        want[v], before = before, before + n
    assert {r["v"]: r["before"] for r in got} == want
    assert running_total(spark.createDataFrame([], "v long, n long"), [F.col("v")], "n", "before").collect() == []


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(f"s{i:05d}", 0 if rng.random() < 0.4 else rng.randrange(50)) for i in range(7001)]  # many rows of one day
    folder = str(tmp_path_factory.mktemp("index"))
    write_order_index(spark.createDataFrame(rows, "id string, day int").repartition(6), [F.desc("day"), F.asc("id")], folder)
    return sorted(rows, key=lambda r: (-r[1], r[0])), open_order_index(spark, folder)


def test_pages_of_an_order_index(spark, indexed):
    want, index = indexed
    assert index.total == len(want) and len(index.ranges) > 3
    for first, last in [(0, 25), (3500, 3525), (6990, 7015), (7001, 7050), (0, 7001), (index.ranges[1][1] - 3, index.ranges[1][1] + 3)]:
        got = sorted(rows_between(spark, index, first, last).collect(), key=lambda r: r["place"])
        assert [(r["id"], r["day"]) for r in got] == want[first:last]
        assert [r["place"] for r in got] == list(range(first, min(last, len(want))))


def test_a_page_reads_only_its_ranges(spark, indexed):
    _, index = indexed
    plan = rows_between(spark, index, 5000, 5020)._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(place,5000)" in plan and "LessThan(place,5020)" in plan


def test_index_without_rows(spark):
    index = write_order_index(spark.createDataFrame([], "id string, day int"), [F.col("id")])
    assert index.total == 0 and rows_between(spark, index, 0, 10).collect() == []


# ---------------------------------------------------------------- boxes

def plain_boxes(rows, k):
    """Ranges of each record's box, by the same rule, box after box."""
    low_first = lambda v: (v is not None, v if v is not None else 0)
    dims, bins = range(len(rows[0])), []
    for d in dims:
        counts, before, own = Counter(r[d] for r in rows), 0, {}
        for v in sorted(counts, key=low_first):
            own[v], before = before * BINS // len(rows), before + counts[v]
        bins.append(own)
    widest = [max(1, max(b.values())) for b in bins]
    out = {}

    def cut(members):
        best = None
        for d in dims:
            counts = sorted(Counter(bins[d][r[d]] for r in members).items())
            lower, found = 0, None
            for b, n in counts:
                lower += n
                if lower >= k and len(members) - lower >= k:
                    found = min(found or (abs(2 * lower - len(members)), b), (abs(2 * lower - len(members)), b))
            if found:
                share = (counts[-1][0] - counts[0][0]) / widest[d]
                if best is None or share > best[0]:
                    best = (share, d, found[1])
        if best:
            _, d, b = best
            cut([r for r in members if bins[d][r[d]] <= b])
            cut([r for r in members if bins[d][r[d]] > b])
            return
        texts = []
        for d in dims:
            held = sorted({r[d] for r in members if r[d] is not None})
            span = [] if not held else [str(held[0])] if len(held) == 1 else [f"{held[0]}-{held[-1]}"]
            texts.append(" or ".join(["unknown"] * any(r[d] is None for r in members) + span))
        for r in members:
            out[r] = (len(members), *texts)

    cut(rows)
    return out


@pytest.mark.parametrize("k,n", [(5, 900), (2, 300), (40, 500)])
def test_mondrian_against_plain_code(spark, k, n):
    rng = random.Random(k)
    rows = [(rng.choice([None, *range(90)]), rng.choice(["a", "b", "c", "ü", None]), rng.choice(["M", "F"])) for _ in range(n)]
    rows += [(33, "b", "F")] * (n // 2)  # a hot record
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, age int, city string, gender string")
    got = mondrian(frame, ["age", "city", "gender"], k).collect()
    want = plain_boxes(rows, k)
    assert {r["id"]: (r["class_size"], r["age"], r["city"], r["gender"]) for r in got} == {i: want[r] for i, r in enumerate(rows)}
    assert len(got) == len(rows) and not any(r["suppressed"] for r in got)
    assert min(Counter((r["age"], r["city"], r["gender"]) for r in got).values()) >= k


def test_mondrian_blanks_nothing_that_suppression_blanks(spark, small):
    from caselight.plans.bindings import Tables

    people, quasi = Tables(spark, small).view("patients"), ["age", "city", "hospital", "gender"]
    blanked = suppress_small_classes(people, quasi).filter("suppressed").count()
    found = mondrian(people, quasi)
    assert blanked > 0 and found.filter("suppressed").count() == 0 and found.count() == people.count()


def test_mondrian_of_tiny_tables(spark):
    three = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "id long, age int")
    assert sorted(map(tuple, mondrian(three, ["age"]).collect())) == [(i, None, 3, True) for i in (1, 2, 3)]
    assert mondrian(three.limit(0), ["age"]).collect() == []
