"""Heads: the most common items by sketch and recount, and the first rows of every group."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseweave.operators import heads, ranking


@pytest.mark.parametrize("width", [8, 20, 1 << 16])
@pytest.mark.parametrize("skew", [1.0, 3.0])
def test_most_common_items_are_exact(spark, width, skew):
    rng = random.Random(7)
    rows = [(rng.randint(1, 40), int(60 * rng.random() ** skew)) for _ in range(1500)]
    df = spark.createDataFrame(rows * 2, "person_id long, item long").repartition(6)
    counts = Counter(item for _, item in set(rows))
    for k in (1, 7, 100):
        want = sorted(counts, key=lambda i: (-counts[i], i))[:k]
        assert sorted(r.item for r in heads.most_common(df, k, width=width).collect()) == sorted(want)


def test_a_sketch_is_bounded_and_too_low_by_what_it_says(spark):
    rng = random.Random(3)
    items = [int(500 * rng.random() ** 2) for _ in range(4000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = heads.sketch(spark.createDataFrame([(n, i) for n, i in enumerate(items)], "person_id long, item long").coalesce(1), width=30).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (low,) = [r.low for r in rows if r.item is None]
    counters, true = {r.item: r.n for r in rows if r.item is not None}, Counter(items)
    assert len(counters) <= 60 and low > 0
    assert all(counters.get(i, 0) <= n <= counters.get(i, 0) + low for i, n in true.items())


def test_head_of_every_group_with_one_hot_group(spark):
    rows = [(2000 if n % 3 else 1990 + n % 9, n, n * 7919 % 101) for n in range(3000)]
    df = spark.createDataFrame(rows, "year int, item int, n int").repartition(5)
    got = {(r.year, r.item) for r in ranking.head_per_group(df, "year", [F.desc("n"), "item"], 20, parts=4).collect()}
    want = set()
    for year in {r[0] for r in rows}:
        want |= {(year, i) for _, i in sorted((-n, i) for y, i, n in rows if y == year)[:20]}
    assert got == want


def test_no_rows(spark):
    empty = spark.createDataFrame([], "person_id long, item long")
    assert heads.most_common(empty, 5).count() == 0
