"""Packed lists against plain ones, and the search of lowest items first."""

import random
from collections import Counter

import pytest

from caseweave.operators import bitmaps, packed, sweep
from tests.test_bitmaps import best, brute, events, meetings, top

SCHEMA = "person_id long, item long"


def many_items(seed, people=120, items=400, most=14, scale=1):
    rng = random.Random(seed)
    return [(p, scale * i - 5) for p in range(people) for i in rng.sample(range(1, items + 1), rng.randint(0, most))]


@pytest.mark.parametrize("most", [2, bitmaps.RANGE])
@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 40])
def test_lowest_items_first(spark, scale, most):
    """There are more items than those that are searched first, with ties over all of them; ids need 2, 4 or 8 bytes."""
    rows = many_items(4, scale=scale)
    assert len({i for _, i in rows}) > bitmaps.EARLY * bitmaps.LATE
    lists = packed.baskets(spark.createDataFrame(rows * 2, SCHEMA), 3)
    assert top(bitmaps.top_sets(lists, 3, 7, most=most), 3, 7) == best(brute(rows, 3), 7)


def test_late_items_win(spark):
    rows = many_items(5) + [(p, i) for p in range(1000, 1030) for i in (390, 391, 392, 393)]
    lists = packed.baskets(spark.createDataFrame(rows, SCHEMA), 4)
    assert top(bitmaps.top_sets(lists, 4, 3), 4, 3) == best(brute(rows, 4), 3)


def test_nobodys_items_are_one_basket(spark):
    rows = [(None, 1), (None, 2), (None, 3), (None, 3), (None, None), (0, 1), (0, 2), (0, 3), (0, None), (7, 3), (7, 4)]
    lists = packed.baskets(spark.createDataFrame(rows, SCHEMA).repartition(3), 3)
    assert top(bitmaps.top_sets(lists, 3, 5), 3, 5) == [(-2, (1, 2, 3))]


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_packed_cliques_and_baskets(spark, batch):
    rows = events(6, people=40, items=6)
    df = spark.createDataFrame(rows, "person_id long, item long, first int, last int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        both = packed.baskets(df, 3).unionByName(sweep.packed_cliques(df, 3))
        found = top(bitmaps.top_sets(both, 3, 8, what=bitmaps.SEPARATE), 3, 8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    overlapping = Counter(ids for _, ids in meetings(rows, 3))
    have = brute([(p, i) for p, i, *_ in rows], 3)
    assert found == best(Counter({ids: n - overlapping[ids] for ids, n in have.items() if n > overlapping[ids]}), 8)


def test_lists_move_in_few_rows(spark):
    """What is shuffled has a row for an item and a task, not for each list and item."""
    rows = [(p, i) for p in range(2000) for i in range(10)]
    lists = packed.baskets(spark.createDataFrame(rows, SCHEMA).coalesce(1), 3)
    moved = packed.rests(lists, 3, {}).select("first", "persons").collect()
    assert sum(len(r.persons) for r in moved) == 2000 * 8 * 8
    assert len(moved) <= 8 * lists.rdd.getNumPartitions()
