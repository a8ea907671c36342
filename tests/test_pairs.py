"""Pairs by their first item against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseweave import storage
from caseweave.operators import groups, pairs, sweep
from caseweave.plans import discovery

ENDS = "person_id long, item long, first int, last int"


def best(counts, k):
    return sorted(((-n, ids) for ids, n in counts.items()))[:k]


def top(df, columns, k):
    return sorted((-r["n"], tuple(r[c] for c in columns)) for r in df.collect())[:k]


def made(seed):
    """(person, item, first, last): one patient of 40 items, a null patient, undated items."""
    rng = random.Random(seed)
    own = {(p, i) for p in range(40) for i in rng.sample(range(50, 95), rng.randint(0, 9))} | {(0, i) for i in range(50, 90)} | {(None, i) for i in range(50, 90)}
    out = []
    for p, i in sorted(own, key=repr):
        a, b = sorted((rng.randint(0, 60), rng.randint(0, 60)))
        out.append((p, i, None, None) if rng.random() < 0.05 else (p, i, a, b))
    return out


def brute(rows, wanted):
    return Counter((a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and wanted(a, b))


@pytest.mark.parametrize("most,cut", [(1 << 16, 1_000_000), (3, 7)])
@pytest.mark.parametrize("k", [1, 10, 100_000])
def test_pairs_of_patients(spark, monkeypatch, most, cut, k):
    """Also with items in several ranges and patients in several parts."""
    monkeypatch.setattr(groups, "SETS_PER_TASK", cut)
    rows = made(k)
    df = spark.createDataFrame(rows, ENDS)
    baskets = df.select("person_id", "item")
    got = pairs.top_pairs(pairs.within(baskets), groups.item_support(baskets), ("i1", "i2"), k, most)
    assert top(got, ("i1", "i2"), k) == best(brute(rows, lambda a, b: a[1] < b[1]), k)
    both = df.withColumns({"earlier": F.lit(True), "later": F.lit(True)})
    got = pairs.top_pairs(pairs.across(both, 10, True), groups.item_support(baskets), ("a", "b"), k, most)
    apart = lambda a, b: a[1] != b[1] and a[2] is not None and b[3] is not None and b[3] - a[2] > 10
    assert top(got, ("a", "b"), k) == best(brute(rows, apart), k)


@pytest.mark.parametrize("other", [False, True])
def test_followed_with_and_without_k(spark, other):
    df = spark.createDataFrame(made(5), ENDS)
    later = spark.createDataFrame(made(6), ENDS) if other else None
    whole = discovery._followed(df, later, 5, False)
    assert top(discovery._followed(df, later, 5, False, 20), ("a", "b"), 20) == top(whole, ("a", "b"), 20)


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs_over_batches(size):
    """A first item's rows may lie in any number of batches."""
    rng = random.Random(size)
    rows = sorted((f, part, [rng.randint(0, 5) for _ in range(rng.randint(1, 4))]) for f in range(6) for part in (-1, 0) for _ in range(rng.randint(0, 9)))
    rows = [(f, part, sorted(set(o))) for f, part, o in rows]
    table = pa.table({"first": [r[0] for r in rows], "range": pa.array([r[1] for r in rows], pa.int32()), "others": [r[2] for r in rows]})
    got = [tuple(map(int, x)) for columns in pairs._runs(iter(table.to_batches(size))) for x in zip(*columns, strict=True)]
    want = Counter((f, part, o) for f, part, others in rows for o in others)
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want


def test_pairs_are_no_rows(spark):
    """A pair is a number in a list until it is counted."""
    baskets = spark.createDataFrame([(p, i) for p in range(5) for i in range(40)], "person_id long, item long")
    assert pairs.within(baskets).count() == 5 * 39


def test_tasks_hold_a_share_that_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(pairs, "NUMBERS_PER_TASK", 10)
    baskets = spark.createDataFrame([(p, i) for p in range(5) for i in range(40)], "person_id long, item long")
    lists = pairs.lists_of(baskets)
    numbers = pairs.numbers_within(lists)
    assert numbers == 5 * 40 * 39 / 2
    assert storage.many_parts(spark, numbers, 10) == 390 and storage.many_parts(spark, 10, 10) == 0
    dealt = storage.dealt_out(pairs.within_lists(lists), numbers, "first", per_task=10)
    assert dealt.rdd.getNumPartitions() == 390
    got = pairs.top_pairs(pairs.within_lists(lists), groups.item_support(baskets), ("i1", "i2"), 10, numbers=numbers)
    assert top(got, ("i1", "i2"), 10) == [(-5, (0, i)) for i in range(1, 11)]


def test_pairs_of_repeated_overlaps_and_unknown_patients(spark):
    rows = [(p, i, 0, 5) for p in (1, 2, None) for i in (10, 11, 12)] * 3 + [(1, 13, 5000, 5001), (2, 13, 5, 9)]
    rows = spark.createDataFrame(rows, ENDS).filter("person_id IS NOT NULL")
    found = sweep.overlapping_pairs(rows, amount=1 << 24)
    assert len(found.collect()) == 9
    lists = pairs.of_pairs(found.unionByName(found))
    support = lists.groupBy(F.col("first").alias("item")).agg(F.count("*").alias("n"))
    assert top(pairs.top_pairs(lists, support, ("i1", "i2"), 10), ("i1", "i2"), 10) == [(-2, (10, 11)), (-2, (10, 12)), (-2, (11, 12)), (-1, (10, 13)), (-1, (11, 13)), (-1, (12, 13))]
