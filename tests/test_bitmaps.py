"""Item sets by vertical bitmaps against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from caseweave.operators import bitmaps, sweep


def baskets(seed, people, items, most):
    rng = random.Random(seed)
    return [(p, i) for p in range(people) for i in rng.sample(range(1, items + 1), rng.randint(0, min(most, items)))]


def brute(rows, size):
    own = {}
    for person, item in rows:
        own.setdefault(person, set()).add(item)
    return Counter(s for items in own.values() for s in itertools.combinations(sorted(items), size))


def best(counts, k):
    return sorted(((-n, ids) for ids, n in counts.items()))[:k]


def top(df, size, k):
    return sorted((-r["n"], tuple(r[f"i{j}"] for j in range(1, size + 1))) for r in df.collect())[:k]


def together(df, size, k, **more):
    return top(bitmaps.top_sets(bitmaps.baskets_of(df), size, k, **more), size, k)


@pytest.mark.parametrize("size", [3, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_top_sets(spark, seed, size):
    rows = baskets(seed, 60, 12, 9)
    df = spark.createDataFrame(rows, "person_id long, item long")
    for k in (1, 10):
        assert together(df, size, k) == best(brute(rows, size), k)


@pytest.mark.parametrize("most", [7, 20])
def test_items_of_many_patients_have_several_ranges(spark, most):
    rows = baskets(3, 80, 9, 7) + [(p, 0) for p in range(80)]
    df = spark.createDataFrame(rows, "person_id long, item long")
    counts = brute(rows, 3)
    floor = -best(counts, 10)[-1][0] - 1
    assert together(df, 3, 10, floor=floor, most=most) == best(counts, 10)
    assert together(df, 3, 10, most=most) == best(counts, 10)


def test_few_or_no_sets(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "person_id long, item long")
    assert together(df, 3, 10) == [(-1, (1, 2, 3))]
    assert together(df, 4, 10) == together(df.limit(0), 3, 10) == []


def test_ties_go_to_lower_ids(spark):
    rows = [(p, i) for p in range(4) for i in range(p * 5, p * 5 + 5)]
    df = spark.createDataFrame(rows, "person_id long, item long")
    assert together(df, 3, 5) == [(-1, s) for s in itertools.islice(itertools.combinations(range(5), 3), 5)]


def events(seed, people=30, items=8, most=14):
    rng = random.Random(seed)
    return [(p, rng.randint(1, items), first, first + rng.randint(-1, 12)) for p in range(people) for first in (rng.randint(-5, 60) for _ in range(rng.randint(0, most)))]


def meetings(rows, size):
    """(person, ids) of the sets of different items that are under way on one day."""
    found = set()
    for person in {r[0] for r in rows}:
        for day in range(-5, 80):
            active = sorted({i for p, i, first, last in rows if p == person and first <= day <= last})
            found |= {(person, s) for s in itertools.combinations(active, size)}
    return found


@pytest.mark.parametrize("cell_days", [7, 1024])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep_finds_all_that_overlaps(spark, seed, cell_days):
    rows = events(seed)
    df = spark.createDataFrame(rows, "person_id long, item long, first int, last int").repartition(3)
    pairs = {(r[0], (r[1], r[2])) for r in sweep.overlapping_pairs(df, cell_days).collect()}
    assert pairs == meetings(rows, 2)
    cliques = sweep.cliques(df, 3, cell_days).collect()
    assert all(list(r["items"]) == sorted(set(r["items"])) for r in cliques)
    assert {(r.person_id, s) for r in cliques for s in itertools.combinations(r["items"], 3)} == meetings(rows, 3)


@pytest.mark.parametrize("size", [3, 4])
@pytest.mark.parametrize("most", [9, 1 << 16])
def test_overlapping_and_separate_sets(spark, size, most):
    rows = events(5, people=40, items=6)
    df = spark.createDataFrame(rows, "person_id long, item long, first int, last int")
    lists, meet = sweep.cliques(df, size, 16), meetings(rows, size)
    overlapping = Counter(ids for _, ids in meet)
    assert top(bitmaps.top_sets(lists, size, 8, what=bitmaps.OVERLAPPING, most=most), size, 8) == best(overlapping, 8)
    have = brute([(p, i) for p, i, *_ in rows], size)
    separate = Counter({ids: n - overlapping[ids] for ids, n in have.items() if n > overlapping[ids]})
    both = bitmaps.baskets_of(df).unionByName(lists)
    assert top(bitmaps.top_sets(both, size, 8, what=bitmaps.SEPARATE, most=most), size, 8) == best(separate, 8)


def test_a_long_stretch_over_several_batches(spark):
    rows = [(1, i, i // 7, i // 7 + 2) for i in range(400)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        df = spark.createDataFrame(rows, "person_id long, item long, first int, last int").repartition(3)
        pairs = {(r[1], r[2]) for r in sweep.overlapping_pairs(df, 40).collect()}
        sets = {s for r in sweep.cliques(df, 3, 40).collect() for s in itertools.combinations(r["items"], 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs == sets == {(a, b) for a in range(400) for b in range(a + 1, 400) if b // 7 <= a // 7 + 2}


@pytest.mark.parametrize("size", [3, 4])
def test_sets_are_counted_by_their_pairs(monkeypatch, size):
    """A unit of few frequent pairs is not searched item by item."""
    rng = random.Random(8)
    rows = [sorted(rng.sample(range(1, 200), 9)) for _ in range(300)] + [[3, 50, 90, 120]] * 4
    unit = bitmaps.Unit(np.zeros(len(rows), bool), np.arange(len(rows)), np.array([len(r) for r in rows]), np.concatenate(rows))
    counts = Counter((0, *s) for r in rows for s in itertools.combinations(r, size - 1))
    for joined in (bitmaps.JOINED, 0):  # with 0 all sets of four are searched depth first
        monkeypatch.setattr(bitmaps, "JOINED", joined)
        if joined:
            monkeypatch.setattr(bitmaps.Search, "_grow", lambda *_: pytest.fail("searched item by item"))
        search = bitmaps.Search(size, 10, 3)
        search.unit(0, unit)
        assert search.best == [b for b in best(counts, 10) if -b[0] >= 3]
        monkeypatch.undo()


def test_pairs_of_a_unit_in_many_blocks(monkeypatch):
    """Small tables: rows and items are taken part by part, with the same counts."""
    rng = random.Random(9)
    rows = [(p, sorted(rng.sample(range(1, 30), 8))) for p in range(40) for _ in range(rng.randint(1, 4))]
    unit = bitmaps.Unit(np.ones(len(rows), bool), np.array([p for p, _ in rows]), np.array([8] * len(rows)), np.concatenate([r for _, r in rows]))
    counts = Counter(ids for _, ids in {(p, (0, *s)) for p, r in rows for s in itertools.combinations(r, 3)})
    for cells in (bitmaps.CELLS, 100):
        monkeypatch.setattr(bitmaps, "CELLS", cells)
        search = bitmaps.Search(4, 12, 2, bitmaps.OVERLAPPING)
        search.unit(0, unit)
        assert search.best == best(counts, 12)


def test_events_of_one_item_are_one_member_of_a_clique(spark):
    rows = [(1, 1, d, d + 3) for d in range(0, 30, 2)] + [(1, 2, 0, 40), (1, 3, 20, 25)]
    df = spark.createDataFrame(rows, "person_id long, item long, first int, last int")
    assert [r["items"] for r in sweep.cliques(df, 2).collect()] == [[1, 2, 3]]
