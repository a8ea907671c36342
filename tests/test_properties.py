"""Random small patients against brute force: sets, overlaps, periods, order, pruning and cut groups."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import groups, intervals, persons
from caseweave.plans import discovery
from conftest import concept, day


def random_rows(seed, people=12, items=7, rows=10, days=40, longest=15):
    rng = random.Random(seed)
    out = []
    for person in range(people):
        for _ in range(rng.randint(0, rows)):
            first = rng.randint(-5, days)
            out.append((person, rng.randint(1, items), first, first + rng.randint(-1, longest)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "person_id long, item long, first int, last int")


def brute_overlap(rows, size):
    found = set()
    by_person = itertools.groupby(sorted(rows), key=lambda r: r[0])
    for person, mine in by_person:
        mine = [r for r in mine if r[2] <= r[3]]
        for combo in itertools.combinations(sorted(mine, key=lambda r: r[1]), size):
            ids = [r[1] for r in combo]
            if len(set(ids)) == size and max(r[2] for r in combo) <= min(r[3] for r in combo):
                found.add((person, *ids))
    return found


def counts(found):
    out = {}
    for _, *ids in found:
        out[tuple(ids)] = out.get(tuple(ids), 0) + 1
    return out


def as_counts(df, size):
    return {tuple(r[f"i{n}"] for n in range(1, size + 1)): r["n"] for r in df.collect()}


@pytest.mark.parametrize("size", [2, 3, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_sets(spark, size, seed):
    rows = random_rows(seed)
    got = as_counts(discovery._overlapping(size)(frame(spark, rows)), size)
    assert got == counts(brute_overlap(rows, size))


@pytest.mark.parametrize("size", [2, 3])
def test_separate_sets(spark, size):
    rows = [r for r in random_rows(3) if r[2] <= r[3]]
    have = {(p, *ids) for p in {r[0] for r in rows} for ids in itertools.combinations(sorted({r[1] for r in rows if r[0] == p}), size)}
    got = as_counts(discovery._separate(size)(frame(spark, rows)), size)
    assert got == counts(have - brute_overlap(rows, size))


def test_cut_groups_lose_nothing(spark, monkeypatch):
    """One patient holds a third of the rows; groups of over two sets are cut into parts."""
    rng = random.Random(5)
    baskets = {(0, i) for i in range(60)} | {(rng.randint(1, 30), rng.randint(0, 59)) for _ in range(150)}
    df = spark.createDataFrame(sorted(baskets), "person_id long, item long")
    whole = as_counts(discovery._together(3)(df), 3)
    monkeypatch.setattr(groups, "SETS_PER_TASK", 2)
    cut = as_counts(discovery._together(3)(df), 3)
    assert cut == whole
    want = {}
    for p in {b[0] for b in baskets}:
        for ids in itertools.combinations(sorted(i for q, i in baskets if q == p), 3):
            want[ids] = want.get(ids, 0) + 1
    assert cut == want
    first = df.select("person_id", F.col("item").alias("a"))
    second = df.select("person_id", F.col("item").alias("b"))
    pairs = groups.pairs_across(first, second, F.col("a") != F.col("b"))
    assert pairs.count() == sum(n * (n - 1) for n in [sum(1 for b in baskets if b[0] == p) for p in {b[0] for b in baskets}])
    assert pairs.distinct().count() == pairs.count()


def test_parts_of_a_group_of_5000_items_hold_equal_numbers_of_triples(spark, monkeypatch):
    """The triples of each part are counted from its pairs of first and second items."""
    n, size = 5000, 3
    monkeypatch.setattr(groups, "SETS_PER_TASK", 400_000_000)
    df = spark.range(n).select(F.lit(1).alias("person_id"), F.col("id").alias("item"))
    ranked = groups._ranked(df, ["person_id"], size)
    first = groups.first_items(ranked, size).select("part", *[F.col(c).alias(f"{c}1") for c in ("n", "sets", "parts", "rank", "before")])
    second = groups.other_items(ranked).select("part", F.col("rank").alias("rank2"))
    pairs = first.join(second, "part").filter("rank1 < rank2").filter(groups._in_part(size))
    shares = [(r.n, r.triples) for r in pairs.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.lit(n - 1.0) - F.col("rank2")).alias("triples")).collect()]
    total = n * (n - 1) * (n - 2) // 6
    mean = total / len(shares)
    assert len(shares) == -(-total // 400_000_000) and sum(t for _, t in shares) == total
    assert sum(p for p, _ in shares) == n * (n - 1) // 2
    assert all(mean / 2 <= t <= 2 * mean for _, t in shares)


@pytest.mark.parametrize("size", [2, 3, 4])
def test_parts_of_a_cut_group_lose_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(groups, "SETS_PER_TASK", 7)
    df = spark.createDataFrame([(p, i, int(i % 3 == p)) for p in (0, 1) for i in range(9)], "person_id long, item long, fresh int")
    got = [(r.person_id, tuple(sorted(r[f"i{n}"] for n in range(1, size + 1)))) for r in groups.item_sets(df, ["person_id"], size).collect()]
    want = [(p, s) for p in (0, 1) for s in itertools.combinations(range(9), size) if any(i % 3 == p for i in s)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [2, 3])
def test_pruning_is_exact(spark, monkeypatch, size):
    """A few common items among many rare ones: pruning must drop items and keep the answer."""
    rng = random.Random(9)
    baskets = set()
    for person in range(60):
        baskets |= {(person, i) for i in range(5) if rng.random() < 0.8}
        baskets |= {(person, 100 + rng.randint(0, 200)) for _ in range(6)}
    df = spark.createDataFrame(sorted(baskets), "person_id long, item long")
    monkeypatch.setattr(groups, "seeds", lambda size: 4)
    count = discovery._together(size)
    kept = groups.prune_items(df, count, size, 3)
    assert kept.select("item").distinct().count() < df.select("item").distinct().count()
    columns = groups.set_columns(size)
    assert groups.top(count(kept), columns, 3).collect() == groups.top(count(df), columns, 3).collect()


def hits(rng, people=15, slots=3, rows=8, days=60):
    return [(1, p, rng.randrange(slots), rng.randint(0, days)) for p in range(people) for _ in range(rng.randint(0, rows))]


@pytest.mark.parametrize("days", [0, 5, 20])
def test_periods(spark, days):
    rows = hits(random.Random(days))
    df = spark.createDataFrame(rows, "instance_id long, person_id long, slot int, day int")
    got = {r["person_id"] for r in persons.having_all_within(df, 3, days).collect()}
    want = set()
    for p in {r[1] for r in rows}:
        by_slot = [[r[3] for r in rows if r[1] == p and r[2] == s] for s in range(3)]
        if any(max(c) - min(c) <= days for c in itertools.product(*by_slot)):
            want.add(p)
    assert got == want
    anyone = {r["person_id"] for r in persons.having_any(df).collect()}
    everyone = {r["person_id"] for r in persons.having_all(df, 3).collect()}
    assert got <= everyone <= anyone


@pytest.mark.parametrize("gap,strict", [(0, True), (10, False), (10, True)])
def test_after(spark, gap, strict):
    rows = hits(random.Random(gap + strict), slots=2)
    df = spark.createDataFrame(rows, "instance_id long, person_id long, slot int, day int")
    got = {r["person_id"] for r in persons.having_after(df.withColumns({"first": F.col("day"), "last": F.col("day")}), 0, 1, gap, strict).collect()}
    want = {
        p for p in {r[1] for r in rows}
        if any((b[3] - a[3] > gap) if strict else (b[3] - a[3] >= gap)
               for a in rows for b in rows if a[1] == b[1] == p and a[2] == 0 and b[2] == 1)
    }
    assert got == want


@pytest.mark.parametrize("days", [0, 3, 10])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_overlaps(spark, days, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(25):
        for _ in range(rng.randint(3, 9)):
            first = rng.randint(0, 30)
            rows.append((1, p, rng.randrange(3), first, first + rng.randint(0, 20)))
    df = spark.createDataFrame(rows, "instance_id long, person_id long, slot int, first int, last int")
    got = {r["person_id"] for r in persons.having_short_overlap(df, 3, days).collect()}
    want = set()
    for p in {r[1] for r in rows}:
        by_slot = [[r for r in rows if r[1] == p and r[2] == s] for s in range(3)]
        for combo in itertools.product(*by_slot):
            if 0 <= min(r[4] for r in combo) - max(r[3] for r in combo) <= days:
                want.add(p)
    assert got == want


def test_open_intervals_are_cut_at_the_data(spark):
    rows = [(1, 1, 0, 2932896), (1, 2, 100, 2932896), (1, 3, 50, 60)]
    active = intervals.active_on_start_days(frame(spark, rows), ["person_id"], open_ended=True)
    assert {(r["day"], r["item"]) for r in active.collect()} == {(0, 1), (50, 1), (50, 3), (100, 1), (100, 2)}


def test_chain_overlap(spark, tiny):
    """Four drugs in id order, neighbours overlapping, starts 0 to 30 days after the first, across cells."""
    rng = random.Random(4)
    rows = [(n, p, rng.randint(1, 6), day(s := rng.randint(0, 90)), day(s + rng.randint(0, 25))) for n, p in enumerate(
        [p for p in range(20) for _ in range(9)])]
    names = [concept(i, f"d{i}", "Drug", "RxNorm") for i in range(1, 7)]
    got = {tuple(r)[:4]: r["person_count"] for r in discovery.drug_quads_chain_overlap(tiny(drug_exposure=rows, concept=names), None).collect()}
    want = {}
    for p in range(20):
        mine = sorted((r for r in rows if r[1] == p), key=lambda r: r[2])
        found = set()
        for c in itertools.combinations(mine, 4):
            rising = all(x[2] < y[2] for x, y in zip(c, c[1:]))
            chained = all(x[3] <= y[4] and x[4] >= y[3] for x, y in zip(c, c[1:]))
            if rising and chained and all(0 <= (x[3] - c[0][3]).days <= 30 for x in c[1:]):
                found.add(tuple(f"d{x[2]}" for x in c))
        for f in found:
            want[f] = want.get(f, 0) + 1
    assert got == want


def skewed(seed):
    """One patient holds a third of all rows."""
    rows = random_rows(seed, people=10, items=9, rows=8)
    rng = random.Random(seed)
    return rows + [(99, rng.randint(1, 9), first := rng.randint(0, 60), first + rng.randint(0, 10)) for _ in range(len(rows) // 2)]


def test_cut_groups_in_overlaps(spark, monkeypatch):
    rows = skewed(6)
    monkeypatch.setattr(groups, "SETS_PER_TASK", 2)
    got = as_counts(discovery._overlapping(3)(frame(spark, rows)), 3)
    assert got == counts(brute_overlap(rows, 3))


def test_cut_groups_in_order(spark, monkeypatch):
    rows = skewed(8)
    df = frame(spark, rows).groupBy("person_id", "item").agg(F.min("first").alias("first"), F.max("first").alias("last"))
    monkeypatch.setattr(groups, "SETS_PER_TASK", 2)
    cut = {(r["a"], r["b"]): r["n"] for r in discovery._followed(df, df, 5, False).collect()}
    want = {}
    for p in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == p]
        for pair in {(x[1], y[1]) for x in mine for y in mine if x[1] != y[1] and y[2] - x[2] >= 5}:
            want[pair] = want.get(pair, 0) + 1
    assert cut == want


@pytest.mark.parametrize("size, k", [(3, 3), (4, 5), (3, 10_000)])
def test_sets_grown_from_frequent_pairs_hold_the_best(spark, size, k):
    """A common core, rare items, two items of one label, and a k that no floor reaches."""
    rng = random.Random(size)
    baskets = {(p, i) for p in range(40) for i in range(7) if rng.random() < 0.5} | {(p, 100 + rng.randint(0, 60)) for p in range(40) for _ in range(4)}
    label = lambda i: 5 if i == 6 else i
    df = spark.createDataFrame([(p, i, label(i)) for p, i in sorted(baskets)], "person_id long, item long, label long")
    want = {}
    for p in range(40):
        for ids in {tuple(map(label, ids)) for ids in itertools.combinations(sorted(i for q, i in baskets if q == p), size)}:
            want[ids] = want.get(ids, 0) + 1
    got = as_counts(groups.frequent_sets(df, size, k), size)
    best = lambda counts: sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:k]
    assert best(got) == best(want)


def test_undated_eras_are_separate(spark, tiny):
    """An era without a start or an end overlaps nothing; its patient has both items apart."""
    ids = [concept(1, "a"), concept(2, "b")]
    era = [(1, 1, day(0), day(9)), (1, 2, None, day(9)), (2, 1, day(0), day(9)), (2, 2, day(5), None), (3, 1, day(0), day(9)), (3, 2, day(5), day(6))]
    found = discovery.condition_pairs_separate(tiny(concept=ids, condition_era=era)).collect()
    assert [(r["condition1_name"], r["condition2_name"], r["person_count"]) for r in found] == [("a", "b", 2)]


def test_hits_of_nobody_overlap_nothing(spark):
    rows = [(1, p, slot, 0, 9) for p in (None, 7) for slot in range(2)]
    df = spark.createDataFrame(rows, "instance_id long, person_id long, slot int, first int, last int")
    assert [r["person_id"] for r in persons.having_short_overlap(df, 2, 30).collect()] == [7]
