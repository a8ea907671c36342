"""Chains of four overlapping items against plain loops, and a patient with very many events."""

import itertools
import random
from collections import Counter

import pytest

from caseweave.operators import chains

DAYS = 30


def brute(rows):
    found = set()
    for person in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == person]
        meet = lambda x, y: x[1] <= y[2] and x[2] >= y[1]
        for a in own:
            near = [e for e in own if e[0] > a[0] and a[1] <= e[1] <= a[1] + DAYS]
            for b, c, d in itertools.product(near, repeat=3):
                if b[0] < c[0] < d[0] and meet(a, b) and meet(b, c) and meet(c, d):
                    found.add((person, a[0], b[0], c[0], d[0]))
    return Counter(f[1:] for f in found)


def top(df, k):
    return sorted((-r.n, tuple(r)[:4]) for r in df.collect())[:k]


def frame(spark, rows):
    return spark.createDataFrame(rows, "person_id long, item long, first int, last int").repartition(4)


@pytest.mark.parametrize("most", [5, 1 << 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_top_chains(spark, seed, most):
    rng = random.Random(seed)
    rows = [(p, rng.randint(1, 7), first, first + rng.randint(-2, 20)) for p in range(25) for first in (rng.randint(0, 60) for _ in range(14))]
    rows = sorted(set(rows))
    want = sorted((-n, ids) for ids, n in brute(rows).items())
    for k in (1, 10):
        assert top(chains.top_chains(frame(spark, rows), DAYS, k, most=most), k) == want[:k]
    assert top(chains.top_chains(frame(spark, rows), DAYS, 5, floor=-want[4][0], most=most), 5) == want[:5]


def test_a_patient_with_thousands_of_events_in_two_months(spark):
    rng = random.Random(5)
    rows = [(0, item, day, day + 20) for item in range(5000) for day in [rng.randint(0, 59)]]
    rows += [(p, item, 10, 12) for p in (1, 2) for item in (7, 20, 30, 41)]
    (best,) = top(chains.top_chains(frame(spark, rows), DAYS, 1), 1)
    assert best[1] == (7, 20, 30, 41) and best[0] in (-2, -3)


def test_no_chains(spark):
    assert chains.top_chains(frame(spark, [(1, 1, 0, 5), (1, 2, 0, 5)]), DAYS, 10).count() == 0
