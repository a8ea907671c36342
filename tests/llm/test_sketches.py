"""Sketches that judge pairs before their texts move: links are not denied, pairs far from one are."""

import numpy as np
import pytest

from caseweave.llm import neardup


def judged(size, similarity, trials, seed):
    """How many of so many random pairs of sets of about one similarity are let through."""
    rng = np.random.default_rng(seed)
    shared = int(np.ceil(2 * size * similarity / (1 + similarity)))  # the similarity or a little more
    yes = 0
    for _ in range(trials):
        draw = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64) * np.uint64(2)
        one, other = np.sort(draw[:size]), np.sort(np.concatenate([draw[:shared], draw[size : 2 * size - shared]]))
        rows = neardup.sketches(np.concatenate([one, other]), np.array([size, size]))
        ok, share = neardup.may_link(rows[:1], rows[1:], np.array([size]), np.array([size]), 80)
        assert 0 <= share[0] <= 1
        yes += bool(ok[0])
    return yes


@pytest.mark.parametrize("size", [5, 40, 150, 300, 1000, 5000])
def test_sets_at_the_limit_are_let_through(size):
    assert judged(size, 0.8, 400, size) >= 398


@pytest.mark.parametrize("size", [150, 300, 1000, 5000])
def test_sets_far_from_the_limit_are_not(size):
    assert judged(size, 0.62, 200, size) <= 10


def test_empty_sets_and_unequal_sizes():
    rows = neardup.sketches(np.zeros(0, np.uint64), np.array([0, 0]))
    assert not rows.any() and rows.shape == (2, neardup.SKETCH)
    ok, _ = neardup.may_link(rows[:1], rows[1:], np.array([0]), np.array([3]), 80)
    assert not ok[0]


def test_gathered_buckets_lose_no_pair_and_save_comparisons(spark):
    """Buckets of random subsets of alike groups, a hot one among them, against all pairs that share one."""
    rng = np.random.default_rng(3)
    groups = [range(0, 60), range(60, 64), range(50, 75), range(200, 202)]
    rows = [(10 * g + band, int(x), int(x) % 7) for g, group in enumerate(groups) for band in range(8) for x in group if rng.random() < 0.8]
    members = lambda found: {k: {r for key, r, _ in found if key == k} for k, _, _ in found}
    pairs = lambda buckets: {(a, b) for m in buckets.values() for a in m for b in m if a < b}
    got = [tuple(r) for r in neardup._gathered(spark.createDataFrame(rows, "key long, rep long, component long")).collect()]
    before, after = members(rows), members(got)
    assert len(got) == len(set(got)) and pairs(before) <= pairs(after) and {(r, c) for _, r, c in got} == {(r, c) for _, r, c in rows}
    assert sum(len(m) ** 2 for m in after.values()) < sum(len(m) ** 2 for m in before.values()) / 3
    assert neardup._gathered(spark.createDataFrame([], "key long, rep long, component long")).count() == 0


def test_only_shared_band_keys_and_texts_of_pairs_move(spark):
    long_text = " ".join(f"word{n}" for n in range(200))
    docs = spark.createDataFrame([(1, long_text), (2, long_text + " more"), (3, "nothing like the others at all"), (4, None)], "doc_id long, text string")
    described = neardup.describe(docs)
    copies = spark.createDataFrame([], "a long, b long, high long, low long")
    members = neardup._candidates(described, copies)
    assert {r["rep"] for r in members.collect()} == {1, 2}
    assert "Generate" not in members._jdf.queryExecution().executedPlan().toString()  # what is unique was left behind in a first count
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    links = neardup.confirm(pairs, docs, 4, 80)
    assert [tuple(r) for r in links.collect()] == [(1, 2)]
    assert links._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
