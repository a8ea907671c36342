"""The k most frequent chains of four items: a < b < c < d in one patient, each overlapping the next, and
b, c and d all starting within some days from a's start.

Followers of an event are found by a sweep: sorted by start they are one run of rows. The search is then
divided by the first item. Its *unit* has a row for each event of it with all followers; it is searched
depth first in the order of ids, and what has fewer patients than the floor is not followed. Once the
k best so far are k sets, a later one must have more patients than the last of them, as its ids are higher.
So a patient with thousands of events in a month is no more than one patient of each chain, and their
chains are not listed.

An item with very many rows has several units, each with a range of its patients, as in ``bitmaps.py``:
candidates by their share of the floor, then counted in all ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseweave.operators.bitmaps import RANGE, Search
from caseweave.operators.sweep import CELL_DAYS, PAIRS_AT_ONCE, _stretches
from caseweave.storage import keep

SIZE = 4


def followers(rows: DataFrame, days: int, cell_days: int = CELL_DAYS) -> DataFrame:
    """(first, person_id, begin, end, items, starts, ends): each event with those of higher items that start up to ``days`` after it."""
    cell = lambda c: F.floor(c / cell_days).cast("int")
    start = F.col("first")
    spread = rows.select("person_id", F.explode(F.sequence(cell(start - days), cell(start))).alias("cell"), "item", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))
    dealt = spread.repartition("person_id", "cell").sortWithinPartitions("person_id", "cell", "first")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for person, at, item, first, last in _stretches(batches):
            stretch = np.cumsum(np.append(False, (person[1:] != person[:-1]) | (at[1:] != at[:-1])))
            wide = int(first.max()) - int(first.min()) + days + 2
            place = stretch * wide + (first - first.min())
            low, high = np.searchsorted(place, place, side="left"), np.searchsorted(place, place + days, side="right")
            own = np.flatnonzero(first // cell_days == at)  # an event begins in one stretch
            ends = np.cumsum((high - low)[own])
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
                some = own[a:b]
                many = (high - low)[some]
                left = np.repeat(np.arange(len(some)), many)
                right = low[some][left] + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
                higher = item[right] > item[some][left]
                left, right = left[higher], right[higher]
                sizes = np.bincount(left, minlength=len(some))
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c[right])) for c in (item, first, last)]
                columns = [pa.array(c[some]) for c in (item, person, first, last)]
                table = pa.RecordBatch.from_arrays([*columns, *lists], names=["first", "person_id", "begin", "end", "items", "starts", "ends"])
                yield table.filter(pa.array(sizes >= SIZE - 1))
                a = b

    return dealt.mapInArrow(found, "first long, person_id long, begin int, end int, items array<long>, starts array<int>, ends array<int>")


class Followers(NamedTuple):
    """A unit: per event its patient's number and its followers' range, and the followers in a row."""

    person: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    event: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, columns: list[np.ndarray]) -> Followers:
        person, begin, end, sizes, item, starts, ends = columns
        high = np.cumsum(sizes)
        return cls(np.unique(person, return_inverse=True)[1], begin, end, high - sizes, high, np.repeat(np.arange(len(person)), sizes), item, starts, ends)

    def second(self) -> np.ndarray:
        """Followers that overlap their event."""
        return np.flatnonzero((self.begin[self.event] <= self.ends) & (self.end[self.event] >= self.starts))

    def next(self, at: np.ndarray) -> np.ndarray:
        """Followers of the same events, of higher items, that overlap one of those at ``at``."""
        event = self.event[at]
        many = (self.high - self.low)[event]
        left = np.repeat(at, many)
        right = np.repeat(self.low[event] - np.cumsum(many) + many, many) + np.arange(many.sum())
        meet = (self.item[right] > self.item[left]) & (self.starts[left] <= self.ends[right]) & (self.ends[left] >= self.starts[right])
        return np.unique(right[meet])

    def patients(self, at: np.ndarray) -> int:
        return len(np.unique(self.person[self.event[at]]))

    def by_item(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of some followers in order, and the patients of each."""
        pairs = np.unique(np.stack([self.item[at], self.person[self.event[at]]]), axis=1)
        return np.unique(pairs[0], return_counts=True)


class ChainSearch(Search):
    def _needs(self, first: int) -> int:
        if self.share:
            return -(-self.floor // self.share)
        return self.floor + (len(self.best) == self.k)

    def unit(self, first: int, unit: Followers, share: int = 0) -> list[tuple[int, tuple[int, ...]]]:
        self.share, self.found = share, []
        if share:
            held = self.best, self.floor
            self.best = []
        if unit.patients(np.arange(len(unit.item))) >= self._needs(first):
            self._follow((first,), unit, unit.second())
        if share:
            self.found = [f for f in self.found if f[0] >= self._needs(first)]
            self.best, self.floor = held
        return self.found

    def _follow(self, chosen: tuple[int, ...], unit: Followers, at: np.ndarray) -> None:
        items, counts = unit.by_item(at)
        for item, count in zip(items.tolist(), counts.tolist(), strict=True):
            if count < self._needs(chosen[0]):
                continue
            if len(chosen) == SIZE - 1:
                self._offer(count, (*chosen, item))
            else:
                self._follow((*chosen, item), unit, unit.next(at[unit.item[at] == item]))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Followers]]:
    """(first, ranges) and the unit of neighbouring rows (first, ranges, range, person_id, begin, end, items, starts, ends)."""
    key, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            now, part = tuple(keys[:, a].tolist()), batch.slice(a, b - a)
            if now != key and key is not None:
                yield key[:2], Followers.of([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            key = now
            plain = [part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5)]
            lists = [part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (6, 7, 8)]
            held.append([*plain, part.column(6).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), *lists])
    if key is not None:
        yield key[:2], Followers.of([np.concatenate(c) for c in zip(*held, strict=True)])


def top_chains(rows: DataFrame, days: int, k: int, floor: int = 1, most: int = RANGE) -> DataFrame:
    """Counts (i1 .. i4, n) of the chains in (person_id, item, first, last); holds the k most frequent, ties by ids."""
    units = keep(followers(rows, days), "followers")
    hot = keep(units.groupBy("first").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("first", F.ceil(F.col("n") / most).cast("int").alias("ranges")), "hot")
    units = units.join(hot, "first", "left").withColumn("ranges", F.coalesce("ranges", F.lit(1)))
    units = units.withColumn("range", F.pmod(F.xxhash64("person_id"), F.col("ranges")).cast("int"))
    units = units.select("first", "ranges", "range", "person_id", "begin", "end", "items", "starts", "ends")

    def table(found: list[tuple[int, tuple[int, ...]]], ranges: int) -> pa.RecordBatch:
        columns = [pa.array([ids[n] for _, ids in found], pa.int64()) for n in range(SIZE)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([ranges] * len(found), pa.int32()), pa.array([n for n, _ in found], pa.int64())], names=["i1", "i2", "i3", "i4", "ranges", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = ChainSearch(SIZE, k, floor)
        for (first, ranges), unit in _units(batches):
            found = task.unit(first, unit, share=ranges if ranges > 1 else 0)
            if ranges > 1 and found:
                yield table(found, ranges)
        yield table([(-n, ids) for n, ids in task.best], 1)

    sets = "i1 long, i2 long, i3 long, i4 long"
    found = keep(units.repartition("first", "range").sortWithinPartitions("first", "range").mapInArrow(search, f"{sets}, ranges int, n long"), "found")
    wanted = found.filter("ranges > 1").select("i1", "i2", "i3", "i4", "ranges").distinct()
    wanted = wanted.withColumn("range", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1))).withColumnRenamed("i1", "first")

    def recount(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        ids = list(zip(*(wanted.column(c).to_pylist() for c in ("first", "i2", "i3", "i4")), strict=True))
        counts = [0] * len(ids)
        if rows.num_rows and ids:
            (_, unit), *_ = _units(rows.combine_chunks().to_batches())
            for n, (_, *path) in enumerate(ids):
                at = unit.second()
                for step, item in enumerate(path):
                    at = at[unit.item[at] == item]
                    at = unit.next(at) if step < len(path) - 1 else at
                counts[n] = unit.patients(at)
        return pa.table([*(pa.array([i[n] for i in ids], pa.int64()) for n in range(SIZE)), pa.array(counts, pa.int64())], names=["i1", "i2", "i3", "i4", "n"])

    again = units.filter("ranges > 1").groupBy("first", "range").cogroup(wanted.groupBy("first", "range")).applyInArrow(recount, f"{sets}, n long")
    several = again.groupBy("i1", "i2", "i3", "i4").agg(F.sum("n").alias("n"))
    return keep(found.filter("ranges = 1").select("i1", "i2", "i3", "i4", "n").unionByName(several), "top-chains")
