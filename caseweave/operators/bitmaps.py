"""The k most frequent item sets by vertical bitmaps.

What is counted is patients: those who have all items of a set (*together*, from baskets), those in whom
all of them are under way at once (*overlapping*, from the cliques of ``sweep.py``), or those who have
them all but never at once (*separate*, from both).

The search is divided by the lowest item of a set. Its *unit* has a row for each basket or clique with
that item: the other, higher items. A task turns a unit into bitmaps, one per item: a bit per basket, and
for the cliques a few whole bytes per patient. First all pairs of a unit's items are counted at once, from
its rows; a clique gives only pairs that the one before it, of the same patient, has not. Sets whose
pairs all reach the floor are counted by their bitmaps. Where those would be too many, the search goes
down depth first: the bitmaps of all later items are intersected with that of the chosen one, in one
step, and patients counted. What falls below the floor is not followed. The floor is the k-th best count
so far; it rises while the task goes from unit to unit, lowest items first, and once k sets stand at the
floor a later unit must exceed it, as ties go to the lower ids. Only a task's k best sets leave it.

An item with very many rows has several units, each with a range of its patients. A set among the k best
has at least the r-th part of the floor in one of the r ranges; the sets that reach that anywhere are
candidates, and are then counted in all ranges and added up. So no unit is larger than ``RANGE`` rows on
average, and nothing is left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseweave.operators import packed
from caseweave.operators.groups import kth_best
from caseweave.storage import dealt_if_many, dealt_out, keep

RANGE = 1 << 16  # rows of a unit
NUMBERS_PER_TASK = 1 << 23  # other items that a task sorts
ITEMS_AT_ONCE = 256  # whose bits are laid out together
SETS_AT_ONCE = 4096
CELLS = 1 << 22  # of a table in a task
EARLY, LATE = 64, 4  # lowest items that are searched first, if there are so many times as many items
JOINED = 1 << 23  # neighbours of neighbours in a unit; with more the search goes depth first


class Bits(NamedTuple):
    """Bitmaps of some items: baskets in the first ``split`` bytes, then cliques, each byte of one patient."""

    rows: np.ndarray
    owner: np.ndarray
    split: int

    def chosen(self, which: np.ndarray) -> Bits:
        return self._replace(rows=self.rows[which])

    def behind(self, n: int) -> Bits:
        """The later items where item ``n`` is, without the bytes in which it is not."""
        at = np.flatnonzero(self.rows[n])
        return Bits(self.rows[n + 1 :, at] & self.rows[n, at], self.owner[at], int(np.searchsorted(at, self.split)))

    def having(self) -> np.ndarray:
        """Patients by baskets, for each item."""
        return np.bitwise_count(self.rows[:, : self.split]).sum(axis=1, dtype=np.int64)

    def meeting(self) -> np.ndarray:
        """Patients by cliques."""
        rows, owner = self.rows[:, self.split :], self.owner[self.split :]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
        if len(starts) < len(owner):
            rows = np.bitwise_or.reduceat(rows, starts, axis=1)
        return np.count_nonzero(rows, axis=1)


def _laid_out(where: np.ndarray, which: np.ndarray, items: int, size: int) -> np.ndarray:
    """A row of packed bits per item from (bit, item) pairs."""
    out = np.zeros((items, size), np.uint8)
    order = np.argsort(which, kind="stable")
    where, which = where[order], which[order]
    for low in range(0, items, ITEMS_AT_ONCE):
        a, b = np.searchsorted(which, [low, low + ITEMS_AT_ONCE])
        bits = np.zeros((min(ITEMS_AT_ONCE, items - low), 8 * size), bool)
        bits[which[a:b] - low, where[a:b]] = True
        out[low : low + len(bits)] = np.packbits(bits, axis=1)
    return out


class Unit(NamedTuple):
    """Rows of one lowest item: cliques (or else baskets), their patients, how many others each has, and these in a row."""

    cliques: np.ndarray
    person: np.ndarray
    lengths: np.ndarray
    others: np.ndarray

    def bits(self, which: np.ndarray, stay: np.ndarray, items: int) -> Bits:
        """Bitmaps of ``items`` items, of those ``others`` that ``stay``, numbered by ``which``."""
        baskets = int((~self.cliques).sum())  # they come first
        split = -(-baskets // 8)
        person = self.person[baskets:]
        first = np.flatnonzero(np.append(True, person[1:] != person[:-1])) if len(person) else np.zeros(0, np.int64)
        own = np.diff(first, append=len(person))
        bytes_of = -(-own // 8)
        begin = split + np.cumsum(bytes_of) - bytes_of
        bit = np.concatenate([np.arange(baskets), np.repeat(8 * begin - first, own) + np.arange(len(person))])
        owner = np.concatenate([np.full(split, -1), np.repeat(np.arange(len(own)), bytes_of)])
        rows = _laid_out(np.repeat(bit, self.lengths)[stay], which[stay], items, len(owner))
        return Bits(rows, owner, split)

    def often(self, which: np.ndarray, stay: np.ndarray, items: int, cliques: bool, needs: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of items (numbers first * ``items`` + second, first < second, in order) and the most patients who can have
        both, from ``needs`` on; by cliques or else by baskets. Items as for ``bits``."""
        some = stay & np.repeat(self.cliques == cliques, self.lengths)
        row, item = np.repeat(np.arange(len(self.lengths)), self.lengths)[some], which[some]
        n, new = len(item), np.ones(len(item), bool)
        if cliques:
            follows = np.append(False, self.person[1:] == self.person[:-1])
            tall = max(1, CELLS // items)
            for low in range(0, len(self.lengths), tall):
                a, b = np.searchsorted(row, [low, low + tall])
                has = np.zeros((tall + 1, items), bool)  # the row before the first has none
                has[row[a:b] - low + 1, item[a:b]] = True
                new[a:b] = ~(has[row[a:b] - low, item[a:b]] & follows[row[a:b]])
        length = np.bincount(row, minlength=len(self.lengths))
        left = np.repeat(np.cumsum(length), length) - np.arange(1, n + 1)  # behind an item in its row
        if int(left.sum()) <= CELLS:
            return self._often_of_few(item, new, left, items, needs)
        # a new item goes with all behind it in its row, an old one with the new ones
        ahead = np.concatenate([[0], np.cumsum(new)])
        end = np.arange(1, n + 1) + left
        begin = np.where(new, np.arange(1, n + 1), n + ahead[1:])
        many = np.where(new, left, ahead[end] - ahead[1:])
        behind = np.concatenate([item, item[new]])
        wide = max(1, CELLS // items)
        codes, bounds = [], []
        order = np.argsort(item, kind="stable") if wide < items else np.arange(n)
        for low in range(0, items, wide):
            a, b = np.searchsorted(item[order], [low, low + wide]) if wide < items else (0, n)
            own = order[a:b]
            cells = np.zeros(min(wide, items - low) * items, np.int64)
            sums = np.cumsum(many[own])
            at = 0
            while at < len(own):
                stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CELLS, side="right")))
                part, size = own[at:stop], many[own[at:stop]]
                ends = np.cumsum(size)
                right = behind[np.repeat(begin[part] - ends + size, size) + np.arange(ends[-1])]
                cells += np.bincount(np.repeat((item[part] - low) * items, size) + right, minlength=len(cells))
                at = stop
            found = np.flatnonzero(cells >= needs)
            codes.append(found + low * items)
            bounds.append(cells[found])
        return np.concatenate(codes), np.concatenate(bounds)

    @staticmethod
    def _often_of_few(item: np.ndarray, new: np.ndarray, left: np.ndarray, items: int, needs: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from at most ``CELLS`` pairs: those of items so many places apart, again and again, and then sorted."""
        kind = np.int32 if items * items < 1 << 31 else np.int64
        right = item.astype(kind)
        base, some_old = right * kind(items), not new.all()
        codes, apart, many = [], 1, len(item)
        while many * 4 > len(item):  # most items have one so far behind them: whole rows are shifted
            there = left[:-apart] >= apart
            if some_old:
                there &= new[:-apart] | new[apart:]
            codes.append((base[:-apart] + right[apart:])[there])
            apart, many = apart + 1, len(codes[-1])
        at = np.flatnonzero(left >= apart)
        while len(at):
            own = at[new[at] | new[at + apart]] if some_old else at
            codes.append(base[own] + right[own + apart])
            apart += 1
            at = at[left[at] >= apart]
        every = np.concatenate(codes) if codes else np.zeros(0, kind)
        if len(every) > items * items:
            cells = np.bincount(every)
            found = np.flatnonzero(cells >= needs)
            return found, cells[found]
        every.sort()
        first = np.flatnonzero(every[needs - 1 :] == every[: len(every) - needs + 1]) if len(every) >= needs else np.zeros(0, np.int64)
        found = every[first]
        begin = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else first
        return found[begin].astype(np.int64), np.diff(begin, append=len(found)) + needs - 1


def _joined(codes: np.ndarray, items: int, size: int) -> np.ndarray | None:
    """Rows of ``size`` items, in order, of which every two are one of the pairs; None if too many had to be looked at."""
    first, second = codes // items, codes % items
    begin = np.searchsorted(first, np.arange(items + 1))
    sets = np.stack([first, second], axis=1)
    if size > 2 and items * items <= CELLS:
        paired = np.zeros(items * items, bool)
        paired[codes] = True
    for _ in range(size - 2):
        last = sets[:, -1]
        many = begin[last + 1] - begin[last]
        ends = np.cumsum(many)
        if len(ends) and ends[-1] > JOINED:
            return None
        out = []
        at = 0
        while at < len(sets):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SETS_AT_ONCE * ITEMS_AT_ONCE, side="right")))
            own = np.repeat(np.arange(at, stop), many[at:stop])
            more = second[np.repeat(begin[last[at:stop]] - ends[at:stop] + many[at:stop], many[at:stop]) + np.arange(ends[stop - 1] - len(own), ends[stop - 1])]
            for n in range(sets.shape[1] - 1):
                wanted = sets[own, n] * items + more
                there = paired[wanted] if items * items <= CELLS else codes[np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)] == wanted
                own, more = own[there], more[there]
            out.append(np.column_stack([sets[own], more]))
            at = stop
        sets = np.concatenate(out) if out else np.zeros((0, sets.shape[1] + 1), np.int64)
    return sets


TOGETHER, OVERLAPPING, SEPARATE = "together", "overlapping", "separate"


class Search:
    """Depth first over bitmaps; the ``k`` best sets by count, then by ids."""

    def __init__(self, size: int, k: int, floor: int, what: str = TOGETHER):
        self.size, self.k, self.floor, self.what = size, k, max(floor, 1), what
        self.best: list[tuple[int, tuple[int, ...]]] = []  # (-count, ids), in order
        self.share = 0  # over 0: keep every set that reaches this part of the floor
        self.found: list[tuple[int, tuple[int, ...]]] = []

    def _at_most(self, bits: Bits) -> np.ndarray:
        """What no set with these items can exceed."""
        return bits.meeting() if self.what == OVERLAPPING else bits.having()

    def counts(self, bits: Bits) -> np.ndarray:
        return bits.having() - bits.meeting() if self.what == SEPARATE else self._at_most(bits)

    def _needs(self, first: int) -> int:
        if self.share:
            return -(-self.floor // self.share)
        beaten = len(self.best) == self.k and self.best[-1][1][0] < first
        return self.floor + 1 if beaten else self.floor

    def _offer(self, count: int, ids: tuple[int, ...]) -> None:
        if self.share:
            self.found.append((count, ids))
        if count >= self.floor:
            bisect.insort(self.best, (-count, ids))
            if len(self.best) >= self.k:
                del self.best[self.k :]
                self.floor = max(self.floor, -self.best[-1][0])

    def unit(self, first: int, unit: Unit, share: int = 0) -> list[tuple[int, tuple[int, ...]]]:
        """All sets of one unit. With ``share`` it is one of so many ranges: the sets that may be among the
        best come back with their counts here."""
        self.share, self.found = share, []
        if share:  # counts of a range bound those of the whole from below: they may raise the floor, here only
            held = self.best, self.floor
            self.best = []
        which, ids = pd.factorize(unit.others)
        rows = np.bincount(which, minlength=len(ids))  # at least as many as patients
        high = np.flatnonzero(rows >= self._needs(first))
        if len(high) >= self.size - 1:
            high = high[np.argsort(ids[high])]
            place = np.full(len(ids), -1)
            place[high] = np.arange(len(high))
            which, ids = place[which], ids[high]
            if not self._join(first, unit, which, ids):
                self._grow((first,), unit.bits(which, which >= 0, len(ids)), ids)
        if share:
            needs = self._needs(first)
            self.found = [f for f in self.found if f[0] >= needs]
            self.best, self.floor = held
        return self.found

    def _join(self, first: int, unit: Unit, which: np.ndarray, ids: np.ndarray) -> bool:
        """Count the sets whose pairs are all frequent enough; ``which`` is the place of each other item in ``ids`` or -1.
        False, and nothing done, if there may be too many."""
        codes, bounds = unit.often(which, which >= 0, len(ids), self.what == OVERLAPPING, self._needs(first))
        sets = _joined(codes, len(ids), self.size - 1)
        if sets is None:
            return False
        if not len(sets):
            return True
        pairs = [(a, b) for b in range(self.size - 1) for a in range(b)]
        bound = np.min([bounds[np.searchsorted(codes, sets[:, a] * len(ids) + sets[:, b])] for a, b in pairs], axis=0)
        order = np.argsort(-bound, kind="stable")
        sets, bound = sets[order], bound[order]
        used, at = np.unique(sets, return_inverse=True)
        at = at.reshape(sets.shape)
        place = np.full(len(ids) + 1, -1)  # the last is for those that are out
        place[used] = np.arange(len(used))
        bits = unit.bits(place[which], place[which] >= 0, len(used))
        step = max(1, min(SETS_AT_ONCE, CELLS // max(1, len(bits.owner))))
        for low in range(0, len(sets), step):
            if bound[low] < self._needs(first):
                break  # the floor has risen
            some = at[low : low + step]
            counts = self.counts(bits._replace(rows=np.bitwise_and.reduce([bits.rows[some[:, n]] for n in range(self.size - 1)])))
            for n in np.argsort(-counts, kind="stable").tolist():
                if counts[n] < self._needs(first):
                    break
                self._offer(int(counts[n]), (first, *ids[sets[low + n]].tolist()))
        return True

    def _grow(self, chosen: tuple[int, ...], bits: Bits, ids: np.ndarray) -> None:
        left = self.size - len(chosen)
        counts = self.counts(bits) if left == 1 else self._at_most(bits)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] >= self._needs(chosen[0])]
        if len(order) < left:
            return
        counts, ids = counts[order], ids[order]
        if left == 1:
            for n, count in enumerate(counts.tolist()):
                if count < self._needs(chosen[0]):
                    return  # the floor has risen
                self._offer(count, (chosen[0], *sorted((*chosen[1:], int(ids[n])))))
            return
        bits = bits.chosen(order)
        for n in range(len(ids) - left + 1):
            if counts[n] < self._needs(chosen[0]):
                return
            self._grow((*chosen, int(ids[n])), bits.behind(n), ids[n + 1 :])


def _found(found: list[tuple[tuple[int, ...], int, int]]) -> pa.RecordBatch:
    """Rows (first, ids, ranges, n)."""
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0][0] for f in found], pa.int64()), pa.array([list(f[0]) for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64())],
        names=["first", "ids", "ranges", "n"],
    )


def baskets_of(rows: DataFrame, amount: int = 0) -> DataFrame:
    """(person_id, clique, items): every patient's items in order; ``amount`` is the number of rows."""
    return dealt_if_many(rows, amount, "person_id").groupBy("person_id").agg(F.array_sort(F.collect_set("item")).alias("items")).select("person_id", F.lit(False).alias("clique"), "items")


def top_sets(lists: DataFrame, size: int, k: int, floor: int = 1, what: str = TOGETHER, most: int = RANGE) -> DataFrame:
    """Counts (i1 .. i<size>, n) of the sets in (person_id, clique, items), packed or not; holds the k most frequent, ties by ids.

    ``items`` are distinct and in order. ``floor`` is a count that all of the k are known to reach.
    ``lists`` is read several times and should be a kept table. Sets that begin with one of the few lowest items
    are counted first: as ties go to the lower ids, all others must have more patients than the k-th best of these.
    """
    lists = keep(packed.packed(lists, size), "packed") if "items" in lists.columns else lists
    support = keep(packed.support(lists), "support")
    early = support.orderBy("first").limit(EARLY).agg(F.max("first"), F.count("*")).first()
    late = support.filter(F.col("first") > early[0]).limit(EARLY * (LATE - 1))
    if early[1] < EARLY or late.count() < EARLY * (LATE - 1):
        return _top_sets(lists, support, size, k, floor, what, most)
    first = _top_sets(lists, support, size, k, floor, what, most, high=early[0])
    floor = max(floor, kth_best(first, k) + 1)
    return first.unionByName(_top_sets(lists, support, size, k, floor, what, most, low=early[0]))


def _top_sets(lists: DataFrame, support: DataFrame, size: int, k: int, floor: int, what: str, most: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """Those of the sets that begin with an item over ``low``, up to ``high``; ``support`` has the lists of each item."""
    ranges = support.filter(F.col("n") > most).select("first", F.ceil(F.col("n") / most).cast("int"))
    hot = {first: n for first, n in ranges.collect()}  # an item of ``most`` lists each

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Search(size, k, floor, what)
        for (first, ranges, _), unit in packed.read_rests(batches):
            found = task.unit(first, Unit(*unit), share=ranges if ranges > 1 else 0)
            if ranges > 1 and found:
                yield _found([(ids, ranges, count) for count, ids in found])
        yield _found([(ids, 1, -count) for count, ids in task.best])

    numbers = lists.agg(F.sum("numbers")).first()[0]
    rows = packed.rests(lists, size, hot, low, high)
    dealt = dealt_out(rows, numbers, "first", "range", per_task=NUMBERS_PER_TASK).sortWithinPartitions("first", "range")
    found = keep(dealt.mapInArrow(search, "first long, ids array<long>, ranges int, n long"), "found")
    every = found.filter("ranges = 1").select("ids", "n")
    if hot:
        every = every.unionByName(_recounted(found, packed.rests(lists, size, hot, low, high, only_hot=True), size, k, what))
    return keep(every.select(*[F.col("ids")[n].alias(f"i{n + 1}") for n in range(size)], "n"), "top-sets")


def _recounted(found: DataFrame, rows: DataFrame, size: int, k: int, what: str) -> DataFrame:
    """Candidates of items with several ranges, counted in all of them: (ids, n)."""
    wanted = found.filter("ranges > 1").select("first", "ids", "ranges").distinct()
    sets = wanted.groupBy("first", "ranges").agg(F.flatten(F.collect_list("ids")).alias("sets"))
    sets = sets.withColumn("range", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))

    def recount(rows: pa.Table, sets: pa.Table) -> pa.Table:
        wanted = np.concatenate([c.values.to_numpy() for c in sets.column("sets")]).reshape(-1, size) if sets.num_rows else np.zeros((0, size), np.int64)
        ids, place = np.unique(wanted[:, 1:], return_inverse=True)
        place = place.reshape(-1, size - 1)
        counts = np.zeros(len(wanted), np.int64)
        if rows.num_rows and len(wanted):
            (_, unit), *_ = packed.read_rests(rows.combine_chunks().to_batches())
            unit = Unit(*unit)
            at = np.minimum(np.searchsorted(ids, unit.others), len(ids) - 1)
            bits = unit.bits(at, ids[at] == unit.others, len(ids))
            for low in range(0, len(wanted), SETS_AT_ONCE):
                some = place[low : low + SETS_AT_ONCE]
                counts[low : low + SETS_AT_ONCE] = Search(size, k, 1, what).counts(bits._replace(rows=np.bitwise_and.reduce([bits.rows[some[:, n]] for n in range(size - 1)])))
        return pa.table({"ids": pa.array(wanted.tolist(), pa.list_(pa.int64())), "n": counts})

    again = rows.groupBy("first", "range").cogroup(sets.groupBy("first", "range")).applyInArrow(recount, "ids array<long>, n long")
    return again.groupBy("ids").agg(F.sum("n").alias("n"))
