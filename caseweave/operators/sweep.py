"""Events that overlap, by a sweep over sorted starts and ends.

Rows (person_id, item, first, last) in day numbers are dealt out by (patient, stretch of ``CELL_DAYS``
days), clipped to it, and sorted by start. A sweep goes along a stretch once and keeps what is under way:

* ``overlapping_pairs``: an event overlaps the later ones that start before it ends, which are one run of
  the sorted rows.
* ``cliques``: what is under way when an event ends and others have started since the last end, by
  bisection of the sorted days. Events that all overlap are together in one of these (the maximal cliques of the intervals), and each is met
  once.

A stretch bounds what a task holds of a patient with very many records. Sets that are met in two
stretches of a patient are the same set; whoever counts patients counts it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseweave.operators import packed
from caseweave.storage import dealt_out

CELL_DAYS = 1024
PAIRS_AT_ONCE = 1 << 20


def _dealt(rows: DataFrame, cell_days: int, amount: int, repeated: bool = False) -> DataFrame:
    """(person_id, cell, item, first, last) by stretch, in order of start; empty and undated intervals are gone."""
    rows = rows.filter("first <= last")
    cell = lambda c: F.floor(F.col(c) / cell_days).cast("int")
    spread = rows.select("person_id", "item", "first", "last", F.explode(F.sequence(cell("first"), cell("last"))).alias("cell"))
    low, high = F.col("cell") * cell_days, (F.col("cell") + 1) * cell_days - 1
    clipped = spread.select("person_id", "cell", "item", F.greatest("first", low).cast("int").alias("first"), F.least("last", high).cast("int").alias("last"))
    dealt = dealt_out(clipped, amount, "person_id", "cell")
    return (dealt.distinct() if repeated else dealt).sortWithinPartitions("person_id", "cell", "first")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole stretches, many at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = columns if held is None else [np.concatenate(c) for c in zip(held, columns, strict=True)]
        if not len(held[0]):
            continue
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        begin = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        if begin:
            yield [c[:begin] for c in held]
            held = [c[begin:] for c in held]
    if held is not None and len(held[0]):
        yield held


def overlapping_pairs(rows: DataFrame, cell_days: int = CELL_DAYS, amount: int = 0) -> DataFrame:
    """(person_id, i1, i2), i1 < i2: items of a patient with overlapping events; a pair may come once per stretch and part of it.

    ``amount`` is the number of rows, about; rows may be repeated."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for person, cell, item, first, last in _stretches(batches):
            stretch = np.cumsum(np.append(False, (person[1:] != person[:-1]) | (cell[1:] != cell[:-1])))
            wide = int(last.max()) - int(first.min()) + 2
            place = stretch * wide + (first - first.min())
            after = np.searchsorted(place, stretch * wide + (last - first.min()), side="right")
            many = after - np.arange(len(item)) - 1
            ends = np.cumsum(many)
            ids, code = np.unique(item, return_inverse=True)
            low = 0
            while low < len(item):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")))
                own = many[low:high]
                left = np.repeat(np.arange(low, high), own)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
                a, b = np.minimum(code[left], code[right]), np.maximum(code[left], code[right])
                key = np.unique(((stretch[left] * len(ids) + a) * len(ids) + b)[a != b])
                where, a, b = key // (len(ids) ** 2), key // len(ids) % len(ids), key % len(ids)
                whose = person[np.searchsorted(stretch, where)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (whose, ids[a], ids[b])], names=["person_id", "i1", "i2"])
                low = high

    return _dealt(rows, cell_days, amount, repeated=True).mapInArrow(pairs, "person_id long, i1 long, i2 long")


def _spans(stretch: np.ndarray, code: np.ndarray, first: np.ndarray, last: np.ndarray, codes: int) -> tuple[np.ndarray, ...]:
    """(stretch, code, first, last): when each item is under way in a stretch, its overlapping events put together."""
    order = np.lexsort((first, code, stretch))
    stretch, code, first, last = (c[order] for c in (stretch, code, first, last))
    low = int(first.min())
    wide = int(last.max()) - low + 2
    group = (stretch * codes + code) * wide
    until = np.maximum.accumulate(group + (last - low))
    begin = np.flatnonzero(np.append(True, group[1:] + (first[1:] - low) > until[:-1]))
    end = np.append(begin[1:], len(code)) - 1
    return stretch[begin], code[begin], first[begin], until[end] - group[end] + low


def _cliques_of(stretch: np.ndarray, code: np.ndarray, first: np.ndarray, last: np.ndarray, codes: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(stretch and size of each, their items in a row): the maximal sets of different items under way at once, of at least
    ``size`` items, many at a time."""
    stretch, code, first, last = _spans(stretch, code, first, last, codes)
    low = int(first.min())
    wide = int(last.max()) - low + 2
    starts, ends = stretch * wide + (first - low), stretch * wide + (last - low)
    days = np.unique(ends)
    started = np.searchsorted(np.sort(starts), days, side="right")  # what starts on the day that another ends meets it
    days = days[np.diff(started, prepend=0) > 0]
    since, until = np.searchsorted(days, starts), np.searchsorted(days, ends, side="right")
    many = np.cumsum(np.bincount(since, minlength=len(days) + 1) - np.bincount(until, minlength=len(days) + 1))[:-1]
    sums = np.cumsum(many)
    at = 0
    while at < len(days):
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        own = np.flatnonzero((since < stop) & (until > at))
        a, n = np.maximum(since[own], at) - at, np.minimum(until[own], stop) - np.maximum(since[own], at)
        member = np.sort((np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())) * codes + np.repeat(code[own], n))
        where = member // codes
        large = many[at:stop] >= size
        yield days[at:stop][large] // wide, many[at:stop][large], member[large[where]] % codes
        at = stop


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Patients of cliques, their sizes, and their items in a row."""
    for person, cell, item, first, last in _stretches(batches):
        stretch = np.cumsum(np.append(False, (person[1:] != person[:-1]) | (cell[1:] != cell[:-1])))
        ids, code = np.unique(item, return_inverse=True)
        for where, many, members in _cliques_of(stretch, code, first, last, len(ids), size):
            yield person[np.searchsorted(stretch, where)].astype(np.int64), many, ids[members]


def cliques(rows: DataFrame, size: int, cell_days: int = CELL_DAYS, amount: int = 0) -> DataFrame:
    """(person_id, clique, items): sorted sets of at least ``size`` different items under way at once; every overlapping
    set of that size lies in one of its patient's."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whose, many, items in _sets(batches, size):
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(items))
            yield pa.RecordBatch.from_arrays([pa.array(whose), pa.array(np.ones(len(whose), bool)), sets], names=["person_id", "clique", "items"])

    return _dealt(rows, cell_days, amount).mapInArrow(found, "person_id long, clique boolean, items array<long>")


def packed_cliques(rows: DataFrame, size: int, amount: int = 0, lasting: int = 0) -> DataFrame:
    """The same, packed. ``lasting`` is how long events are, if they are all long: most then lie in one stretch."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whose, many, items in _sets(batches, size):
            yield packed.pack(True, whose, many, items, size)

    return _dealt(rows, max(CELL_DAYS, 4 * lasting), amount).mapInArrow(found, packed.LISTS)
