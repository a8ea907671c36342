"""Many sorted lists of a table in one row.

A list is a patient's items in order, or those of a clique. Lists by the million are slow to move as arrays,
so they are packed: a row has their patients, first items, numbers of further items and, in as few bytes as
they need, the steps from item to item. What begins inside a list is packed the same way, so that the rest of
a list behind one of its items is a stretch of its steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseweave.storage import dealt_out

LISTS = "clique boolean, width int, numbers double, persons binary, begins binary, mores binary, steps binary"
RESTS = "first long, ranges int, range int, clique boolean, width int, persons binary, mores binary, steps binary"
AT_ONCE = 1 << 20  # places in lists that are sorted at once
NUMBERS = 1 << 22  # steps that are laid out at once
STEPS = {2: np.uint16, 4: np.uint32, 8: np.int64}


class Lists(NamedTuple):
    """Patients, first items, how many more items each list has, and the steps to these in a row."""

    person: np.ndarray
    begin: np.ndarray
    more: np.ndarray
    steps: np.ndarray

    def others(self) -> np.ndarray:
        """The items behind the first ones, in a row."""
        sums = np.cumsum(self.steps, dtype=np.int64)
        ends = np.cumsum(self.more)
        before = np.where(ends > self.more, np.append(sums, 0)[ends - self.more - 1], 0)
        return sums + np.repeat(self.begin - before, self.more)


def stretches(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of many stretches, one after another."""
    return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())


def _narrow(steps: np.ndarray) -> np.ndarray:
    most = int(steps.max(initial=0))
    return steps.astype(STEPS[2 if most < 1 << 16 else 4 if most < 1 << 32 else 8])


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end after so many elements."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a binary column, and where each value begins and the last ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def pack(clique: bool, person: np.ndarray, lengths: np.ndarray, items: np.ndarray, size: int) -> pa.RecordBatch:
    """One row of lists, those of at least ``size`` items, of (list, item) in order."""
    if (lengths < size).any():
        stay = lengths >= size
        items, person, lengths = items[np.repeat(stay, lengths)], person[stay], lengths[stay]
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(items), bool)
    inside[starts] = False
    steps = _narrow(np.diff(items, prepend=0)[inside])
    columns = [person.astype(np.int64), items[starts], (lengths - 1).astype(np.int32), steps]
    many = float((lengths.astype(np.float64) * (lengths - 1) / 2).sum())
    one = [pa.array([clique]), pa.array([steps.itemsize], pa.int32()), pa.array([many]), *[_binary(c, np.array([len(c)])) for c in columns]]
    return pa.RecordBatch.from_arrays(one, names=[c.split()[0] for c in LISTS.split(", ")])


def packed(lists: DataFrame, size: int) -> DataFrame:
    """(person_id, clique, items) packed."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            person, clique, items = (batch.column(n) for n in range(3))
            person, clique = person.fill_null(0).to_numpy(), clique.to_numpy(zero_copy_only=False)
            for kind in (False, True):
                own = items.filter(pa.array(clique == kind))
                lengths = own.value_lengths().to_numpy().astype(np.int64)
                yield pack(kind, person[clique == kind], lengths, own.flatten().to_numpy(), size)

    return lists.select("person_id", "clique", "items").mapInArrow(found, LISTS)


def baskets(rows: DataFrame, size: int, amount: int = 0) -> DataFrame:
    """Every patient's items, packed, of (person_id, item); ``amount`` is the number of rows. Those of no patient are one basket."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in chain(batches, [None]):
            if batch is not None:
                person, item = batch.column(0), batch.column(1)
                new = [person.is_null().to_numpy(zero_copy_only=False), person.fill_null(0).to_numpy(), item.to_numpy()]
                held = [np.concatenate(c) for c in zip(held, new, strict=True)]
            nobody, person, item = held
            if not len(item):
                continue
            other = np.append(True, (person[1:] != person[:-1]) | (nobody[1:] != nobody[:-1]))
            begins = np.flatnonzero(other)
            end = len(item) if batch is None else int(begins[-1])  # the last patient may have more
            held = [c[end:] for c in held]
            begins = begins[begins < end]
            if len(begins):
                fresh = (other | np.append(True, item[1:] != item[:-1]))[:end]
                lengths = np.add.reduceat(fresh.astype(np.int64), begins)
                yield pack(False, person[begins], lengths, item[:end][fresh], size)

    dealt = dealt_out(rows.filter("item IS NOT NULL").select("person_id", "item"), amount, "person_id")
    return dealt.sortWithinPartitions("person_id", "item").mapInArrow(found, LISTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, Lists]]:
    """Whether they are cliques, and lists."""
    for batch in batches:
        clique, width = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for n in range(batch.num_rows):
            kinds = (np.int64, np.int64, np.int32, STEPS[width[n]])
            yield clique[n], Lists(*[_bytes(batch.column(3 + c).slice(n, 1), kind)[0] for c, kind in enumerate(kinds)])


def support(lists: DataFrame) -> DataFrame:
    """(first, n): packed lists that have an item."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in _read(batches):
            item, n = np.unique(np.concatenate([some.begin, some.others()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(n)], names=["first", "n"])

    return lists.mapInArrow(found, "first long, n long").groupBy("first").agg(F.sum("n").alias("n"))


def _mixed(person: np.ndarray) -> np.ndarray:
    """A hash of ids."""
    x = person.astype(np.uint64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(31))


def rests(lists: DataFrame, size: int, hot: dict[int, int], low: int | None = None, high: int | None = None, only_hot: bool = False) -> DataFrame:
    """What follows each item that a set of ``size`` may begin with, packed by that item and the range of the patient.

    ``hot`` has the number of ranges of items that have several. Only items over ``low``, up to ``high``.
    """
    hot_ids = np.array(sorted(hot), np.int64)
    hot_ranges = np.array([hot[i] for i in sorted(hot)], np.int64)

    def laid_out(held: list[tuple[bool, Lists]]) -> Iterator[pa.RecordBatch]:
        clique = np.repeat([c for c, _ in held], [len(x.more) for _, x in held])
        some = Lists(*[np.concatenate(c) for c in zip(*[x for _, x in held], strict=True)])
        places = np.maximum(some.more + 2 - size, 0)
        which = np.repeat(np.arange(len(places)), places)
        begin = (np.cumsum(some.more, dtype=np.int64) - some.more)[which]
        at = stretches(np.zeros(len(places), np.int64), places)
        first = np.where(at == 0, some.begin[which], np.append(some.others(), 0)[begin + at - 1])
        stay = np.ones(len(first), bool)
        if low is not None:
            stay &= first > low
        if high is not None:
            stay &= first <= high
        ranges = np.ones(len(first), np.int64)
        if len(hot_ids):
            place = np.minimum(np.searchsorted(hot_ids, first), len(hot_ids) - 1)
            ranges = np.where(hot_ids[place] == first, hot_ranges[place], 1)
        if only_hot:
            stay &= ranges > 1
        which, begin, at, first, ranges = (c[stay] for c in (which, begin, at, first, ranges))
        part = np.where(ranges > 1, _mixed(some.person[which]) % ranges.astype(np.uint64), 0).astype(np.int64)
        keys = (clique[which], part, first)
        order = np.lexsort(keys) if len(hot_ids) or clique.any() != clique.all() else np.argsort(first, kind="stable")
        which, begin, at, ranges = (c[order] for c in (which, begin, at, ranges))
        kind, part, first = (c[order] for c in keys)
        more = some.more[which].astype(np.int64) - at
        sums, a = np.cumsum(more), 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + NUMBERS, side="right")))
            steps = _narrow(some.steps[stretches(begin[a:b] + at[a:b], more[a:b])])
            other = (kind[a + 1 : b] != kind[a : b - 1]) | (part[a + 1 : b] != part[a : b - 1]) | (first[a + 1 : b] != first[a : b - 1])
            ends = np.append(np.flatnonzero(other) + 1, b - a)
            own = a + ends - 1
            columns = [pa.array(first[own]), pa.array(ranges[own].astype(np.int32)), pa.array(part[own].astype(np.int32)), pa.array(kind[own]), pa.array(np.full(len(own), steps.itemsize, np.int32))]
            columns += [_binary(some.person[which[a:b]], ends), _binary(more[a:b].astype(np.int32), ends), _binary(steps, np.cumsum(more[a:b])[ends - 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESTS.split(", ")])
            a = b

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for clique, some in _read(batches):
            if high is not None:  # lists that begin behind it have nothing to give
                stay = some.begin <= high
                some = Lists(some.person[stay], some.begin[stay], some.more[stay], some.steps[np.repeat(stay, some.more)])
            held.append((clique, some))
            many += len(some.steps)
            if many >= AT_ONCE:
                yield from laid_out(held)
                held, many = [], 0
        if many:
            yield from laid_out(held)

    return lists.mapInArrow(found, RESTS)


def read_rests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(first, ranges, range), and of neighbouring rows of one of these: whether it is a clique, patients, numbers of items
    and these in a row; baskets first, then by patient."""

    def whole(key: tuple[int, int, int], held: list[tuple]) -> tuple:
        clique, person, more, steps = (np.concatenate(c) for c in zip(*held, strict=True))
        items = Lists(person, np.full(len(person), key[0]), more, steps).others()
        order = np.lexsort((person, clique))
        begin = np.cumsum(more) - more
        return key, (clique[order], person[order], more[order], items[stretches(begin[order], more[order])])

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        first, ranges, part, clique, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        persons, ends = _bytes(batch.column(5), np.int64)
        mores = _bytes(batch.column(6), np.int32)[0].astype(np.int64)
        raw, at = _bytes(batch.column(7), np.uint8)
        other = (first[1:] != first[:-1]) | (part[1:] != part[:-1]) | (width[1:] != width[:-1])
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), len(first)]
        for a, b in zip(edges, edges[1:], strict=False):
            now = int(first[a]), int(ranges[a]), int(part[a])
            if now != key and key is not None:
                yield whole(key, held)
                held = []
            key = now
            some = slice(ends[a], ends[b])
            held.append((np.repeat(clique[a:b], np.diff(ends[a : b + 1])), persons[some], mores[some], np.frombuffer(raw[at[a] : at[b]].tobytes(), STEPS[int(width[a])])))
    if key is not None:
        yield whole(key, held)
