"""The k most frequent pairs, by their first item.

A patient has a row for each first item with all the items it is paired with, so a pair costs one number
in the shuffle and is never a row. A task counts the pairs of one first item after another and lets only
its k best leave; what it holds is the numbers of one batch and the counts of one first item.

An item with very many rows has several ranges of its patients; their counts are added up.
A patient with very many pairs is cut into parts, each with some of the first items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from caseweave.operators import groups
from caseweave.storage import dealt_if_many, dealt_out, keep

RANGE = 1 << 16  # rows of an item that are counted together
NUMBERS_PER_TASK = 1 << 23  # other items that a task sorts
PAIRS_AT_ONCE = 1 << 20  # of ends that are compared together


def _dealt(lists: DataFrame, pairs: Column) -> DataFrame:
    """Lists of patients, in as many parts as their pairs ask for: columns part and parts."""
    parts = F.greatest(F.ceil(pairs / groups.SETS_PER_TASK), F.lit(1)).cast("int")
    dealt = lists.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.repartition("person_id", "part")


def _own(items: str) -> Column:
    """Places and values of the items of this part."""
    return F.filter(F.transform(items, lambda x, at: F.struct(at.alias("at"), x.alias("x"))), lambda s: F.pmod(s["at"], F.col("parts")) == F.col("part"))


def lists_of(rows: DataFrame, amount: int = 0) -> DataFrame:
    """(person_id, items): the distinct items of each patient, in order; from about ``amount`` rows (person_id, item)."""
    rows = dealt_if_many(rows.filter("person_id IS NOT NULL"), amount, "person_id")
    return rows.groupBy("person_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def numbers_within(lists: DataFrame) -> int:
    """How many others ``within_lists`` gives in all."""
    size = F.size("items").cast("double")
    return int(lists.agg(F.sum(size * (size - 1) / 2)).first()[0] or 0)


def within(baskets: DataFrame) -> DataFrame:
    """(first, person_id, others) from (person_id, item): the higher items of the patient behind each item."""
    return within_lists(lists_of(baskets))


def within_lists(lists: DataFrame) -> DataFrame:
    """The same from lists of items."""
    size = F.size("items").cast("double")
    dealt = _dealt(lists.filter(F.size("items") > 1), size * (size - 1) / 2)
    each = dealt.select("person_id", "items", F.explode(_own("items")).alias("own"))
    return each.select(F.col("own.x").alias("first"), "person_id", F.slice("items", F.col("own.at") + 2, F.size("items")).alias("others")).filter(F.size("others") > 0)


def across(rows: DataFrame, gap: int, strict: bool) -> DataFrame:
    """(first, person_id, others): the other items of the patient that come more than (or at least) ``gap`` days after each item.

    ``rows`` has person_id, item, first and last day, once for each patient and item, and tells with the columns earlier
    and later which of both an item can be.
    """
    return across_lists(ends_of(rows), gap, strict)


def ends_of(rows: DataFrame, amount: int = 0) -> DataFrame:
    """(person_id, lefts, rights): the items of each patient that may come earlier, and later, with their days."""
    rows = dealt_if_many(rows.filter("person_id IS NOT NULL"), amount, "person_id")
    return rows.groupBy("person_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("earlier"), F.struct("item", "first")))).alias("lefts"),
        F.array_sort(F.collect_list(F.when(F.col("later"), F.struct("item", "last")))).alias("rights"),
    )


def numbers_across(lists: DataFrame) -> int:
    """How many others ``across_lists`` gives at most."""
    return int(lists.agg(F.sum(F.size("lefts").cast("double") * F.size("rights"))).first()[0] or 0)


def across_lists(lists: DataFrame, gap: int, strict: bool) -> DataFrame:
    """The same as ``across`` from lists of ends."""
    dealt = _dealt(lists.filter((F.size("lefts") > 0) & (F.size("rights") > 0)), F.size("lefts").cast("double") * F.size("rights"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            person, parts, part = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            of_left, left, since, dated = _flat(batch.column(3))
            of_right, right, until, ended = _flat(batch.column(4))
            begin = np.searchsorted(of_right, np.arange(len(batch) + 1))
            at = np.arange(len(left)) - np.searchsorted(of_left, of_left)
            own = np.flatnonzero(dated & (at % parts[of_left] == part[of_left]))
            many = np.diff(begin)[of_left[own]]
            ends = np.cumsum(many)
            low = 0
            while low < len(own):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, side="right")))
                mine, n = own[low:high], many[low:high]
                a = np.repeat(np.arange(len(mine)), n)
                b = np.repeat(begin[of_left[mine]] - np.cumsum(n) + n, n) + np.arange(len(a))
                apart = until[b] - since[mine][a]
                wanted = ended[b] & (right[b] != left[mine][a]) & (apart > gap if strict else apart >= gap)
                sizes = np.bincount(a[wanted], minlength=len(mine))
                some = mine[sizes > 0]
                places = np.concatenate([[0], np.cumsum(sizes[sizes > 0])]).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(places), pa.array(right[b[wanted]]))
                yield pa.RecordBatch.from_arrays([pa.array(left[some]), pa.array(person[of_left[some]]), others], names=["first", "person_id", "others"])
                low = high

    return dealt.select("person_id", "parts", "part", "lefts", "rights").mapInArrow(paired, "first long, person_id long, others array<long>")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, day, is there a day?) of all ends in lists of (item, day)."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    item, days = lists.flatten().flatten()
    return (np.repeat(np.arange(len(sizes)), sizes), item.to_numpy(zero_copy_only=False).astype(np.int64),
            pc.fill_null(days, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(days).to_numpy(zero_copy_only=False))


def of_pairs(rows: DataFrame, amount: int = 0) -> DataFrame:
    """(first, person_id, others) from (person_id, i1, i2), in which a pair of a patient may come several times."""
    rows = dealt_if_many(rows.filter("person_id IS NOT NULL"), amount, "person_id", "i1")
    return rows.groupBy(F.col("i1").alias("first"), "person_id").agg(F.collect_set("i2").alias("others"))


def _counted(key: np.ndarray, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run of the key, other, count) in order, from the rows of sorted keys."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    others = lists.flatten().to_numpy(zero_copy_only=False)
    ids, code = np.unique(others, return_inverse=True)
    run = np.cumsum(np.append(False, (key[:, 1:] != key[:, :-1]).any(axis=0)))
    pair, count = np.unique(np.repeat(run, sizes) * max(len(ids), 1) + code, return_counts=True)
    return pair // max(len(ids), 1), ids[pair % max(len(ids), 1)], count


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, range, other, count) of whole first items and ranges, many at a time."""
    held_key, held = None, []

    def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, code = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        count = np.bincount(code, weights=np.concatenate([h[1] for h in held]), minlength=len(ids)).astype(np.int64)
        return np.full(len(ids), held_key[0]), np.full(len(ids), held_key[1]), ids, count

    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2)])
        run, other, count = _counted(key, batch.column(2))
        keys = key[:, np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))]
        if held and tuple(keys[:, 0]) != held_key:
            yield whole()
            held = []
        begin, end = (1 if held else 0), keys.shape[1] - 1
        if held:
            mine = run == 0
            held.append((other[mine], count[mine]))
            if not end:
                _, _, ids, sums = whole()
                held = [(ids, sums)]
                continue
            yield whole()
        inner = (run >= begin) & (run < end)
        yield keys[0, run[inner]], keys[1, run[inner]], other[inner], count[inner]
        last = run == end
        held_key, held = tuple(keys[:, end]), [(other[last], count[last])]
    if held:
        yield whole()


def top_pairs(rows: DataFrame, support: DataFrame, columns: tuple[str, str], k: int, most: int = RANGE, numbers: int = 0) -> DataFrame:
    """Counts (``columns``, n) of the pairs in (first, person_id, others); holds the k most frequent, ties by ids.

    A patient has a first item in one row. ``support`` (item, n) bounds the rows of each first item.
    ``numbers`` is how many others there are in all, about: a task sorts ``NUMBERS_PER_TASK`` of them.
    """
    hot = support.filter(F.col("n") > most).select(F.col("item").alias("first"), F.ceil(F.col("n") / most).cast("int").alias("ranges"))
    hot = keep(hot, "hot")
    # -1: all rows of the item are together
    placed = rows.join(hot, "first", "left").withColumn("range", F.coalesce(F.pmod(F.xxhash64("person_id"), F.col("ranges")).cast("int"), F.lit(-1)))
    dealt = dealt_out(placed.select("first", "range", "others"), numbers, "first", "range", per_task=NUMBERS_PER_TASK).sortWithinPartitions("first", "range")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((3, 0), np.int64)
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["first", "other", "n"])
        for first, part, other, count in _runs(batches):
            found = np.stack([first, other, count])
            if (part >= 0).any():
                yield out(found[:, part >= 0])
            best = np.concatenate([best, found[:, (part < 0) & (count >= (best[2].min() if best.shape[1] == k else 1))]], axis=1)
            best = best[:, np.lexsort((best[1], best[0], -best[2]))[:k]]
        yield out(best)

    found = keep(dealt.mapInArrow(search, "first long, other long, n long"), "found")
    return found.groupBy(F.col("first").alias(columns[0]), F.col("other").alias(columns[1])).agg(F.sum("n").alias("n"))
