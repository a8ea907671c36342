"""The most common items without a full count of all of them: a mergeable sketch, then an exact recount.

Each task counts its (person, item) rows in a table of ``WIDTH`` counters. When the table is full, the
counters are lowered by the size of the one that comes just behind the wanted number, and those at zero go
(Misra and Gries). So a counter is too low by at most what its task has lowered in all. Tables of tasks are
merged by adding counters and lowerings. An item among the k most common has a counter, or the total
lowering alone could make up for it; such items are the candidates, and only they are counted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseweave.storage import keep

WIDTH = 1 << 16


def sketch(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item, n, low) for every task: its counters; the row without an item has in ``low`` by how much they may be too low."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, counts, low = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            new, n = np.unique(batch.column(0).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            items, place = np.unique(np.concatenate([items, new]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(items)).astype(np.int64)
            if len(items) > 2 * width:
                less = int(np.partition(counts, len(counts) - width - 1)[len(counts) - width - 1])
                low, stay = low + less, counts > less
                items, counts = items[stay], counts[stay] - less
        columns = [pa.array([*items.tolist(), None], pa.int64()), pa.array([*counts.tolist(), None], pa.int64()), pa.array([None] * len(items) + [low], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "n", "low"])

    return rows.select(F.col("item").cast("long").alias("item")).mapInArrow(counted, "item long, n long, low long")


def most_common(rows: DataFrame, k: int, width: int = WIDTH) -> DataFrame:
    """The ``k`` items with the most patients, ties by id: (item). ``rows`` (person_id, item) may repeat."""
    pairs = rows.select("person_id", "item").distinct()
    tables = keep(sketch(pairs, max(width, k)), "sketch")
    missed = tables.agg(F.coalesce(F.sum("low"), F.lit(0))).first()[0]
    merged = tables.filter("item is not null").groupBy("item").agg(F.sum("n").alias("n"))
    if not missed:  # every item had a counter in every task
        return merged.orderBy(F.desc("n"), "item").limit(k).select("item")
    least = merged.orderBy(F.desc("n")).limit(k).agg(F.when(F.count("*") == k, F.min("n")).otherwise(0)).first()[0]
    if least > missed:  # an item without a counter has at most ``missed`` patients
        pairs = pairs.join(merged.filter(F.col("n") + missed >= least).select("item"), "item", "left_semi")
    return pairs.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k).select("item")
