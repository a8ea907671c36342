"""Events that are under way at the same time.

Intervals that all overlap share a day, and the first such day is the latest of their starts. So
it is enough to look at the start days of a group: ``active_on_start_days`` gives, for each of
them, every event whose interval holds that day. After this an overlap of any number of events is
an equi-join on (keys, day). A set of events that start within N days of each other is the same
thing with every event lasting N days.

The interval join itself runs on (keys, calendar cell) with the exact day test as a filter: the
rows of one patient are divided by time, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

CELL_DAYS = 32


def cell(day: Column | str) -> Column:
    return F.floor((F.col(day) if isinstance(day, str) else day) / CELL_DAYS).cast("int")


def active_on_start_days(rows: DataFrame, keys: Sequence[str], open_ended: bool = False) -> DataFrame:
    """Rows (keys, item, first, last) in day numbers -> (keys, day, item, first, last); rows should be distinct.

    Rows with an empty interval or a missing start are dropped. With ``open_ended`` an interval may
    outlive the data; it then occupies no cell after the last start day, as no later day is looked at.
    """
    keys = list(keys)
    rows = rows.filter("first <= last").select(*keys, "item", "first", "last")
    reach = F.least(F.col("last"), rows.agg(F.max("first")).scalar()) if open_ended else F.col("last")
    spans = rows.withColumn("cell", F.explode(F.sequence(cell("first"), cell(reach))))
    days = rows.select(*keys, F.col("first").alias("day")).distinct().withColumn("cell", cell("day"))
    return (
        days.join(spans, [*keys, "cell"])
        .filter("first <= day AND day <= last")
        .select(*keys, "day", "item", "first", "last")
    )


def overlap_groups(rows: DataFrame) -> DataFrame:
    """Groups for ``item_sets``: one row per (person, day, item); fresh = the item starts on that day.

    Only the longest of the events of an item with the same start matters here. A set is built on
    the days on which one of its members starts, so each common period is met on its first day.
    """
    longest = rows.filter("first <= last").groupBy("person_id", "item", "first").agg(F.max("last").alias("last"))
    return (
        active_on_start_days(longest, ["person_id"])
        .groupBy("person_id", "day", "item")
        .agg(F.max((F.col("first") == F.col("day")).cast("int")).alias("fresh"))
    )


def in_order(size: int) -> list[Column]:
    """The items of sets that were built fresh items first, in rising order as i1 .. i<size>."""
    items = [F.col(f"i{n}") for n in range(1, size + 1)]
    if size == 2:
        return [F.least(*items).alias("i1"), F.greatest(*items).alias("i2")]
    rising = F.sort_array(F.array(*items))
    return [rising[n].alias(f"i{n + 1}") for n in range(size)]
