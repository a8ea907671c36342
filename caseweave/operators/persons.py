"""Tests a patient must pass, for many instances of a criterion at once.

``hits`` is a DataFrame (instance_id, person_id, slot, ...) of events that belong to the concept
set of a slot. Every test reduces it by partial aggregation before the shuffle, so the number of
records of one patient or one concept does not matter; none of them joins hits with hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["instance_id", "person_id"]


def _bit(slot: str = "slot") -> Column:
    return F.expr(f"shiftleft(1, {slot})")


def _all_slots(size: int) -> int:
    return (1 << size) - 1


def having_any(hits: DataFrame) -> DataFrame:
    return hits.select(*KEY).distinct()


def having_all(hits: DataFrame, size: int) -> DataFrame:
    """Every slot hit at any time."""
    seen = hits.groupBy(*KEY).agg(F.bit_or(_bit()).alias("seen"))
    return seen.filter(F.col("seen") == _all_slots(size)).select(*KEY)


def having_all_within(hits: DataFrame, size: int, days: int) -> DataFrame:
    """Every slot hit inside one period of ``days`` days; hits carry ``day``.

    Such a period may be taken to end on a hit, so one pass over the days of a patient finds it.
    Patients who do not hit every slot are dropped first; they are usually most of them. Then days are
    merged: a patient's window holds days, not records. Hits that are dealt out by patient are not moved again.
    """
    known = hits.filter("day IS NOT NULL AND instance_id IS NOT NULL AND person_id IS NOT NULL")
    dealt = known.select(*KEY, "slot", "day", F.bit_or(_bit()).over(Window.partitionBy(*KEY)).alias("seen"))
    daily = dealt.filter(F.col("seen") == _all_slots(size)).groupBy(*KEY, "day").agg(F.bit_or(_bit()).alias("seen"))
    period = Window.partitionBy(*KEY).orderBy("day").rangeBetween(-days, 0)
    found = daily.withColumn("seen", F.bit_or("seen").over(period)).filter(F.col("seen") == _all_slots(size))
    return found.select(*KEY).distinct()


def having_after(hits: DataFrame, earlier: int, later: int, gap: int, strict: bool) -> DataFrame:
    """Some hit of slot ``later`` more than (or at least) ``gap`` days after one of slot ``earlier``.

    The first of the one and the last of the other decide it; hits carry their ``first`` and ``last`` day.
    """
    ends = hits.groupBy(*KEY).agg(
        F.min(F.when(F.col("slot") == earlier, F.col("first"))).alias("first"),
        F.max(F.when(F.col("slot") == later, F.col("last"))).alias("last"),
    )
    apart = F.col("last") - F.col("first")
    return ends.filter(apart > gap if strict else apart >= gap).select(*KEY)


def having_short_overlap(hits: DataFrame, size: int, days: int) -> DataFrame:
    """One hit per slot, all overlapping, with a common period of at most ``days`` days.

    Hits carry first and last day. A common period starts on the start day of one of its hits, and is
    short when one of them ends at most ``days`` days later. So a hit is tested on its first day: every
    other slot must have a hit under way, and the hit itself or one of those must end soon. A slot has a
    hit under way when the latest end of what has begun is not over; one that ends soon, when that is so
    of the tails, the last ``days`` days of every hit. Both are running maxima over the starts of a
    patient, so hits are shuffled once, and none are joined with hits. Patients
    who do not hit every slot are dropped first.
    """
    first, last = F.col("first"), F.col("last")
    marks = F.array(
        F.struct(first.alias("day"), last.alias("end"), (last <= first + days).alias("tail"), F.lit(True).alias("starts")),
        F.when(last > first + days, F.struct((last - days).alias("day"), last.alias("end"), F.lit(True).alias("tail"), F.lit(False).alias("starts"))),
    )
    known = hits.filter("first <= last AND instance_id IS NOT NULL AND person_id IS NOT NULL")
    dealt = known.select(*KEY, "slot", "first", "last", F.bit_or(_bit()).over(Window.partitionBy(*KEY)).alias("seen"))
    marked = dealt.filter(F.col("seen") == _all_slots(size)).select(*KEY, "slot", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).select(*KEY, "slot", "m.*")
    so_far = Window.partitionBy(*KEY).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    latest = lambda slot, kind: F.max(F.when((F.col("slot") == slot) & F.col(kind), F.col("end"))).over(so_far)
    ends = [latest(slot, kind).alias(f"{name}{slot}") for slot in range(size) for name, kind in (("open", "starts"), ("soon", "tail"))]
    marked = marked.select("*", *ends)
    complete, short = F.lit(True), F.col("tail")
    for slot in range(size):
        own = F.col("slot") == slot
        complete = complete & (own | F.coalesce(F.col(f"open{slot}") >= F.col("day"), F.lit(False)))
        short = short | (~own & F.coalesce(F.col(f"soon{slot}") >= F.col("day"), F.lit(False)))
    return marked.filter(F.col("starts") & complete & short).select(*KEY).distinct()


def count_persons(instances: DataFrame, persons: DataFrame) -> DataFrame:
    """Patients per instance, zero included; ``persons`` has one row per (instance, person)."""
    counts = persons.groupBy("instance_id").agg(F.count("*").alias("number_of_patients"))
    return (
        instances.select("instance_id")
        .join(counts, "instance_id", "left")
        .select("instance_id", F.coalesce("number_of_patients", F.lit(0)).alias("number_of_patients"))
    )
