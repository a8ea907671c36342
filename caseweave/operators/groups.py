"""Items that occur together inside a group (a patient, or a patient on one day).

Sets of k items are built by equi-joining the group with itself k - 1 times, each set in one order
only. Two things keep that affordable:

* ``prune_items`` drops, exactly, every item that cannot be part of a top-k set. No set is more
  frequent than its rarest item, so an item below the k-th best count found so far is out.
* Groups hold each item once, which bounds them by the vocabulary whatever the number of records.
  Groups that would still give more than ``SETS_PER_TASK`` sets are cut by combination rank: with the
  items in order, the number of sets before those that begin with two given items is known, and a part
  takes an equal stretch of that numbering. A first item that has many sets is in several parts, with
  some of its second items in each. Group sizes are counted by aggregation, and only large groups are
  looked up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseweave.storage import dealt_if_many, keep

SETS_PER_TASK = 1_000_000
SEED_SETS = 2_000  # sets of the leading items that give the first lower bound, about


def seeds(size: int) -> int:
    """The number of leading items that have about ``SEED_SETS`` sets of a size."""
    n = size
    while math.comb(n + 1, size) <= SEED_SETS:
        n += 1
    return n


def _choose(n: Column, size: int) -> Column:
    """n over size, for n from 0."""
    out = F.lit(1.0)
    for j in range(size):
        out = out * (n - j) / (j + 1)
    return out


def large_groups(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, n, sets, parts) of groups that are to be cut: items, sets of ``size`` of them, and the parts.

    With a column ``fresh`` (1 or 0) only sets with a fresh item are counted.
    """
    old = F.count(F.when(F.col("fresh") == 0, 1)) if "fresh" in rows.columns else F.lit(0)
    sized = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), old.cast("double").alias("old"))
    sets = _choose(F.col("n"), size) - (_choose(F.col("old"), size))
    return sized.withColumn("sets", sets).filter(F.col("sets") > SETS_PER_TASK).select(*keys, "n", "sets", F.ceil(F.col("sets") / SETS_PER_TASK).cast("int").alias("parts"))


def _ranked(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Rows with n, sets and parts of their group, their ``rank`` in it, and how many sets begin ``before`` them.

    All of that is null for rows of groups that are not cut. Only rows of large groups are ranked.
    """
    sized = rows.join(keep(large_groups(rows, keys, size), "large"), [*keys], "left")
    order = [F.desc("fresh"), "item"] if "fresh" in rows.columns else ["item"]
    large = sized.filter("parts IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("double") - 1)
    small = sized.filter("parts IS NULL").withColumn("rank", F.lit(None).cast("double"))
    every = small.unionByName(large)
    return every.withColumn("before", _choose(F.col("n"), size) - _choose(F.col("n") - F.col("rank"), size))


def _part_of(before: Column, parts: str = "parts", sets: str = "sets") -> Column:
    """The part that a set with so many before it lies in."""
    return F.least(F.floor(before * F.col(parts) / F.col(sets)), F.col(parts) - 1).cast("int")


def first_items(ranked: DataFrame, size: int) -> DataFrame:
    """Each row in every part that has sets which begin with it."""
    last = _part_of(F.greatest(F.col("before") + _choose(F.col("n") - 1 - F.col("rank"), size - 1) - 1, F.col("before")))
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(_part_of(F.col("before")), last))
    return ranked.withColumn("part", F.explode(parts))


def other_items(ranked: DataFrame) -> DataFrame:
    """Each row in every part that has sets which begin before it."""
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), _part_of(F.col("before"))))
    return ranked.withColumn("part", F.explode(parts))


def _in_part(size: int) -> Column:
    """Do the sets of this first and second item lie in this part? Their number before is known from both ranks."""
    before = F.col("before1") + _choose(F.col("n1") - 1 - F.col("rank1"), size - 1) - _choose(F.col("n1") - F.col("rank2"), size - 1)
    return F.col("rank1").isNull() | (_part_of(before, "parts1", "sets1") == F.col("part"))


def item_sets(groups: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """All item tuples of every group, items in rising order: keys, i1 .. i<size>.

    Any further column c of ``groups`` comes along as c1 .. c<size>. With a column ``fresh`` (1 or 0)
    only sets with a fresh item are built: fresh items come first, then the others, both rising, and
    the first item must be fresh. So the join starts from the few fresh rows and nothing is thrown away.
    """
    keys = list(keys)
    extra = [c for c in groups.columns if c not in (*keys, "item")]
    ranked = _ranked(groups, keys, size)

    def numbered(rows: DataFrame, n: int, *more: str) -> DataFrame:
        return rows.select(*keys, "part", F.col("item").alias(f"i{n}"), *[F.col(c).alias(f"{c}{n}") for c in (*extra, *more)])

    def rising(n: int) -> str:
        if "fresh" not in extra:
            return f"i{n - 1} < i{n}"
        return f"fresh{n - 1} > fresh{n} OR (fresh{n - 1} = fresh{n} AND i{n - 1} < i{n})"

    out = numbered(first_items(ranked.filter("fresh = 1") if "fresh" in extra else ranked, size), 1, "n", "sets", "parts", "rank", "before")
    others = other_items(ranked)
    for n in range(2, size + 1):
        out = out.join(numbered(others, n, *(["rank"] if n == 2 else [])), [*keys, "part"]).filter(rising(n))
        if n == 2:
            out = out.filter(_in_part(size)).drop("n1", "sets1", "parts1", "rank1", "before1", "rank2")
    return out.drop("part")


def set_columns(size: int) -> list[str]:
    return [f"i{n}" for n in range(1, size + 1)]


def pairs_across(left: DataFrame, right: DataFrame, wanted: Column) -> DataFrame:
    """Rows of two per-patient frames joined on person_id where ``wanted`` holds.

    Apart from person_id the frames share no column name; the item column of ``left`` is a. A patient
    with many pairs is cut into parts of the left rows, or of the right rows where these are more.
    """
    key = ["person_id"]
    sizes = [side.groupBy(*key).agg(F.count("*").alias(name)) for side, name in ((left, "lefts"), (right, "rights"))]
    sized = sizes[0].join(sizes[1], key).withColumn("parts", F.ceil(F.col("lefts") * F.col("rights") / SETS_PER_TASK).cast("int"))
    share = F.least(F.col("parts"), F.greatest("lefts", "rights").cast("int"))
    large = sized.filter("parts > 1").select(*key, share.alias("parts"), (F.col("lefts") >= F.col("rights")).alias("by_left"))

    def dealt(rows: DataFrame, item: str, own: Column) -> DataFrame:
        tagged = rows.join(large, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("by_left", F.coalesce("by_left", F.lit(True)))
        one = F.array(F.pmod(F.hash(item), F.col("parts")))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        return tagged.withColumn("part", F.explode(F.when(own, one).otherwise(every))).drop("parts", "by_left")

    first, second = dealt(left, "a", F.col("by_left")), dealt(right, "b", ~F.col("by_left"))
    return first.join(second, [*key, "part"]).filter(wanted).drop("part")


def count_sets(sets: DataFrame, columns: Sequence[str], unique: bool) -> DataFrame:
    """Patients per set: columns + n. ``unique`` says that a (person, set) comes at most once."""
    agg = F.count("*") if unique else F.count_distinct("person_id")
    return sets.groupBy(*columns).agg(agg.alias("n"))


def top(counts: DataFrame, columns: Sequence[str], k: int | None, n: str = "n") -> DataFrame:
    """The k largest counts, ties by id; all of them when k is None."""
    if k is None:
        return counts
    return counts.orderBy(F.desc(n), *columns).limit(k)


def item_support(rows: DataFrame, amount: int = 0) -> DataFrame:
    """Patients per item; ``amount`` is the number of rows."""
    return dealt_if_many(rows.select("person_id", "item"), amount, "person_id", "item").distinct().groupBy("item").agg(F.count("*").alias("n"))


def kth_best(seeded: DataFrame, k: int) -> int:
    """The k-th best count, or 0 when there are fewer than k; one number."""
    best = seeded.select("n").orderBy(F.desc("n")).limit(k)
    return best.agg(F.when(F.count("*") == k, F.min("n")).otherwise(F.lit(0))).first()[0]


def leaders(support: DataFrame, size: int) -> DataFrame:
    return support.orderBy(F.desc("n"), "item").limit(seeds(size)).select("item")


def reaching(rows: DataFrame, support: DataFrame, floor: int) -> DataFrame:
    if floor <= 1:  # every item has a patient
        return rows
    return rows.join(support.filter(F.col("n") >= floor).select("item"), "item", "left_semi")


def prune_items(rows: DataFrame, count: Callable[[DataFrame], DataFrame], size: int, k: int | None) -> DataFrame:
    """Rows whose item can still be part of one of the k most frequent sets; exact.

    ``count(rows)`` gives the set counts (column ``n``) of event rows, and must never give a set
    more patients than one of its items has. It is run first on the few most common items: the
    k-th best count there is a floor that every wanted set reaches, and so must its items.
    ``rows`` is read several times and should be a kept table.
    """
    if k is None:
        return rows
    support = item_support(rows)
    seeded = count(rows.join(leaders(support, size), "item", "left_semi"))
    return reaching(rows, support, kth_best(seeded, k))


def frequent_sets(baskets: DataFrame, size: int, k: int) -> DataFrame:
    """Counts (i1 .. i<size>, n) of sets of three or four labels; holds all of the k most frequent.

    ``baskets`` has person_id, item and label: sets are built of items, in their order, and counted
    by label; without two items of one label these are the same. No set is more frequent than its
    rarest pair, so pairs below a floor are dropped and sets are grown from the pairs that are left.
    The floor is the k-th best count among sets of leading items, or else 2, if so many sets reach it;
    only if neither holds all sets are counted. It should be a kept table.
    """

    def labelled(sets: DataFrame, n: int) -> DataFrame:
        return sets.select("person_id", *[F.col(f"label{x}").alias(f"i{x}") for x in range(1, n + 1)])

    def all_sets(rows: DataFrame, n: int) -> DataFrame:
        return count_sets(labelled(item_sets(rows, ["person_id"], n), n), set_columns(n), unique=False)

    def grown(floor: int) -> DataFrame:
        pairs = item_sets(baskets, ["person_id"], 2)
        frequent = count_sets(labelled(pairs, 2), set_columns(2), unique=False).filter(F.col("n") >= floor)
        frequent = keep(frequent.select(F.col("i1").alias("x"), F.col("i2").alias("y")), "pairs")

        def only(sets: DataFrame, a: int, b: int) -> DataFrame:
            both = (F.col(f"label{a}") == F.col("x")) & (F.col(f"label{b}") == F.col("y"))
            return sets.join(frequent, both, "left_semi")

        pairs = keep(only(pairs, 1, 2), "pair-rows")
        out = pairs
        for n in range(3, size + 1):
            more = pairs.select("person_id", "i1", F.col("i2").alias(f"i{n}"), F.col("label2").alias(f"label{n}"))
            out = out.join(more, ["person_id", "i1"]).filter(F.col(f"i{n - 1}") < F.col(f"i{n}"))
            for before in range(2, n):
                out = only(out, before, n)
        return count_sets(labelled(out, size), set_columns(size), unique=False).filter(F.col("n") >= floor)

    support = baskets.select("person_id", F.col("label").alias("item")).distinct().groupBy("item").agg(F.count("*").alias("n"))
    leading = baskets.join(leaders(support, size).withColumnRenamed("item", "label"), "label", "left_semi")
    floor = kth_best(all_sets(leading, size), k)
    if floor > 1:
        return grown(floor)
    guess = keep(grown(2), "sets")
    return guess if guess.limit(k).count() == k else all_sets(baskets, size)
