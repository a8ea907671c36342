"""Discovery: what is common in the data.

Every function takes the tables and ``k`` and returns the k rows with the most patients, largest
first, ties by concept id (``k=None``: all rows). Names are added after the cut. Unless a
docstring says otherwise only valid standard concepts count.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from caseweave.functions.dates import OPEN_END, day_number, year_of
from caseweave.operators import bitmaps, chains, groups, heads, intervals, packed, pairs, ranking, sweep
from caseweave.operators.concepts import labels, valid_concepts
from caseweave.operators.demographics import UNKNOWN
from caseweave.operators.groups import count_sets, item_sets, prune_items, set_columns
from caseweave.schema import Tables
from caseweave.sources.readers import events
from caseweave.storage import dealt_if_many, keep

# --- shared steps -----------------------------------------------------------------------------


def _valid_events(tables: Tables, kind: str) -> DataFrame:
    domain = "Drug" if kind.startswith("drug") else "Condition"
    ids = valid_concepts(tables, domain).withColumnRenamed("concept_id", "item")
    return events(tables, kind).join(ids, "item", "left_semi")


def _amount(tables: Tables, kind: str) -> int:
    """Events, valid or not."""
    return events(tables, kind).count()


def _timed(tables: Tables, kind: str, repeated: bool = False) -> DataFrame:
    """(person_id, item, first, last) in day numbers.

    An exposure or occurrence without an end lasts one day, and one without a start is left out. An
    era that lacks either date stays: it overlaps nothing, so its patient has the item apart from others.
    With ``repeated`` equal rows may come several times.
    """
    rows, end = _valid_events(tables, kind), F.coalesce("end", "start")
    if kind.endswith("_era"):
        end = F.col("end")
    else:
        rows = rows.filter("start IS NOT NULL")
    rows = rows.select("person_id", "item", day_number("start").alias("first"), day_number(end).alias("last"))
    return rows if repeated else dealt_if_many(rows, _amount(tables, kind), "person_id", "item").distinct()


def _lasting(tables: Tables, kind: str, days: int, repeated: bool = False) -> DataFrame:
    """Every event lasts ``days`` days, so that events overlap when they start that close together."""
    return _timed(tables, kind, repeated).withColumn("last", F.col("first") + days)


def _baskets(tables: Tables, kind: str) -> DataFrame:
    """One row per patient and concept, however often it was recorded."""
    return dealt_if_many(_valid_events(tables, kind).select("person_id", "item"), _amount(tables, kind), "person_id", "item").distinct()


def _top_together(tables: Tables, kind: str, size: int, what: str, k: int | None) -> DataFrame:
    """The k sets that the most patients have at any time."""
    if size == 2 and k is not None:
        rows = _valid_events(tables, kind).select("person_id", "item")
        lists = keep(pairs.lists_of(rows, _amount(tables, kind)), "lists")
        support = lists.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
        counts = pairs.top_pairs(pairs.within_lists(lists), support, ("i1", "i2"), k, numbers=pairs.numbers_within(lists))
        return ranking.top_sets(tables, counts, _names(size, what), k)
    if k is None:
        return ranking.top_sets(tables, _together(size)(_baskets(tables, kind)), _names(size, what), k)
    baskets = tables.once(("baskets", kind), lambda: keep(_baskets(tables, kind), "baskets"))
    return ranking.top_sets(tables, _frequent(baskets, size, k, bitmaps.TOGETHER), _names(size, what), k)


def _frequent(rows: DataFrame, size: int, k: int, how: str, lasting: int = 0) -> DataFrame:
    """Counts of sets of three or more that hold the k most frequent; ``rows`` should be a kept table.

    The k-th best count among the sets of the few most common items is a floor; items below it are dropped
    before anything is laid out.
    """

    amount = rows.count()

    def lists(rows: DataFrame) -> DataFrame:
        parts = [] if how == bitmaps.OVERLAPPING else [packed.baskets(rows, size, amount)]
        parts += [] if how == bitmaps.TOGETHER else [sweep.packed_cliques(rows, size, amount, lasting)]
        return keep(reduce(DataFrame.unionByName, parts), "lists")

    support = groups.item_support(rows, amount)
    leading = rows.join(groups.leaders(support, size), "item", "left_semi")
    floor = groups.kth_best(bitmaps.top_sets(lists(leading), size, k, what=how), k)
    return bitmaps.top_sets(lists(groups.reaching(rows, support, floor)), size, k, floor, how)


def _names(size: int, what: str) -> dict[str, str]:
    return {f"i{n}": f"{what}{n}_name" for n in range(1, size + 1)}


def _top_sets(tables: Tables, rows: DataFrame, count: Callable, size: int, what: str, k: int | None, how: str | None = None, kind: str | None = None, lasting: int = 0) -> DataFrame:
    """The k sets with the most patients. Pairs are counted at once; larger sets by bitmaps where ``how`` says so,
    or else after items are pruned. ``kind`` says that the rows are all timed ones of a kind, ``lasting`` that they are that long."""
    if size > 2 and k is not None and how is not None:
        events = tables.once(("events", kind), lambda: keep(rows, "events")) if kind else keep(rows, "events")
        return ranking.top_sets(tables, _frequent(events, size, k, how, lasting), _names(size, what), k)
    if size > 2:
        rows = prune_items(keep(rows, "events"), count, size, k)
    return ranking.top_sets(tables, count(rows), _names(size, what), k)


def _together(size: int) -> Callable[[DataFrame], DataFrame]:
    """Patients that have all items of a set at any time."""

    def count(baskets: DataFrame) -> DataFrame:
        return count_sets(item_sets(baskets, ["person_id"], size), set_columns(size), unique=True)

    return count


def _overlapping_sets(rows: DataFrame, size: int) -> DataFrame:
    sets = item_sets(intervals.overlap_groups(rows), ["person_id", "day"], size)
    return sets.select("person_id", *intervals.in_order(size))


def _meeting(rows: DataFrame, size: int) -> DataFrame:
    """(person_id, i1 ..): sets that are under way on a common day; pairs come from the sweep."""
    return keep(sweep.overlapping_pairs(rows), "pairs") if size == 2 else _overlapping_sets(rows, size)


def _overlapping(size: int) -> Callable[[DataFrame], DataFrame]:
    """Patients in whom all items of a set are under way on a common day."""

    def count(rows: DataFrame) -> DataFrame:
        return count_sets(_meeting(rows, size), set_columns(size), unique=False)

    return count


def _top_meeting(tables: Tables, rows: DataFrame, amount: int, what: str, k: int | None) -> DataFrame:
    """The k pairs that are under way on a common day in the most patients; ``rows`` may be repeated."""
    if k is None:
        return ranking.top_sets(tables, _overlapping(2)(rows), _names(2, what), k)
    found = keep(sweep.overlapping_pairs(rows.filter("person_id IS NOT NULL"), amount=amount), "pairs")
    many = found.count()
    lists = keep(pairs.of_pairs(found, many), "lists")
    support = lists.groupBy(F.col("first").alias("item")).agg(F.count("*").alias("n"))
    return ranking.top_sets(tables, pairs.top_pairs(lists, support, ("i1", "i2"), k, numbers=many), _names(2, what), k)


def _top_separate_pairs(tables: Tables, kind: str, what: str, k: int) -> DataFrame:
    """The k pairs that the most patients have, but never on a common day: the items of a patient behind each item,
    less those that were under way with it."""
    rows = tables.once(("events", kind), lambda: keep(_timed(tables, kind), "events")).filter("person_id IS NOT NULL")
    amount = rows.count()
    lists = keep(pairs.lists_of(rows, amount), "lists")
    support = lists.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    met = keep(sweep.overlapping_pairs(rows, amount=amount), "pairs")
    numbers = pairs.numbers_within(lists)
    met = pairs.of_pairs(met, met.count()).withColumnRenamed("others", "met")
    met = dealt_if_many(met, numbers, "first", "person_id", per_task=pairs.NUMBERS_PER_TASK)
    have = dealt_if_many(pairs.within_lists(lists), numbers, "first", "person_id", per_task=pairs.NUMBERS_PER_TASK)
    others = F.when(F.col("met").isNull(), F.col("others")).otherwise(F.array_except("others", "met"))
    apart = have.join(met, ["first", "person_id"], "left").select("first", "person_id", others.alias("others")).filter(F.size("others") > 0)
    return ranking.top_sets(tables, pairs.top_pairs(apart, support, ("i1", "i2"), k, numbers=numbers), _names(2, what), k)


def _separate(size: int) -> Callable[[DataFrame], DataFrame]:
    """Patients that have all items of a set, but never all on a common day.

    Counted as a difference: patients with the set, less those with an overlap of it. The second
    group is part of the first and small, so nothing has to be anti-joined per patient.
    """

    def count(rows: DataFrame) -> DataFrame:
        columns = set_columns(size)
        have = item_sets(rows.select("person_id", "item").distinct(), ["person_id"], size)
        meet = _meeting(rows, size).distinct()
        signed = have.select(*columns, F.lit(1).alias("sign")).unionByName(meet.select(*columns, F.lit(-1).alias("sign")))
        return signed.groupBy(*columns).agg(F.sum("sign").alias("n")).filter("n > 0")

    return count


# --- combinations of drugs ----------------------------------------------------------------------


def drug_pairs_within_30_days(tables: Tables, k: int | None = 10, days: int = 30) -> DataFrame:
    return _top_meeting(tables, _lasting(tables, "drug", days, repeated=True), _amount(tables, "drug"), "drug", k)


def drug_pairs(tables: Tables, k: int | None = 10) -> DataFrame:
    return _top_together(tables, "drug", 2, "drug", k)


def drug_quads_chain_overlap(tables: Tables, k: int | None = 10) -> DataFrame:
    """Four drugs in id order, each overlapping the next, all starting 0 to 30 days after the first."""
    width = 30

    def count(rows: DataFrame) -> DataFrame:
        # A start within 30 days lies in the calendar cell of the first drug or in the next one.
        at, cell_keys = intervals.cell("first"), ["person_id", "cell"]

        def numbered(rows: DataFrame, n: int) -> DataFrame:
            renamed = [F.col(c).alias(f"{short}{n}") for c, short in (("item", "i"), ("first", "f"), ("last", "l"))]
            return rows.select(*cell_keys, *renamed)

        out = numbered(rows.withColumn("cell", at), 1)
        others = rows.withColumn("cell", F.explode(F.array(at, at - 1)))
        for n in (2, 3, 4):
            out = out.join(numbered(others, n), cell_keys).filter(
                f"i{n - 1} < i{n} AND f{n} BETWEEN f1 AND f1 + {width} AND f{n - 1} <= l{n} AND l{n - 1} >= f{n}"
            )
        return count_sets(out, set_columns(4), unique=False)

    rows = _timed(tables, "drug")
    if k is None:
        return ranking.top_sets(tables, count(rows), _names(4, "drug"), k)
    return ranking.top_sets(tables, chains.top_chains(rows, width, k), _names(4, "drug"), k)


def drug_quads_overlapping(tables: Tables, k: int | None = 10) -> DataFrame:
    """Four drugs, every two of them overlapping; no limit in days."""
    count = lambda: _top_sets(tables, _timed(tables, "drug"), _overlapping(4), 4, "drug", k, bitmaps.OVERLAPPING)
    return tables.once(("drug quads overlapping", k), count)


def drug_quads_overlapping_in_head(tables: Tables, k: int | None = 10, head: int | None = None) -> DataFrame:
    """The same, on demand among the ``head`` most common drugs only; all drugs when it is None."""
    if head is None:
        return drug_quads_overlapping(tables, k)
    rows = _timed(tables, "drug").join(heads.most_common(_valid_events(tables, "drug"), head), "item", "left_semi")
    return _top_sets(tables, rows, _overlapping(4), 4, "drug", k, bitmaps.OVERLAPPING)


def drug_quads_in_head(tables: Tables, k: int | None = 10, head: int | None = None) -> DataFrame:
    """Four drugs ever taken, by era, counted by drug name; withdrawn concepts count.

    ``head`` limits them to the most common by era, before the concept check; None is all drugs.
    """
    eras = events(tables, "drug_era")
    known = tables.concept.filter("domain_id = 'Drug' AND standard_concept = 'S'").withColumnRenamed("concept_id", "item").select("item", "concept_name")
    if head is not None:
        known = known.join(heads.most_common(eras, head), "item", "left_semi")
    # Concepts of one name share an id, so that the shuffle carries numbers and not names.
    taken = known.join(eras.select("item").distinct(), "item", "left_semi")
    named = taken.select("item", F.min("item").over(Window.partitionBy("concept_name")).alias("label"))
    baskets = keep(eras.select("person_id", "item").distinct().join(named, "item"), "baskets")
    if k is not None and not baskets.filter("item <> label").limit(1).count():  # every name is one concept
        counts = _frequent(baskets.select("person_id", "item"), 4, k, bitmaps.TOGETHER)
    elif k is None:
        sets = item_sets(baskets, ["person_id"], 4).select("person_id", *[F.col(f"label{n}").alias(f"i{n}") for n in range(1, 5)])
        counts = count_sets(sets, set_columns(4), unique=False)
    else:
        counts = groups.frequent_sets(baskets, 4, k)
    return ranking.top_sets(tables, counts, _names(4, "drug"), k)


def drug_triples_within_30_days(tables: Tables, k: int | None = 10, days: int = 30) -> DataFrame:
    return _top_sets(tables, _lasting(tables, "drug", days), _overlapping(3), 3, "drug", k, bitmaps.OVERLAPPING)


FIRST_PATIENTS, MORE_PATIENTS = 64, 8  # patients of the first slice, and how many times more each next one has


def _slice_with_triples(tables: Tables, rows: DataFrame, k: int) -> DataFrame:
    """Rows of the first patients by id, so many that k of them have three drugs under way on one day; all if fewer do.

    Slices of patients grow until one suffices: a slice is a range of ids, which the scan can use to
    skip what lies beyond it. A patient with a triple gives at least one row of the result.
    """
    patients, many = tables.person.select("person_id"), FIRST_PATIENTS
    while True:
        last = patients.orderBy("person_id").limit(many).agg(F.max("person_id"), F.count("*")).first()
        if last[1] < many:  # nobody is left, but for those whom the patient table does not know
            return rows
        some = keep(rows.filter(F.col("person_id") <= last[0]), "slice")
        ends = F.least("last", some.agg(F.max("first")).scalar())  # no later day is looked at
        able = keep(sweep.cliques(some.withColumn("last", ends), 3).select("person_id").distinct().orderBy("person_id").limit(k), "able")
        if able.count() == k:
            return some.join(able, "person_id", "left_semi")
        many *= MORE_PATIENTS


def drug_triples_overlapping(tables: Tables, k: int | None = 10, in_order: bool = True) -> DataFrame:
    """Single occurrences of three drugs with a common period; a missing end date leaves it open.

    All drug concepts count. The rows are not ranked by number of patients: they are the first by
    patient and drug, or any k rows when ``in_order`` is false, which is much cheaper.
    """
    start = F.col("start")
    rows = events(tables, "drug").filter("start IS NOT NULL").select(
        "person_id", "item", day_number(start).alias("first"),
        day_number(F.coalesce("end", F.lit(OPEN_END).cast("date"))).alias("last"),
    )
    if k is not None:
        rows = _slice_with_triples(tables, rows, k)
    rows = rows.distinct()
    active = intervals.active_on_start_days(rows, ["person_id"], open_ended=True).select(
        "person_id", "day", "item", "last", (F.col("first") == F.col("day")).cast("int").alias("fresh")
    )
    sets = (
        item_sets(active, ["person_id", "day"], 3)
        .select(
            "person_id", *intervals.in_order(3),
            F.date_from_unix_date("day").alias("overlap_start"),
            F.date_from_unix_date(F.least("last1", "last2", "last3")).alias("overlap_end"),
        )
    )
    order = ["person_id", "i1", "i2", "i3", "overlap_start", "overlap_end"]
    if in_order or k is None:
        sets = ranking.ordered(sets.distinct(), order, k)
    else:
        sets = sets.limit(k)
    named = ranking.with_names(tables, sets, _names(3, "drug"), "left")
    return ranking.ordered(named, order, k).select(
        "person_id", *_names(3, "drug").values(), "overlap_start", "overlap_end"
    )


def drug_triples_separate(tables: Tables, k: int | None = 10) -> DataFrame:
    """Three drugs by era, taken by one patient but never all at the same time."""
    return _top_sets(tables, _timed(tables, "drug_era"), _separate(3), 3, "drug", k, bitmaps.SEPARATE)


# --- combinations of conditions -------------------------------------------------------------------


def condition_pairs_within_30_days(tables: Tables, k: int | None = 10, days: int = 30) -> DataFrame:
    return _top_meeting(tables, _lasting(tables, "condition", days, repeated=True), _amount(tables, "condition"), "condition", k)


def condition_pairs(tables: Tables, k: int | None = 10) -> DataFrame:
    return _top_together(tables, "condition", 2, "condition", k)


def condition_pairs_separate(tables: Tables, k: int | None = 10) -> DataFrame:
    """Two conditions by era, in one patient but never at the same time."""
    if k is not None:
        return _top_separate_pairs(tables, "condition_era", "condition", k)
    return _top_sets(tables, _timed(tables, "condition_era"), _separate(2), 2, "condition", k)


def condition_quads_within_1000_days(tables: Tables, k: int | None = 10, days: int = 1000) -> DataFrame:
    return _top_sets(tables, _lasting(tables, "condition", days), _overlapping(4), 4, "condition", k, bitmaps.OVERLAPPING, lasting=days)


def condition_quads(tables: Tables, k: int | None = 10) -> DataFrame:
    return _top_together(tables, "condition", 4, "condition", k)


def condition_quads_separate(tables: Tables, k: int | None = 10) -> DataFrame:
    return _top_sets(tables, _timed(tables, "condition_era"), _separate(4), 4, "condition", k, bitmaps.SEPARATE, "condition_era")


def condition_triples_within_300_days(tables: Tables, k: int | None = 10, days: int = 300) -> DataFrame:
    return _top_sets(tables, _lasting(tables, "condition", days), _overlapping(3), 3, "condition", k, bitmaps.OVERLAPPING, lasting=days)


def condition_triples(tables: Tables, k: int | None = 10) -> DataFrame:
    return _top_together(tables, "condition", 3, "condition", k)


def condition_triples_separate(tables: Tables, k: int | None = 10) -> DataFrame:
    return _top_sets(tables, _timed(tables, "condition_era"), _separate(3), 3, "condition", k, bitmaps.SEPARATE, "condition_era")


# --- one event after another -----------------------------------------------------------------------


def _first_and_last(tables: Tables, kind: str) -> DataFrame:
    """First and last day of every item of a patient; all an "earlier than" test needs."""
    return dealt_if_many(_valid_events(tables, kind), _amount(tables, kind), "person_id", "item").groupBy("person_id", "item").agg(
        F.min(day_number("start")).alias("first"), F.max(day_number("start")).alias("last")
    )


def _followed(
    earlier: DataFrame, later: DataFrame | None, gap: int, strict: bool, k: int | None = None, amount: int = 0,
    once: Callable[[Callable[[], DataFrame]], DataFrame] = lambda make: make(),
) -> DataFrame:
    """Patients per (a, b) with some b that starts more than (or at least) ``gap`` days after some a; b is of the same
    rows when ``later`` is None. Holds the k most frequent pairs. ``amount`` is the number of rows, about; ``once`` makes
    the kept lists of ends, which are the same for every gap."""
    if k is not None:
        rows = earlier.withColumns({"earlier": F.lit(True), "later": F.lit(later is None)})
        if later is not None:
            rows = rows.unionByName(later.withColumns({"earlier": F.lit(False), "later": F.lit(True)}))
        lists = once(lambda: keep(pairs.ends_of(rows, amount), "ends"))
        support = lists.select(F.explode("lefts.item").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
        return pairs.top_pairs(pairs.across_lists(lists, gap, strict), support, ("a", "b"), k, numbers=pairs.numbers_across(lists))
    apart = F.col("last_b") - F.col("first_a")
    found = groups.pairs_across(
        earlier.select("person_id", F.col("item").alias("a"), F.col("first").alias("first_a")),
        (earlier if later is None else later).select("person_id", F.col("item").alias("b"), F.col("last").alias("last_b")),
        (F.col("a") != F.col("b")) & (apart > gap if strict else apart >= gap),
    )
    return count_sets(found, ["a", "b"], unique=True)


def _top_followed(tables: Tables, kind: str, gap: int, strict: bool, names: dict[str, str], k: int | None) -> DataFrame:
    rows = _first_and_last(tables, kind)
    once = lambda make: tables.once(("ends", kind), make)
    return ranking.top_sets(tables, _followed(rows, None, gap, strict, k, _amount(tables, kind), once), names, k)


def condition_then_condition(tables: Tables, k: int | None = 10) -> DataFrame:
    """Condition b on a later day than condition a."""
    return _top_followed(tables, "condition", 0, True, {"a": "first_condition", "b": "second_condition"}, k)


def condition_30_days_after_condition(tables: Tables, k: int | None = 10, days: int = 30) -> DataFrame:
    """Condition b at least 30 days after condition a."""
    return _top_followed(tables, "condition", days, False, {"a": "condition_a_name", "b": "condition_b_name"}, k)


def drug_30_days_after_drug(tables: Tables, k: int | None = 10, days: int = 30) -> DataFrame:
    """A drug started at least 30 days after another; the later drug comes first in the row."""
    out = _top_followed(tables, "drug", days, False, {"a": "drug_a_name", "b": "drug_b_name"}, k)
    return out.select("drug_b_name", "drug_a_name", "person_count")


def drug_directly_followed_by_drug(tables: Tables, k: int | None = 10) -> DataFrame:
    """A valid exposure and the very next one of the patient, of a different drug.

    The order is by start date, then exposure id. Next rows are found inside each day, and days
    are then linked by their last and first rows, so that no task holds all rows of a patient.
    """
    ids = valid_concepts(tables, "Drug").withColumnRenamed("concept_id", "item")
    rows = tables.drug_exposure.select(
        "person_id", F.col("drug_concept_id").alias("item"), F.col("drug_exposure_start_date").alias("start"),
        F.col("drug_exposure_id").alias("id"),
    ).join(ids, "item", "left_semi")
    inside = rows.select(
        "person_id", F.col("item").alias("a"),
        F.lead("item").over(Window.partitionBy("person_id", "start").orderBy("id")).alias("b"),
    )
    days = rows.groupBy("person_id", "start").agg(F.min_by("item", "id").alias("opens"), F.max_by("item", "id").alias("closes"))
    between = days.select(
        "person_id", F.col("closes").alias("a"),
        F.lead("opens").over(Window.partitionBy("person_id").orderBy(F.asc_nulls_last("start"))).alias("b"),
    )
    pairs = inside.unionByName(between).filter("a <> b")
    return ranking.top_sets(
        tables, count_sets(pairs, ["a", "b"], unique=False), {"a": "drug_a_name", "b": "drug_b_name"}, k
    )


def _drug_after_condition(tables: Tables, gap: int, k: int | None) -> DataFrame:
    conditions, drugs = (_first_and_last(tables, kind) for kind in ("condition", "drug"))
    amount = _amount(tables, "condition") + _amount(tables, "drug")
    once = lambda make: tables.once(("ends", "condition", "drug"), make)
    return ranking.top_sets(tables, _followed(conditions, drugs, gap, True, k, amount, once), {"a": "condition_name", "b": "drug_name"}, k)


def drug_after_condition(tables: Tables, k: int | None = 10) -> DataFrame:
    return _drug_after_condition(tables, 0, k)


def drug_30_days_after_condition(tables: Tables, k: int | None = 10, days: int = 30) -> DataFrame:
    """A drug started more than 30 days after the condition."""
    return _drug_after_condition(tables, days, k)


# --- the most common value per condition --------------------------------------------------------------


def _with_value(tables: Tables, counts: DataFrame, value: str, k: int | None, break_ties: bool = True) -> DataFrame:
    order = [F.desc("total"), "item", "value"]
    best = ranking.most_common_value(counts, break_ties)
    best = best if k is None else best.orderBy(*order).limit(k)
    named = ranking.ordered(ranking.with_names(tables, best, {"item": "condition_name"}), order, k)
    return named.select("condition_name", F.col("value").alias(value), "n", "total")


def _patients_by_trait(tables: Tables, trait: DataFrame) -> DataFrame:
    """Patients per (item, value), from (person_id, value). Each patient meets an item once."""
    have = _baskets(tables, "condition")
    return have.join(trait, "person_id").groupBy("item", "value").agg(F.count_distinct("person_id").alias("n"))


def _trait(tables: Tables, key: str, label: DataFrame) -> DataFrame:
    label = label.withColumnRenamed("concept_id", key)
    return tables.person.join(label, key, "left").select("person_id", F.coalesce("label", F.lit(UNKNOWN)).alias("value"))


def _any_concept(tables: Tables) -> DataFrame:
    return tables.concept.select("concept_id", F.col("concept_name").alias("label"))


def condition_common_age(tables: Tables, k: int | None = 10) -> DataFrame:
    """Counts records, not patients; ages 0 to 120; all ages that share the first place are kept."""
    counts = (
        _valid_events(tables, "condition")
        .select("person_id", "item", year_of("start").alias("year"))
        .groupBy("person_id", "item", "year")
        .agg(F.count("*").alias("records"))
        .join(tables.person.select("person_id", "year_of_birth"), "person_id")
        .select("item", (F.col("year") - F.col("year_of_birth")).alias("value"), "records")
        .filter(F.col("value").between(0, 120))
        .groupBy("item", "value")
        .agg(F.sum("records").alias("n"))
    )
    return _with_value(tables, counts, "most_common_age", k, break_ties=False)


def condition_common_race(tables: Tables, k: int | None = 10) -> DataFrame:
    trait = _trait(tables, "race_concept_id", _any_concept(tables))
    return _with_value(tables, _patients_by_trait(tables, trait), "most_common_race", k)


def condition_common_state(tables: Tables, k: int | None = 10) -> DataFrame:
    trait = (
        tables.person.join(tables.location.filter("state IS NOT NULL"), "location_id")
        .select("person_id", F.col("state").alias("value"))
    )
    return _with_value(tables, _patients_by_trait(tables, trait), "most_common_state", k)


def condition_common_year(tables: Tables, k: int | None = 10) -> DataFrame:
    counts = (
        _valid_events(tables, "condition")
        .filter("start IS NOT NULL")
        .select("person_id", "item", year_of("start").alias("value"))
        .groupBy("item", "value")
        .agg(F.count_distinct("person_id").alias("n"))
    )
    return _with_value(tables, counts, "most_common_year", k)


def condition_common_ethnicity(tables: Tables, k: int | None = 10) -> DataFrame:
    trait = _trait(tables, "ethnicity_concept_id", _any_concept(tables))
    return _with_value(tables, _patients_by_trait(tables, trait), "most_common_ethnicity", k)


def condition_common_gender(tables: Tables, k: int | None = 10) -> DataFrame:
    """Only standard gender concepts have a name here; the gender comes first in the row."""
    trait = _trait(tables, "gender_concept_id", labels(tables, "Gender", "label"))
    out = _with_value(tables, _patients_by_trait(tables, trait), "most_common_gender", k)
    return out.select("most_common_gender", "condition_name", "n", "total")


# --- the most common items of each year ------------------------------------------------------------------


def _yearly(tables: Tables, kind: str, name: str, k: int | None, head: int | None) -> DataFrame:
    counts = (
        _valid_events(tables, kind)
        .select("person_id", "item", year_of("start").alias("year"))
        .groupBy("year", "item")
        .agg(F.count_distinct("person_id").alias("n"))
    )
    order = [F.asc_nulls_last("year"), F.desc("n"), "item"]
    best = counts if head is None else ranking.head_per_group(counts, "year", [F.desc("n"), "item"], head)
    best = best if k is None else best.orderBy(*order).limit(k)
    named = ranking.ordered(ranking.with_names(tables, best, {"item": name}), order, k)
    return named.select(name, "year", F.col("n").alias("patient_count"))


def drugs_of_each_year(tables: Tables, k: int | None = 10, head: int | None = None) -> DataFrame:
    """The drugs with the most patients of each start year; the first k rows by year.

    ``head`` keeps so many of each year; all of them when it is None.
    """
    return _yearly(tables, "drug", "drug_name", k, head)


def conditions_of_each_year(tables: Tables, k: int | None = 10, head: int | None = None) -> DataFrame:
    return _yearly(tables, "condition", "condition_name", k, head)


# --- the population ---------------------------------------------------------------------------------------


def birth_years(tables: Tables, k: int | None = 10) -> DataFrame:
    counts = tables.person.groupBy(F.col("year_of_birth").alias("year")).agg(F.count("*").alias("patient_count"))
    return ranking.ordered(counts, [F.desc("patient_count"), "year"], k)


def _by_concept(tables: Tables, key: str, label: DataFrame, how: str, name: str) -> DataFrame:
    counts = tables.person.groupBy(key).agg(F.count("*").alias("n"))
    named = counts.join(label.withColumnRenamed("concept_id", key), key, how)
    grouped = named.groupBy("label").agg(F.sum("n").alias("patient_count"))
    return grouped.select(F.coalesce("label", F.lit(UNKNOWN)).alias(name), "patient_count").orderBy(
        F.desc("patient_count"), name
    )


def ethnicities(tables: Tables, k: int | None = None) -> DataFrame:
    out = _by_concept(tables, "ethnicity_concept_id", _any_concept(tables), "left", "ethnicity")
    return out if k is None else out.limit(k)


def races(tables: Tables, k: int | None = None) -> DataFrame:
    """Patients without a race concept are left out."""
    label = tables.concept.filter("domain_id = 'Race'").select("concept_id", F.col("concept_name").alias("label"))
    out = _by_concept(tables, "race_concept_id", label, "inner", "race")
    return out if k is None else out.limit(k)


def genders(tables: Tables, k: int | None = None) -> DataFrame:
    label = labels(tables, "Gender", "label", valid_only=True)
    shown = label.select("concept_id", F.coalesce("label", F.lit(UNKNOWN)).alias("label"))
    counts = tables.person.groupBy("gender_concept_id").agg(F.count("*").alias("n"))
    out = (
        counts.join(shown.withColumnRenamed("concept_id", "gender_concept_id"), "gender_concept_id", "left")
        .groupBy(F.coalesce("label", F.lit(UNKNOWN)).alias("gender"))
        .agg(F.sum("n").alias("patient_count"))
    )
    return ranking.ordered(out, [F.desc("patient_count"), "gender"], k)


def _by_name(tables: Tables, kind: str, domain: str, name: str, k: int | None) -> DataFrame:
    known = labels(tables, domain, name, valid_only=True).withColumnRenamed("concept_id", "item")
    have = events(tables, kind).select("person_id", "item").distinct()
    counts = have.join(known, "item").groupBy(name).agg(F.count_distinct("person_id").alias("patient_count"))
    return ranking.ordered(counts, [F.desc("patient_count"), name], k)


def drugs(tables: Tables, k: int | None = 10) -> DataFrame:
    """Counted by drug name."""
    return _by_name(tables, "drug", "Drug", "drug_name", k)


def conditions(tables: Tables, k: int | None = 10) -> DataFrame:
    return _by_name(tables, "condition", "Condition", "condition_name", k)


def states(tables: Tables, k: int | None = 10) -> DataFrame:
    counts = (
        tables.person.groupBy("location_id")
        .agg(F.count_distinct("person_id").alias("n"))
        .join(tables.location.filter("state IS NOT NULL"), "location_id")
        .groupBy(F.col("state").alias("location"))
        .agg(F.sum("n").alias("patient_count"))
    )
    return ranking.ordered(counts, [F.desc("patient_count"), "location"], k)


# Catalogue: query id -> function.
DISCOVERIES: dict[str, Callable[..., DataFrame]] = {
    "Q0001": drug_pairs_within_30_days,
    "Q0002": drug_pairs,
    "Q0003": drug_quads_chain_overlap,
    "Q0004": drug_quads_overlapping,
    "Q0005": drug_quads_overlapping_in_head,
    "Q0006": drug_quads_in_head,
    "Q0007": drug_triples_within_30_days,
    "Q0008": drug_triples_overlapping,
    "Q0009": drug_triples_separate,
    "Q0010": condition_pairs_within_30_days,
    "Q0011": condition_pairs,
    "Q0012": condition_pairs_separate,
    "Q0013": condition_quads_within_1000_days,
    "Q0014": condition_quads,
    "Q0015": condition_quads_separate,
    "Q0016": condition_triples_within_300_days,
    "Q0017": condition_triples,
    "Q0018": condition_triples_separate,
    "Q0019": condition_then_condition,
    "Q0020": condition_30_days_after_condition,
    "Q0021": condition_common_age,
    "Q0022": condition_common_race,
    "Q0023": condition_common_state,
    "Q0024": condition_common_year,
    "Q0025": drug_30_days_after_drug,
    "Q0026": drug_directly_followed_by_drug,
    "Q0027": condition_common_ethnicity,
    "Q0028": drugs_of_each_year,
    "Q0029": drug_after_condition,
    "Q0030": drug_30_days_after_condition,
    "Q0031": condition_common_gender,
    "Q0032": birth_years,
    "Q0033": ethnicities,
    "Q0034": races,
    "Q0035": genders,
    "Q0036": drugs,
    "Q0037": conditions,
    "Q0038": states,
    "Q0039": conditions_of_each_year,
    "Q0040": drugs_of_each_year,
}
