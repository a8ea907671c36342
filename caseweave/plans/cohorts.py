"""The cohort criteria and their evaluation.

A ``Cohort`` describes a criterion; ``instances`` fill it in. An instance has

    instance_id  long
    codes        array<struct<vocabulary_id, concept_code>>, one per slot (if the cohort has slots)
    value        the wanted gender, race, ethnicity, state, year or age (if it has a trait)

and all instances of a cohort are evaluated by one Spark job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseweave.functions.dates import day_number, year_of
from caseweave.operators import persons
from caseweave.operators.concepts import labels, resolve_concepts, trait_concepts, trait_concepts_with_synonyms
from caseweave.operators.demographics import UNKNOWN, count_all, count_by, count_by_each
from caseweave.schema import Tables
from caseweave.sources.readers import events
from caseweave.storage import dealt_out, keep

ASKING = 1024  # instances in a list of those that ask for an item, about


@dataclass(frozen=True)
class Cohort:
    """One criterion.

    slots     (event kind, concept set variant) of each concept
    test      any, all, within, after, overlap, by_year, trait, report
    days      the period or gap of within, after and overlap
    strict    for after: more than ``days`` rather than at least
    earlier   for after: the slot that comes first
    trait     what ``value`` is compared with
    dims      the columns of a report
    """

    id: str
    name: str
    question: str
    slots: tuple[tuple[str, str], ...] = ()
    test: str = "any"
    days: int = 0
    strict: bool = True
    earlier: int = 0
    trait: str | None = None
    dims: tuple[str, ...] = ()
    known_patients: bool = False
    unknown: bool = True


def _n(kind: str, variant: str, size: int) -> tuple[tuple[str, str], ...]:
    return ((kind, variant),) * size


DRUG = "map_inner"
VALID = "map_coalesce_valid"
SELF = "map_coalesce_self"

# The question texts. {0}, {1} ... are the values of a discovered row, in order.
COHORTS: dict[str, Cohort] = {
    c.id: c
    for c in [
        Cohort("F0001", "by_gender_and_ethnicity", "Number of patients grouped by gender and ethnicity.",
               test="report", dims=("gender", "ethnicity")),
        Cohort("F0002", "by_race", "Count of patients grouped by race.", test="report", dims=("race",), unknown=False),
        Cohort("F0003", "two_drugs_within_days", "Counts of patients taking drug {0} and {1} within 30 days.",
               _n("drug", DRUG, 2), "within", days=30),
        Cohort("F0004", "two_drugs", "Counts of patients taking drug {0} and {1}.", _n("drug", DRUG, 2), "all"),
        Cohort("F0005", "either_of_two_drugs", "Counts of patients taking drug {0} or {1}.", _n("drug", DRUG, 2)),
        Cohort("F0006", "four_drugs_short_overlap", "Counts of patients taking drug {0}, {1}, {2} and {3} within 30 days.",
               _n("drug", DRUG, 4), "overlap", days=30),
        Cohort("F0007", "four_drugs", "Counts of patients taking drug {0}, {1}, {2} and {3}.", _n("drug", DRUG, 4), "all"),
        Cohort("F0008", "any_of_four_drugs", "Counts of patients taking drug {0}, {1}, {2} or {3}.", _n("drug", DRUG, 4)),
        Cohort("F0009", "three_drugs_within_days", "Counts of patients taking drug {0}, {1} and {2} within 30 days.",
               _n("drug", DRUG, 3), "within", days=30),
        Cohort("F0010", "three_drugs", "Counts of patients taking drug {0}, {1} and {2}.", _n("drug", DRUG, 3), "all"),
        Cohort("F0011", "any_of_three_drugs", "Counts of patients taking drug {0}, {1} or {2}.", _n("drug", DRUG, 3)),
        Cohort("F0012", "two_conditions_within_days", "Counts of patients with condition {0} and {1} within 30 days.",
               _n("condition", "map_coalesce_raw", 2), "within", days=30),
        Cohort("F0013", "two_conditions", "Counts of patients with condition {0} and {1}.", _n("condition", VALID, 2), "all"),
        Cohort("F0014", "either_of_two_conditions", "Counts of patients with condition {0} or {1}.", _n("condition", VALID, 2)),
        Cohort("F0015", "four_conditions_within_days",
               "Counts of patients with condition {0}, {1}, {2} and {3} within 1000 days.",
               _n("condition", VALID, 4), "within", days=1000),
        Cohort("F0016", "four_conditions", "Counts of patients with condition {0}, {1}, {2} and {3}.",
               _n("condition", VALID, 4), "all"),
        Cohort("F0017", "any_of_four_conditions", "Counts of patients with condition {0}, {1}, {2} or {3}.",
               _n("condition", VALID, 4)),
        Cohort("F0018", "three_conditions_within_days", "Counts of patients with condition {0}, {1} and {2} within 300 days.",
               _n("condition", VALID, 3), "within", days=300),
        Cohort("F0019", "three_conditions", "Counts of patients with condition {0}, {1} and {2}.",
               _n("condition", VALID, 3), "all"),
        Cohort("F0020", "any_of_three_conditions", "Counts of patients with condition {0}, {1} or {2}.",
               _n("condition", VALID, 3)),
        Cohort("F0021", "by_year_of_birth", "Distribution of patients by year of birth.", test="report", dims=("year_of_birth",)),
        Cohort("F0022", "condition_then_condition", "How many people have condition {0} followed by condition {1}?",
               _n("condition", VALID, 2), "after"),
        Cohort("F0023", "condition_days_after_condition",
               "How many people have condition {1} more than 30 days after diagnosed by condition {0}?",
               _n("condition", DRUG, 2), "after", days=30, strict=False),
        Cohort("F0024", "condition_at_age", "How many people have condition {0} at age {1}?",
               _n("condition", SELF, 1), trait="age"),
        Cohort("F0025", "condition_in_race", "How many people have condition {0} in the cohort of race {1}?",
               _n("condition", SELF, 1), trait="race"),
        Cohort("F0026", "condition_in_state", "How many people have condition {0} in the state {1}?",
               _n("condition", SELF, 1), trait="state"),
        Cohort("F0027", "condition_in_year", "How many people were diagnosed with condition {0} in year {1}?",
               _n("condition", SELF, 1), trait="year"),
        # The row of this one is (later drug, earlier drug).
        Cohort("F0028", "drug_days_after_drug",
               "How many people have treated by drug {0} after more than 30 days of starting with drug {1}?",
               _n("drug", DRUG, 2), "after", days=30, earlier=1),
        Cohort("F0029", "drug_then_drug", "How many people have treated by drug {0} followed by drug {1}?",
               _n("drug", DRUG, 2), "after"),
        Cohort("F0030", "condition_in_ethnicity", "How many people have condition {0} in the cohort of ethnicity {1}?",
               _n("condition", DRUG, 1), trait="ethnicity"),
        Cohort("F0031", "drug_in_year", "How many people were taking drug {0} in year {1}.",
               _n("drug", DRUG, 1), trait="year_span"),
        Cohort("F0032", "drug_after_condition", "How many people took drug {1} after being diagnosed with condition {0}?",
               (("condition", DRUG), ("drug", "map_only")), "after"),
        Cohort("F0033", "drug_days_after_condition",
               "How many people were treated by drug {1} more than 30 days after being diagnosed with condition {0}?",
               (("condition", DRUG), ("drug", DRUG)), "after", days=30),
        Cohort("F0034", "gender_with_condition", "Number of {0} patients with {1}.", _n("condition", DRUG, 1), trait="gender"),
        Cohort("F0035", "born_in_year", "Number of patients born in year {0}.", test="trait", trait="birth"),
        Cohort("F0036", "by_gender_and_state", "Number of patients by gender and state.", test="report", dims=("gender", "state")),
        Cohort("F0037", "by_ethnicity_and_state", "Number of patients grouped by ethnicity and residence state location.",
               test="report", dims=("ethnicity", "state")),
        Cohort("F0038", "by_ethnicity_and_birth", "Number of patients grouped by ethnicity and year of birth.",
               test="report", dims=("ethnicity", "year_of_birth")),
        Cohort("F0039", "by_ethnicity", "Number of patients grouped by ethnicity.", test="report", dims=("ethnicity",)),
        Cohort("F0040", "by_gender", "Number of patients grouped by gender.", test="report", dims=("gender",)),
        Cohort("F0041", "by_race_and_ethnicity", "Number of patients grouped by race and ethnicity.",
               test="report", dims=("race", "ethnicity")),
        Cohort("F0042", "by_race_and_gender", "Number of patients grouped by race and gender.",
               test="report", dims=("race", "gender")),
        Cohort("F0043", "by_race_and_state", "Number of patients grouped by race and residence state location.",
               test="report", dims=("race", "state")),
        Cohort("F0044", "by_race_and_birth", "Number of patients grouped by race and year of birth.",
               test="report", dims=("race", "year_of_birth")),
        Cohort("F0045", "by_state", "Number of patients grouped by residence state location.", test="report", dims=("state",)),
        Cohort("F0046", "by_birth_and_gender", "Number of patients grouped by year of birth and gender.",
               test="report", dims=("year_of_birth", "gender")),
        Cohort("F0047", "by_birth_and_state", "Number of patients grouped by year of birth and residence state location.",
               test="report", dims=("year_of_birth", "state")),
        Cohort("F0048", "all_patients", "Number of patients in the dataset.", test="report"),
        Cohort("F0049", "of_ethnicity", "Number of patients of ethnicity {0}.", test="trait", trait="ethnicity"),
        Cohort("F0050", "of_race", "Number of patients of race {0}.", test="trait", trait="race"),
        Cohort("F0051", "of_gender", "Number of patients of specific gender {0}.", test="trait", trait="gender"),
        Cohort("F0052", "taking_drug", "Number of patients taking {0}.", _n("drug", DRUG, 1), known_patients=True),
        Cohort("F0053", "with_condition", "Number of patients with {0}.", _n("condition", DRUG, 1)),
        Cohort("F0054", "in_state", "Number of patients with residence state location at {0}.", test="trait", trait="location"),
        Cohort("F0055", "condition_by_year", "Counts of patients with condition {0} grouped by year of diagnosis.",
               _n("condition", DRUG, 1), "by_year"),
        Cohort("F0056", "drug_by_year", "Counts of patients taking drug {0} grouped by year of prescription.",
               _n("drug", DRUG, 1), "by_year"),
    ]
}

_TRAIT_KEYS = {"gender": ("gender_concept_id", "Gender"), "race": ("race_concept_id", "Race"),
               "ethnicity": ("ethnicity_concept_id", "Ethnicity")}


def slot_rows(instances: DataFrame) -> DataFrame:
    """The concepts of each instance, one row per slot."""
    return instances.select("instance_id", F.posexplode("codes").alias("slot", "code")).select(
        "instance_id", "slot", "code.vocabulary_id", "code.concept_code"
    )


def _asked(tables: Tables, cohort: Cohort, instances: DataFrame) -> Iterator[tuple[str, DataFrame, DataFrame]]:
    """For each kind of events: the concept sets (code, item), and who asks for them (instance_id, slot, code)."""
    places = instances.select("instance_id", F.posexplode("codes").alias("slot", "code"))
    for kind, variant in dict.fromkeys(cohort.slots):
        mine = places.filter(F.col("slot").isin([n for n, slot in enumerate(cohort.slots) if slot == (kind, variant)]))
        codes = mine.select(F.col("code").alias("instance_id"), F.lit(0).alias("slot"), "code.vocabulary_id", "code.concept_code").distinct()
        sets = resolve_concepts(tables, codes, variant).select(F.col("instance_id").alias("code"), F.col("concept_id").alias("item"))
        yield kind, sets, mine


def hits(tables: Tables, cohort: Cohort, instances: DataFrame, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Events in the concept set of a slot: (instance_id, slot, person_id, ...).

    Instances share concepts. Each distinct concept is resolved once, its events are reduced by
    ``reduce`` (rows code, person_id, start, end -> code, person_id, ...), and only what is left goes
    out to the instances and slots that ask for the concept.
    """
    out = None
    for kind, sets, mine in _asked(tables, cohort, instances):
        found = reduce(events(tables, kind).join(sets, "item").drop("item")).join(mine, "code").drop("code")
        out = found if out is None else out.unionByName(found)
    return out


def hits_by_patient(tables: Tables, cohort: Cohort, instances: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The same with ``columns`` of every event, dealt out by patient: a test of a patient's hits moves nothing again.

    What moves is an event, once by item and once by patient, with lists of the instances and slots that ask for its
    item; hits are made of these where the test is. An item that very many ask for has several lists.
    """
    out, amount = None, 0.0
    for kind, sets, mine in _asked(tables, cohort, instances):
        asked = sets.join(mine, "code").select("item", "instance_id", F.col("slot").cast("byte").alias("slot"))
        many = F.ceil(F.count("*").over(Window.partitionBy("item")) / ASKING)
        asked = asked.withColumn("part", F.pmod(F.xxhash64("instance_id"), many))
        lists = asked.groupBy("item", "part").agg(F.collect_set(F.struct("instance_id", "slot")).alias("asking"))
        lists = keep(lists.select("item", F.col("asking.instance_id").alias("instances"), F.col("asking.slot").alias("slots")), "asking")
        each = lists.agg(F.sum(F.size("instances")) / F.count_distinct("item")).first()[0]
        amount += events(tables, kind).count() * (each or 0)
        found = events(tables, kind).select("person_id", "item", *[c.alias(name) for name, c in columns.items()]).join(lists, "item").drop("item")
        out = found if out is None else out.unionByName(found)
    dealt = dealt_out(out, amount, "person_id")
    placed = dealt.select("person_id", *columns, "slots", F.posexplode("instances").alias("at", "instance_id"))
    return placed.select("instance_id", F.col("slots")[F.col("at")].cast("int").alias("slot"), "person_id", *columns)


def _per_person(found: DataFrame) -> DataFrame:
    return found.select("code", "person_id").distinct()


def _per_year(found: DataFrame) -> DataFrame:
    years = found.select("code", "person_id", year_of("start").alias("year")).distinct()
    return years.groupBy("code", "year").agg(F.count("*").alias("number_of_patients"))


def _with_trait(tables: Tables, cohort: Cohort, instances: DataFrame) -> DataFrame:
    """Patients of a concept with a trait: (instance_id, number_of_patients).

    Instances that ask for one concept with different values share the work: patients are counted
    per concept and value, and the instances then look their counts up. Events are dealt out by patient
    once; traits and distinct patients then need no other shuffle, and no task holds more than its patients.
    """
    wanted = instances.select("instance_id", F.col("codes")[0].alias("code"), "value")
    codes = wanted.select("code").distinct().select(F.col("code").alias("instance_id"), F.array("code").alias("codes"))
    found = hits(tables, cohort, codes, lambda rows: rows).withColumnRenamed("instance_id", "code")
    by_patient = lambda *columns: found.select("code", "person_id", *columns).repartition("person_id")
    key = ["code", "value"]
    if cohort.trait in ("year", "year_span", "age"):
        wanted = wanted.withColumn("value", F.col("value").cast("long"))
    if cohort.trait == "year":
        valued = by_patient(year_of("start").alias("value"))
    elif cohort.trait == "year_span":
        # Only wanted years are laid out, so that a far end date does not multiply rows.
        low, high = (wanted.agg(agg("value")).scalar() for agg in (F.min, F.max))
        ended = found.filter(year_of("end").isNotNull())
        spans = ended.select(
            "code", "person_id", F.greatest(year_of("start"), low).alias("low"), F.least(year_of("end"), high).alias("high")
        ).filter(F.col("low") <= F.col("high")).repartition("person_id")
        valued = spans.select("code", "person_id", F.explode(F.sequence("low", "high")).alias("value"))
    elif cohort.trait == "age":
        aged = by_patient(year_of("start").alias("year")).join(tables.person.select("person_id", "year_of_birth"), "person_id")
        valued = aged.select("code", "person_id", (F.col("year") - F.col("year_of_birth")).alias("value"))
    else:
        if cohort.trait == "state":
            at = tables.location.select("location_id", F.upper(F.trim("state")).alias("value"))
            person = tables.person.select("person_id", "location_id").join(
                at.filter("value <> '' AND value <> 'UNKNOWN'"), "location_id"
            )
            wanted = wanted.withColumn("value", F.upper(F.trim("value")))
        else:
            column, domain = _TRAIT_KEYS[cohort.trait]
            find = trait_concepts_with_synonyms if cohort.trait == "race" else trait_concepts
            ids = find(tables, instances, domain).withColumnRenamed("concept_id", "value")
            wanted = wanted.drop("value").join(ids, "instance_id")
            person = tables.person.select("person_id", F.col(column).alias("value"))
        valued = by_patient().join(person.select("person_id", "value"), "person_id")
    counts = valued.select(*key, "person_id").distinct().groupBy(*key).agg(F.count("person_id").alias("n"))
    # A name can stand for several concepts; a patient has one of them, so the counts add up.
    totals = wanted.join(counts, key).groupBy("instance_id").agg(F.sum("n").alias("n"))
    return instances.select("instance_id").join(totals, "instance_id", "left").select(
        "instance_id", F.coalesce("n", F.lit(0)).alias("number_of_patients")
    )


def _of_population(tables: Tables, cohort: Cohort, instances: DataFrame) -> DataFrame:
    """Patients with a demographic value; patients are counted per value once for all instances."""
    key, label = {
        "birth": ("year_of_birth", None),
        "location": ("location_id", tables.location.select(F.col("location_id").alias("key"), F.col("state").alias("value"))),
    }.get(cohort.trait, (None, None))
    if key is None:
        key, domain = _TRAIT_KEYS[cohort.trait]
        label = labels(tables, domain, "value").withColumnRenamed("concept_id", "key")
    counts = tables.person.groupBy(F.col(key).alias("key")).agg(F.count_distinct("person_id").alias("n"))
    valued = counts.withColumn("value", F.col("key").cast("string")) if label is None else counts.join(label, "key")
    totals = valued.groupBy("value").agg(F.sum("n").alias("n"))
    wanted = instances.select("instance_id", F.col("value").cast("string").alias("value"))
    return wanted.join(totals, "value", "left").select(
        "instance_id", F.coalesce("n", F.lit(0)).alias("number_of_patients")
    )


def evaluate(tables: Tables, cohort: Cohort, instances: DataFrame, days: int | None = None) -> DataFrame:
    """Patients of every instance: (instance_id, number_of_patients), or one row per year for by_year.

    ``days`` replaces the period of the cohort.
    """
    days = cohort.days if days is None else days
    size, start = len(cohort.slots), day_number("start")
    if cohort.test == "trait":
        return _of_population(tables, cohort, instances)
    if cohort.trait:
        return _with_trait(tables, cohort, instances)
    if cohort.test == "by_year":
        return hits(tables, cohort, instances, _per_year).select("instance_id", "year", "number_of_patients")
    if cohort.test == "any":
        chosen = persons.having_any(hits(tables, cohort, instances, _per_person))
    elif cohort.test == "all":
        chosen = persons.having_all(hits(tables, cohort, instances, _per_person), size)
    elif cohort.test == "within":
        chosen = persons.having_all_within(hits_by_patient(tables, cohort, instances, {"day": start}), size, days)
    elif cohort.test == "after":
        found = hits_by_patient(tables, cohort, instances, {"first": start, "last": start})
        chosen = persons.having_after(found, cohort.earlier, 1 - cohort.earlier, days, cohort.strict)
    elif cohort.test == "overlap":
        spans = {"first": start, "last": day_number(F.coalesce("end", "start"))}
        chosen = persons.having_short_overlap(hits_by_patient(tables, cohort, instances, spans), size, days)
    else:
        raise ValueError(f"cohort {cohort.id} takes no instances")
    if cohort.known_patients:
        chosen = chosen.join(tables.person.select("person_id"), "person_id", "left_semi")
    return persons.count_persons(instances, chosen)


def report(tables: Tables, cohort: Cohort) -> DataFrame:
    """The table of a cohort without parameters."""
    if cohort.test != "report":
        raise ValueError(f"cohort {cohort.id} needs instances")
    return count_by(tables, cohort.dims, cohort.unknown) if cohort.dims else count_all(tables)


def reports(tables: Tables, wanted: Iterable[str] | None = None) -> DataFrame:
    """All reports with columns from one pass over the patients, as ``count_by_each`` gives them; ``shown`` picks one."""
    chosen = [COHORTS[c] for c in (wanted or COHORTS)]
    return count_by_each(tables, {c.id: c.dims for c in chosen if c.test == "report" and c.dims})


def shown(all_reports: DataFrame, cohort: Cohort) -> DataFrame:
    """One report as ``report`` gives it, out of all."""
    columns = [F.coalesce(d, F.lit(UNKNOWN)).alias(d) if cohort.unknown and d != "year_of_birth" else F.col(d) for d in cohort.dims]
    return all_reports.filter(F.col("report") == cohort.id).select(*columns, "number_of_patients")
