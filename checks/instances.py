"""Instances for the registered cohort queries, derived from the tables: every concept takes part.

The same instances are defined for Spark (DataFrames) and for DuckDB (SQL text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseweave.functions.dates import year_of
from caseweave.plans.cohorts import Cohort
from caseweave.schema import Tables
from caseweave.sources.readers import events

# An instance of a concept and a value is numbered concept id * SCALE + value id.
SCALE = 100_000_000


def _code(alias: str):
    return F.struct(F.col(f"{alias}.vocabulary_id").alias("vocabulary_id"), F.col(f"{alias}.concept_code").alias("concept_code"))


def chains(tables: Tables, domain: str, size: int) -> DataFrame:
    """One instance per concept: the concept and its size - 1 successors by id in the same vocabulary."""
    concepts = tables.concept.filter(F.col("domain_id") == domain)
    out = concepts.alias("c0")
    for n in range(1, size):
        same = (F.col(f"c{n}.concept_id") == F.col("c0.concept_id") + n) & (
            F.col(f"c{n}.vocabulary_id") == F.col("c0.vocabulary_id")
        )
        out = out.join(concepts.alias(f"c{n}"), same)
    return out.select(F.col("c0.concept_id").alias("instance_id"), F.array(*[_code(f"c{n}") for n in range(size)]).alias("codes"))


def condition_drug(tables: Tables) -> DataFrame:
    """Every drug concept with one recorded condition, and every condition concept with one recorded drug.

    The partner is found by the remainder of the concept id, so all concepts of both domains take part.
    """

    def partners(domain: str, base: int, partner: str, vocabulary: str) -> DataFrame:
        count = tables.concept.filter(F.col("vocabulary_id") == vocabulary).filter(F.col("concept_id") < base + 1_000_000)
        size = count.agg(F.count("*")).scalar()
        mine = tables.concept.filter(F.col("domain_id") == domain)
        return mine.select(F.col("concept_id").alias(domain), (base + F.col("concept_id") % size).alias(partner))

    by_drug = partners("Drug", 4_000_000, "Condition", "SNOMED")
    by_condition = partners("Condition", 1_000_000, "Drug", "RxNorm")
    pairs = by_drug.unionByName(by_condition).distinct()
    c, d = tables.concept.alias("c"), tables.concept.alias("d")
    return (
        pairs.alias("p")
        .join(c, F.col("c.concept_id") == F.col("p.Condition"))
        .join(d, F.col("d.concept_id") == F.col("p.Drug"))
        .select((F.col("c.concept_id") * SCALE + F.col("d.concept_id")).alias("instance_id"), F.array(_code("c"), _code("d")).alias("codes"))
    )


def _above(tables: Tables, kind: str) -> DataFrame:
    """Events under each concept they belong to: (person_id, concept_id, start)."""
    rows = events(tables, kind)
    return rows.join(tables.concept_ancestor, F.col("item") == F.col("descendant_concept_id")).select(
        "person_id", F.col("ancestor_concept_id").alias("concept_id"), "start"
    )


def with_value(tables: Tables, cohort: Cohort) -> DataFrame:
    """Every concept with every value seen in its patients."""
    kind = cohort.slots[0][0]
    rows = _above(tables, kind)
    person = tables.person
    if cohort.trait in ("year", "year_span"):
        seen = rows.select("concept_id", year_of("start").alias("value_id")).distinct().withColumn("value", F.col("value_id"))
    elif cohort.trait == "age":
        seen = (
            rows.join(person, "person_id")
            .select("concept_id", (year_of("start") - F.col("year_of_birth") + 1000).alias("value_id"))
            .distinct()
            .withColumn("value", F.col("value_id") - 1000)
        )
    elif cohort.trait == "state":
        seen = rows.join(person, "person_id").select("concept_id", F.col("location_id").alias("value_id")).distinct()
        places = tables.location.select(F.col("location_id").alias("value_id"), F.concat(F.lit("  "), F.lower("state"), F.lit(" ")).alias("value"))
        seen = seen.join(places.filter("value IS NOT NULL"), "value_id")
    else:
        key = f"{cohort.trait}_concept_id"
        seen = rows.join(person, "person_id").select("concept_id", F.col(key).alias("value_id")).distinct()
        name = tables.concept.select(F.col("concept_id").alias("value_id"), F.col("concept_name").alias("value"))
        seen = seen.join(name, "value_id")
        if cohort.trait == "race":  # half of them by synonym, the others in lower case
            other = tables.concept_synonym.select(F.col("concept_id").alias("value_id"), F.upper("concept_synonym_name").alias("other"))
            seen = seen.join(other, "value_id").withColumn(
                "value", F.when(F.col("concept_id") % 2 == 0, F.lower("value")).otherwise(F.col("other"))
            )
    return (
        seen.alias("s")
        .join(tables.concept.alias("c"), F.col("c.concept_id") == F.col("s.concept_id"))
        .select(
            (F.col("s.concept_id") * SCALE + F.col("s.value_id")).alias("instance_id"),
            F.array(_code("c")).alias("codes"),
            F.col("s.value").cast("string").alias("value"),
        )
    )


def values_only(tables: Tables, cohort: Cohort) -> DataFrame:
    if cohort.trait == "birth":
        years = tables.person.select("year_of_birth").distinct()
        return years.select(F.col("year_of_birth").alias("instance_id"), F.col("year_of_birth").cast("string").alias("value"))
    if cohort.trait == "location":
        return tables.location.filter("state IS NOT NULL").select(F.col("location_id").alias("instance_id"), F.col("state").alias("value"))
    domain = cohort.trait.capitalize()
    return tables.concept.filter(F.col("domain_id") == domain).select(
        F.col("concept_id").alias("instance_id"), F.col("concept_name").alias("value")
    )


def instances_for(tables: Tables, cohort: Cohort) -> DataFrame:
    kinds = {kind for kind, _ in cohort.slots}
    if not cohort.slots:
        return values_only(tables, cohort)
    if cohort.trait:
        return with_value(tables, cohort)
    if len(kinds) == 2:
        return condition_drug(tables)
    return chains(tables, kinds.pop().capitalize(), len(cohort.slots))


# --- DuckDB ---------------------------------------------------------------------------------------


def _slots_of_chains(domain: str, size: int) -> str:
    joins = " ".join(
        f"JOIN concept c{n} ON c{n}.concept_id = c0.concept_id + {n} AND c{n}.vocabulary_id = c0.vocabulary_id" for n in range(1, size)
    )
    rows = " UNION ALL ".join(
        f"SELECT c0.concept_id AS instance_id, {n} AS slot, c{n}.vocabulary_id AS v, c{n}.concept_code AS c "
        f"FROM concept c0 {joins} WHERE c0.domain_id = '{domain}'"
        for n in range(size)
    )
    return f"slots AS ({rows}), inst AS (SELECT DISTINCT instance_id FROM slots)"


_ABOVE = {
    "condition": "SELECT person_id, ancestor_concept_id AS concept_id, condition_start_date AS s FROM condition_occurrence "
    "JOIN concept_ancestor ON descendant_concept_id = condition_concept_id",
    "drug": "SELECT person_id, ancestor_concept_id AS concept_id, drug_exposure_start_date AS s FROM drug_exposure "
    "JOIN concept_ancestor ON descendant_concept_id = drug_concept_id",
}


def _slots_condition_drug() -> str:
    return (
        "pairs AS (SELECT 4000000 + concept_id % (SELECT COUNT(*) FROM supplier) AS c, concept_id AS d FROM concept WHERE domain_id = 'Drug' "
        "UNION SELECT concept_id, 1000000 + concept_id % (SELECT COUNT(*) FROM part) FROM concept WHERE domain_id = 'Condition'), "
        f"slots AS (SELECT c * {SCALE} + d AS instance_id, 0 AS slot, k.vocabulary_id AS v, k.concept_code AS c FROM pairs "
        "JOIN concept k ON k.concept_id = pairs.c "
        f"UNION ALL SELECT c * {SCALE} + d, 1, k.vocabulary_id, k.concept_code FROM pairs JOIN concept k ON k.concept_id = pairs.d), "
        "inst AS (SELECT DISTINCT instance_id FROM slots)"
    )


def _slots_with_value(cohort: Cohort) -> str:
    above = _ABOVE[cohort.slots[0][0]]
    if cohort.trait in ("year", "year_span"):
        seen = f"SELECT DISTINCT concept_id, EXTRACT(YEAR FROM s) AS value_id, EXTRACT(YEAR FROM s) AS value FROM ({above}) a"
    elif cohort.trait == "age":
        age = "EXTRACT(YEAR FROM s) - year_of_birth"
        seen = f"SELECT DISTINCT concept_id, {age} + 1000 AS value_id, {age} AS value FROM ({above}) a JOIN person USING (person_id)"
    elif cohort.trait == "state":
        seen = (
            f"SELECT DISTINCT concept_id, l.location_id AS value_id, '  ' || lower(state) || ' ' AS value FROM ({above}) a "
            "JOIN person USING (person_id) JOIN location l USING (location_id) WHERE state IS NOT NULL"
        )
    else:
        value = "k.concept_name"
        join = ""
        if cohort.trait == "race":
            value = "CASE WHEN a.concept_id % 2 = 0 THEN lower(k.concept_name) ELSE upper(y.concept_synonym_name) END"
            join = "JOIN concept_synonym y ON y.concept_id = k.concept_id"
        seen = (
            f"SELECT DISTINCT a.concept_id, k.concept_id AS value_id, {value} AS value FROM ({above}) a "
            f"JOIN person USING (person_id) JOIN concept k ON k.concept_id = person.{cohort.trait}_concept_id {join}"
        )
    return (
        f"seen AS ({seen}), "
        f"inst AS (SELECT concept_id * {SCALE} + value_id AS instance_id, value FROM seen), "
        f"slots AS (SELECT seen.concept_id * {SCALE} + value_id AS instance_id, 0 AS slot, k.vocabulary_id AS v, k.concept_code AS c "
        "FROM seen JOIN concept k ON k.concept_id = seen.concept_id)"
    )


_SETS = {
    "map_inner": "SELECT DISTINCT instance_id, slot, ca.descendant_concept_id AS concept_id FROM slots "
    "JOIN concept src ON src.vocabulary_id = v AND src.concept_code = c "
    "JOIN concept_relationship cr ON cr.concept_id_1 = src.concept_id AND cr.relationship_id = 'Maps to' "
    "JOIN concept tgt ON tgt.concept_id = cr.concept_id_2 JOIN concept_ancestor ca ON ca.ancestor_concept_id = tgt.concept_id",
    "map_only": "SELECT DISTINCT instance_id, slot, cr.concept_id_2 AS concept_id FROM slots "
    "JOIN concept src ON src.vocabulary_id = v AND src.concept_code = c "
    "JOIN concept_relationship cr ON cr.concept_id_1 = src.concept_id AND cr.relationship_id = 'Maps to'",
}
_STD = (
    "SELECT instance_id, slot, COALESCE(cr.concept_id_2, src.concept_id) AS concept_id FROM slots "
    "JOIN concept src ON src.vocabulary_id = v AND src.concept_code = c AND src.invalid_reason IS NULL "
    "LEFT JOIN concept_relationship cr ON cr.concept_id_1 = src.concept_id AND cr.relationship_id = 'Maps to' AND cr.invalid_reason IS NULL"
)
_BELOW = f"SELECT instance_id, slot, ca.descendant_concept_id AS concept_id FROM ({_STD}) m JOIN concept_ancestor ca ON ca.ancestor_concept_id = m.concept_id"
_SETS["map_coalesce_raw"] = _BELOW
_SETS["map_coalesce_valid"] = f"SELECT DISTINCT b.* FROM ({_BELOW}) b WHERE concept_id IN (SELECT concept_id FROM vc)"
_SETS["map_coalesce_self"] = f"SELECT * FROM ({_STD} UNION {_BELOW}) b WHERE concept_id IN (SELECT concept_id FROM vc)"

_EVENTS = {
    "condition": "SELECT person_id AS p, condition_concept_id AS i, condition_start_date AS s, CAST(NULL AS DATE) AS f FROM condition_occurrence",
    "drug": "SELECT person_id AS p, drug_concept_id AS i, drug_exposure_start_date AS s, drug_exposure_end_date AS f FROM drug_exposure",
}


def concept_set_sql(variant: str) -> str:
    return _SETS[variant]


def slots_sql(cohort: Cohort) -> str:
    kinds = {kind for kind, _ in cohort.slots}
    if cohort.trait:
        return _slots_with_value(cohort)
    if len(kinds) == 2:
        return _slots_condition_drug()
    return _slots_of_chains(kinds.pop().capitalize(), len(cohort.slots))


def hits_sql(cohort: Cohort, given: str | None = None) -> str:
    """CTEs up to h(instance_id, slot, p, s, f); ``given`` replaces the registered slots and inst."""
    parts = []
    for n, (kind, variant) in enumerate(dict.fromkeys(cohort.slots)):
        mine = ", ".join(str(j) for j, slot in enumerate(cohort.slots) if slot == (kind, variant))
        parts.append(
            f"SELECT cs.instance_id, cs.slot, e.p, e.s, e.f FROM ({_SETS[variant]}) cs JOIN ({_EVENTS[kind]}) e "
            f"ON e.i = cs.concept_id WHERE cs.slot IN ({mine})"
        )
    return f"{given or slots_sql(cohort)}, h AS ({' UNION ALL '.join(parts)})"
