"""The SQL text of a criterion, as the answer key of a dataset item.

The text is Spark SQL over the clinical tables and gives the same number as ``evaluate``. It is
for reading and for checking other systems; this package does not run it to get its results.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseweave.functions.text import sql_literal
from caseweave.plans.cohorts import Cohort

_EVENTS = {
    "drug": ("drug_exposure", "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date"),
    "condition": ("condition_occurrence", "condition_concept_id", "condition_start_date", "CAST(NULL AS DATE)"),
}
_DIMS = {
    "gender": ("gender.concept_name", "gender_concept_id", "Gender"),
    "race": ("race.concept_name", "race_concept_id", "Race"),
    "ethnicity": ("ethnicity.concept_name", "ethnicity_concept_id", "Ethnicity"),
    "state": ("location.state", None, None),
    "year_of_birth": ("person.year_of_birth", None, None),
}


def _mapped(vocabulary: str, code: str, checked: bool) -> str:
    source = f"FROM concept src {{join}} WHERE src.vocabulary_id = {vocabulary} AND src.concept_code = {code}"
    link = "concept_relationship rel ON rel.concept_id_1 = src.concept_id AND rel.relationship_id = 'Maps to'"
    if checked:
        text = f"SELECT COALESCE(rel.concept_id_2, src.concept_id) AS concept_id {source} AND src.invalid_reason IS NULL"
        return text.format(join=f"LEFT JOIN {link} AND rel.invalid_reason IS NULL")
    return f"SELECT rel.concept_id_2 AS concept_id {source}".format(join=f"JOIN {link}")


def _concept_set(variant: str, vocabulary: str, code: str) -> str:
    mapped = _mapped(vocabulary, code, variant.startswith("map_coalesce"))
    if variant == "map_only":
        return mapped
    if variant == "map_inner":
        mapped = f"SELECT concept_id FROM concept WHERE concept_id IN ({mapped})"
    below = (
        f"SELECT descendant_concept_id AS concept_id FROM concept_ancestor WHERE ancestor_concept_id IN ({mapped})"
    )
    if variant == "map_coalesce_self":
        below = f"{mapped} UNION {below}"
    if variant in ("map_coalesce_valid", "map_coalesce_self"):
        valid = "domain_id = 'Condition' AND standard_concept = 'S' AND invalid_reason IS NULL"
        return f"SELECT concept_id FROM concept WHERE {valid} AND concept_id IN ({below})"
    return below


def _hit(n: int, kind: str, variant: str, vocabulary: str, code: str) -> str:
    table, item, start, end = _EVENTS[kind]
    return (
        f"hit{n} AS (SELECT person_id, {start} AS start_date, {end} AS end_date FROM {table} "
        f"WHERE {item} IN ({_concept_set(variant, vocabulary, code)}))"
    )


def _named(domain: str, value: str) -> str:
    return f"SELECT concept_id FROM concept WHERE domain_id = '{domain}' AND standard_concept = 'S' AND concept_name = {value}"


def _trait(trait: str, value: str) -> str:
    if trait == "year":
        return f"WHERE YEAR(hit0.start_date) = {value}"
    if trait == "year_span":
        return f"WHERE YEAR(hit0.start_date) <= {value} AND YEAR(hit0.end_date) >= {value}"
    person = "JOIN person ON person.person_id = hit0.person_id"
    if trait == "age":
        return f"{person} WHERE YEAR(hit0.start_date) - person.year_of_birth = {value}"
    if trait == "state":
        return (
            f"{person} JOIN location ON location.location_id = person.location_id WHERE UPPER(TRIM(location.state)) NOT IN ('', 'UNKNOWN') "
            f"AND UPPER(TRIM(location.state)) = UPPER(TRIM({value}))"
        )
    if trait == "race":
        by_synonym = f"SELECT concept_id FROM concept_synonym WHERE LOWER(concept_synonym_name) = LOWER({value})"
        return (
            f"{person} WHERE person.race_concept_id IN (SELECT concept_id FROM concept WHERE domain_id = 'Race' AND standard_concept = 'S' "
            f"AND invalid_reason IS NULL AND (LOWER(concept_name) = LOWER({value}) OR concept_id IN ({by_synonym})))"
        )
    return f"{person} WHERE person.{trait}_concept_id IN ({_named(trait.capitalize(), value)})"


def _population(trait: str, value: str) -> str:
    if trait == "birth":
        return f"WHERE year_of_birth = {value}"
    if trait == "location":
        return f"WHERE location_id IN (SELECT location_id FROM location WHERE state = {value})"
    return f"WHERE {trait}_concept_id IN ({_named(trait.capitalize(), value)})"


def report_sql(cohort: Cohort) -> str:
    if not cohort.dims:
        return "SELECT COUNT(DISTINCT person_id) AS number_of_patients FROM person"
    shown, joins = [], []
    for dim in cohort.dims:
        label, key, domain = _DIMS[dim]
        raw = dim == "year_of_birth" or not cohort.unknown
        shown.append(f"{label} AS {dim}" if raw else f"COALESCE({label}, 'Unknown') AS {dim}")
        if key:
            joins.append(
                f"LEFT JOIN concept {dim} ON {dim}.concept_id = person.{key} AND {dim}.domain_id = '{domain}' AND {dim}.standard_concept = 'S'"
            )
        elif dim == "state":
            joins.append("LEFT JOIN location ON location.location_id = person.location_id")
    groups = ", ".join(_DIMS[dim][0] for dim in cohort.dims)
    return squeeze_text(
        f"SELECT {', '.join(shown)}, COUNT(DISTINCT person.person_id) AS number_of_patients FROM person {' '.join(joins)} GROUP BY {groups}"
    )


def squeeze_text(text: str) -> str:
    return " ".join(text.split())


def criterion_pattern(cohort: Cohort, days: int) -> str:
    """The text with %n$s in place of: vocabulary and code of each slot, then the value."""
    size = len(cohort.slots)
    value = f"%{2 * size + 1}$s"
    if cohort.test == "trait":
        return f"SELECT COUNT(DISTINCT person_id) AS number_of_patients FROM person {_population(cohort.trait, value)}"
    parts = [_hit(n, kind, variant, f"%{2 * n + 1}$s", f"%{2 * n + 2}$s") for n, (kind, variant) in enumerate(cohort.slots)]
    count = "COUNT(DISTINCT hit0.person_id) AS number_of_patients"
    chain = "hit0" + "".join(f" JOIN hit{n} ON hit{n}.person_id = hit0.person_id" for n in range(1, size))
    starts = ", ".join(f"hit{n}.start_date" for n in range(size))
    if cohort.trait:
        body = f"SELECT {count} FROM hit0 {_trait(cohort.trait, value)}"
    elif cohort.test == "by_year":
        body = f"SELECT YEAR(start_date) AS year, {count} FROM hit0 GROUP BY YEAR(start_date)"
    elif cohort.test == "all":
        body = f"SELECT {count} FROM {chain}"
    elif cohort.test == "any" and size == 1:
        known = " JOIN person ON person.person_id = hit0.person_id" if cohort.known_patients else ""
        body = f"SELECT {count} FROM hit0{known}"
    elif cohort.test == "any":
        either = " UNION ".join(f"SELECT person_id FROM hit{n}" for n in range(size))
        body = f"SELECT COUNT(DISTINCT person_id) AS number_of_patients FROM ({either}) AS either_one"
    elif cohort.test == "within":
        present = " AND ".join(f"hit{n}.start_date IS NOT NULL" for n in range(size))
        body = f"SELECT {count} FROM {chain} WHERE {present} AND DATEDIFF(GREATEST({starts}), LEAST({starts})) <= {days}"
    elif cohort.test == "after":
        first, last = cohort.earlier, 1 - cohort.earlier
        sign = ">" if cohort.strict else ">="
        body = f"SELECT {count} FROM {chain} WHERE DATEDIFF(hit{last}.start_date, hit{first}.start_date) {sign} {days}"
    else:
        ends = [f"COALESCE(hit{n}.end_date, hit{n}.start_date)" for n in range(size)]
        meet = " AND ".join(
            f"hit{n}.start_date <= {ends[m]} AND {ends[n]} >= hit{m}.start_date" for n in range(1, size) for m in range(n)
        )
        period = f"DATEDIFF(LEAST({', '.join(ends)}), GREATEST({starts}))"
        body = f"SELECT {count} FROM {chain} WHERE {meet} AND {period} BETWEEN 0 AND {days}"
    return f"WITH {', '.join(parts)} {body}"


def criterion_sql(cohort: Cohort, days: int) -> Column:
    """SQL text per instance, from its ``codes`` and ``value`` columns, in one line."""
    arguments = []
    for n in range(len(cohort.slots)):
        arguments += [sql_literal(F.col("codes")[n]["vocabulary_id"]), sql_literal(F.col("codes")[n]["concept_code"])]
    if cohort.trait in ("year", "year_span", "age", "birth"):
        arguments.append(F.col("value").cast("string"))
    elif cohort.trait:
        arguments.append(sql_literal("value"))
    return F.format_string(squeeze_text(criterion_pattern(cohort, days)), *arguments)
