"""DuckDB counterparts of the cohort queries: one self-join per concept, as the criteria are worded."""

from __future__ import annotations

from checks.discovery_sql import with_star
from checks.instances import hits_sql
from caseweave.plans.cohorts import COHORTS, Cohort

_LABELS = {
    "gender": ("g.concept_name", "LEFT JOIN concept g ON g.concept_id = gender_concept_id AND g.domain_id = 'Gender' AND g.standard_concept = 'S'"),
    "race": ("r.concept_name", "LEFT JOIN concept r ON r.concept_id = race_concept_id AND r.domain_id = 'Race' AND r.standard_concept = 'S'"),
    "ethnicity": ("e.concept_name", "LEFT JOIN concept e ON e.concept_id = ethnicity_concept_id AND e.domain_id = 'Ethnicity' AND e.standard_concept = 'S'"),
    "state": ("l.state", "LEFT JOIN location l ON l.location_id = person.location_id"),
    "year_of_birth": ("year_of_birth", ""),
}


def _report(cohort: Cohort) -> str:
    if not cohort.dims:
        return with_star("SELECT COUNT(DISTINCT person_id) AS number_of_patients FROM person")
    shown = []
    for dim in cohort.dims:
        column = _LABELS[dim][0]
        plain = dim == "year_of_birth" or not cohort.unknown
        shown.append(f"{column} AS {dim}" if plain else f"COALESCE({column}, 'Unknown') AS {dim}")
    joins = " ".join(_LABELS[dim][1] for dim in cohort.dims)
    groups = ", ".join(_LABELS[dim][0] for dim in cohort.dims)
    return with_star(
        f"SELECT {', '.join(shown)}, COUNT(DISTINCT person_id) AS number_of_patients FROM person {joins} GROUP BY {groups}"
    )


def _population(cohort: Cohort) -> str:
    if cohort.trait == "birth":
        body = (
            "SELECT i.y AS instance_id, COUNT(DISTINCT person_id) AS number_of_patients "
            "FROM (SELECT DISTINCT year_of_birth AS y FROM person) i LEFT JOIN person ON year_of_birth = i.y GROUP BY 1"
        )
    elif cohort.trait == "location":
        body = (
            "SELECT CAST(i.location_id AS BIGINT) AS instance_id, COUNT(DISTINCT person_id) AS number_of_patients FROM location i "
            "LEFT JOIN (location l JOIN person ON person.location_id = l.location_id) ON l.state = i.state WHERE i.state IS NOT NULL GROUP BY 1"
        )
    else:
        domain = cohort.trait.capitalize()
        body = (
            "SELECT i.concept_id AS instance_id, COUNT(DISTINCT person_id) AS number_of_patients FROM concept i "
            f"LEFT JOIN concept k ON k.concept_name = i.concept_name AND k.domain_id = '{domain}' AND k.standard_concept = 'S' "
            f"LEFT JOIN person ON {cohort.trait}_concept_id = k.concept_id WHERE i.domain_id = '{domain}' GROUP BY 1"
        )
    return with_star(body)


def _trait(trait: str) -> str:
    """FROM clause after ``h JOIN inst``, with the test."""
    person = "JOIN person ON person.person_id = h1.p"
    if trait == "year":
        return "WHERE EXTRACT(YEAR FROM h1.s) = inst.value"
    if trait == "year_span":
        return "WHERE EXTRACT(YEAR FROM h1.s) <= inst.value AND EXTRACT(YEAR FROM h1.f) >= inst.value"
    if trait == "age":
        return f"{person} WHERE EXTRACT(YEAR FROM h1.s) - year_of_birth = inst.value"
    if trait == "state":
        return (
            f"{person} JOIN location l ON l.location_id = person.location_id WHERE TRIM(l.state) <> '' "
            "AND UPPER(TRIM(l.state)) <> 'UNKNOWN' AND UPPER(TRIM(l.state)) = UPPER(TRIM(inst.value))"
        )
    if trait == "race":
        return (
            f"{person} JOIN concept k ON k.concept_id = race_concept_id AND k.domain_id = 'Race' AND k.standard_concept = 'S' "
            "AND k.invalid_reason IS NULL WHERE lower(k.concept_name) = lower(inst.value) OR EXISTS (SELECT 1 FROM concept_synonym y "
            "WHERE y.concept_id = k.concept_id AND lower(y.concept_synonym_name) = lower(inst.value))"
        )
    return (
        f"{person} JOIN concept k ON k.concept_id = {trait}_concept_id AND k.domain_id = '{trait.capitalize()}' "
        "AND k.standard_concept = 'S' WHERE k.concept_name = inst.value"
    )


def _criterion(cohort: Cohort, given: str | None = None) -> str:
    """SQL of a criterion over its registered instances, or over ``given`` CTEs for slots and inst."""
    prefix = hits_sql(cohort, given)
    size = len(cohort.slots)
    starts = ", ".join(f"h{n}.s" for n in range(1, size + 1))
    span = f"GREATEST({starts}) - LEAST({starts})" if size > 1 else "0"
    chain = "h h1 " + " ".join(
        f"JOIN h h{n} ON h{n}.instance_id = h1.instance_id AND h{n}.p = h1.p AND h{n}.slot = {n - 1}" for n in range(2, size + 1)
    )
    pre = ""
    if cohort.trait:
        rows = f"SELECT h1.instance_id, h1.p FROM h h1 JOIN inst ON inst.instance_id = h1.instance_id {_trait(cohort.trait)}"
    elif cohort.test == "by_year":
        return with_star(
            "SELECT CAST(instance_id AS BIGINT) AS instance_id, EXTRACT(YEAR FROM s) AS year, "
            "COUNT(DISTINCT p) AS number_of_patients FROM h GROUP BY 1, 2",
            prefix,
        )
    elif cohort.test == "any":
        rows = "SELECT instance_id, p FROM h" + (" JOIN person ON person_id = p" if cohort.known_patients else "")
    elif cohort.test == "all":
        pre = ", hp AS (SELECT DISTINCT instance_id, slot, p FROM h)"
        rows = f"SELECT h1.instance_id, h1.p FROM {chain.replace('h h', 'hp h')} WHERE h1.slot = 0"
    elif cohort.test == "within":
        pre = ", hp AS (SELECT DISTINCT instance_id, slot, p, s FROM h)"
        rows = f"SELECT h1.instance_id, h1.p FROM {chain.replace('h h', 'hp h')} WHERE h1.slot = 0 AND {span} <= {cohort.days}"
    elif cohort.test == "after":
        first, last = (f"h{cohort.earlier + 1}.s", f"h{2 - cohort.earlier}.s")
        rows = f"SELECT h1.instance_id, h1.p FROM {chain} WHERE h1.slot = 0 AND {last} - {first} {'>' if cohort.strict else '>='} {cohort.days}"
    else:
        pre = ", hp AS (SELECT DISTINCT instance_id, slot, p, s, COALESCE(f, s) AS f FROM h)"
        ends = ", ".join(f"h{n}.f" for n in range(1, size + 1))
        pairs = " AND ".join(f"h{n}.s <= h{m}.f AND h{n}.f >= h{m}.s" for n in range(2, size + 1) for m in range(1, n))
        rows = (
            f"SELECT h1.instance_id, h1.p FROM {chain.replace('h h', 'hp h')} WHERE h1.slot = 0 AND {pairs} "
            f"AND LEAST({ends}) - GREATEST({starts}) BETWEEN 0 AND {cohort.days}"
        )
    return with_star(
        "SELECT CAST(inst.instance_id AS BIGINT) AS instance_id, COUNT(DISTINCT found.p) AS number_of_patients "
        "FROM inst LEFT JOIN found ON found.instance_id = inst.instance_id GROUP BY 1",
        f"{prefix}{pre}, found AS ({rows})",
    )


def cohort_sql() -> dict[str, str]:
    out = {}
    for cohort in COHORTS.values():
        if cohort.test == "report":
            out[cohort.id] = _report(cohort)
        elif cohort.test == "trait":
            out[cohort.id] = _population(cohort)
        else:
            out[cohort.id] = _criterion(cohort)
    return out
