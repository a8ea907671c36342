"""Patients counted by demographic columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from caseweave.operators.concepts import labels
from caseweave.schema import Tables

UNKNOWN = "Unknown"
_CONCEPTS = {
    "gender": ("gender_concept_id", "Gender"),
    "race": ("race_concept_id", "Race"),
    "ethnicity": ("ethnicity_concept_id", "Ethnicity"),
}


def count_by(tables: Tables, dims: Sequence[str], unknown: bool = True) -> DataFrame:
    """Patients per combination of gender, race, ethnicity, state and year_of_birth.

    Patients are first counted per id, so that labels meet a few id rows and not every patient.
    Groups follow the raw label; a missing one is shown as 'Unknown' (or left null).
    """
    keys = {d: _CONCEPTS[d][0] if d in _CONCEPTS else {"state": "location_id"}.get(d, d) for d in dims}
    counts = tables.person.groupBy(*keys.values()).agg(F.count_distinct("person_id").alias("n"))
    for dim, key in keys.items():
        if dim in _CONCEPTS:
            label = labels(tables, _CONCEPTS[dim][1], dim).withColumnRenamed("concept_id", key)
            counts = counts.join(label, key, "left")
        elif dim == "state":
            counts = counts.join(tables.location, key, "left")
    grouped = counts.groupBy(*dims).agg(F.sum("n").alias("number_of_patients"))
    shown = [F.coalesce(d, F.lit(UNKNOWN)).alias(d) if unknown and d != "year_of_birth" else F.col(d) for d in dims]
    return grouped.select(*shown, "number_of_patients")


def count_by_each(tables: Tables, reports: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several reports of ``count_by`` in one pass: (report, one column per demographic, number_of_patients).

    Patients are counted once per combination of ids; labels join that, and one aggregation by grouping
    sets makes every report from it. A column that a report does not group by is null there. A patient
    is a row of ``person``.
    """
    dims = [*_CONCEPTS, "state", "year_of_birth"]
    keys = [key for key, _ in _CONCEPTS.values()]
    counts = tables.person.groupBy(*keys, "location_id", "year_of_birth").agg(F.count_distinct("person_id").alias("n"))
    for dim, (key, domain) in _CONCEPTS.items():
        counts = counts.join(labels(tables, domain, dim).withColumnRenamed("concept_id", key), key, "left")
    counts = counts.join(tables.location, "location_id", "left").select(*dims, "n")
    sets = [[F.col(d) for d in dims if d in wanted] for wanted in reports.values()]
    grouped = counts.groupingSets(sets, *dims).agg(F.sum("n").alias("number_of_patients"), F.grouping_id().alias("made_by"))
    made_by = lambda wanted: sum(1 << (len(dims) - 1 - n) for n, d in enumerate(dims) if d not in wanted)
    of_set = {made_by(wanted): report for report, wanted in reports.items()}
    if len(of_set) < len(reports):
        raise ValueError("two reports have the same columns")
    name = F.create_map(*[F.lit(x) for pair in of_set.items() for x in pair])[F.col("made_by").cast("int")]
    return grouped.select(name.alias("report"), *dims, "number_of_patients")


def count_all(tables: Tables) -> DataFrame:
    return tables.person.agg(F.count_distinct("person_id").alias("number_of_patients"))
