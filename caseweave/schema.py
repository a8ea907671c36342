"""The ten clinical tables the queries read, with their column types."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Hashable, Mapping
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, functions as F

# Table and column names of the common data model.
TABLES: dict[str, str] = {
    "concept": "concept_id long, concept_name string, concept_code string, vocabulary_id string, "
    "domain_id string, standard_concept string, invalid_reason string",
    "concept_relationship": "concept_id_1 long, concept_id_2 long, relationship_id string, invalid_reason string",
    "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long",
    "concept_synonym": "concept_id long, concept_synonym_name string",
    "person": "person_id long, year_of_birth long, gender_concept_id long, race_concept_id long, "
    "ethnicity_concept_id long, location_id long",
    "location": "location_id long, state string",
    "condition_occurrence": "person_id long, condition_concept_id long, condition_start_date date",
    "drug_exposure": "drug_exposure_id long, person_id long, drug_concept_id long, "
    "drug_exposure_start_date date, drug_exposure_end_date date",
    "drug_era": "person_id long, drug_concept_id long, drug_era_start_date date, drug_era_end_date date",
    "condition_era": "person_id long, condition_concept_id long, condition_era_start_date date, "
    "condition_era_end_date date",
}


def columns(table: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a clinical table."""
    return [tuple(field.split()) for field in TABLES[table].split(", ")]


def conform(table: str, df: DataFrame) -> DataFrame:
    """Pick and cast the columns a table must have; fail early when one is missing.

    Timestamps become dates here, so that every later day difference is a whole number.
    """
    have = {c.lower(): c for c in df.columns}
    missing = [name for name, _ in columns(table) if name not in have]
    if missing:
        raise ValueError(f"table {table} lacks columns: {', '.join(missing)}")
    return df.select([F.col(have[name]).cast(kind).alias(name) for name, kind in columns(table)])


@dataclass(frozen=True)
class Tables:
    """The clinical tables as DataFrames, all lazy."""

    concept: DataFrame
    concept_relationship: DataFrame
    concept_ancestor: DataFrame
    concept_synonym: DataFrame
    person: DataFrame
    location: DataFrame
    condition_occurrence: DataFrame
    drug_exposure: DataFrame
    drug_era: DataFrame
    condition_era: DataFrame

    @classmethod
    def of(cls, frames: Mapping[str, DataFrame]) -> "Tables":
        absent = [name for name in TABLES if name not in frames]
        if absent:
            raise ValueError(f"missing tables: {', '.join(absent)}")
        return cls(**{name: conform(name, frames[name]) for name in TABLES})

    @property
    def spark(self):
        return self.concept.sparkSession

    def once(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several steps of one job may read; unless tables are ``Shared``, each step makes its own."""
        return make()

    def register_views(self) -> None:
        """Make the tables visible to ``spark.sql`` under their own names."""
        for name in TABLES:
            getattr(self, name).createOrReplaceTempView(name)


class Shared(Tables):
    """The same tables for a job of many steps, that makes what several of them read once."""

    def __init__(self, tables: Tables):
        self.__dict__.update(_tables=tables, _locks=defaultdict(Lock), _made={}, _lock=Lock())

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return getattr(self._tables, name)

    def once(self, key: Hashable, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            own = self._locks[key]
        with own:  # steps run in several threads
            if key not in self._made:
                self._made[key] = make()
            return self._made[key]
