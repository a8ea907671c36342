"""Every registered query and its DuckDB counterpart, under one name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseweave.plans.cohorts import COHORTS, Cohort, evaluate, report
from caseweave.plans import discovery
from caseweave.plans.discovery import DISCOVERIES
from checks import extra
from checks.cohort_sql import cohort_sql
from checks.discovery_sql import HEAD_SQL, discovery_sql
from checks.instances import instances_for
from checks.starviews import star_tables


def _discovery(function: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = function(star_tables(spark, sf_dir))
        dates = [name for name, kind in out.dtypes if kind == "date"]
        return out.withColumns({name: F.col(name).cast("string") for name in dates})

    return run


def _cohort(cohort: Cohort) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = star_tables(spark, sf_dir)
        if cohort.test == "report":
            return report(tables, cohort)
        return evaluate(tables, cohort, instances_for(tables, cohort))

    return run


def _named(ids: dict[str, str]) -> dict[str, str]:
    return {key: f"{key}_{name}" for key, name in ids.items()}


NAMES = _named({key: function.__name__ for key, function in DISCOVERIES.items()}) | _named(
    {key: cohort.name for key, cohort in COHORTS.items()}
)


#: Discovery among the most common items only.
HEADS = {
    "Q0005_drug_quads_overlapping_in_top_50": partial(discovery.drug_quads_overlapping_in_head, head=50),
    "Q0006_drug_quads_in_top_500": partial(discovery.drug_quads_in_head, head=500),
    "Q0028_top_20_drugs_of_each_year": partial(discovery.drugs_of_each_year, k=None, head=20),
    "Q0039_top_20_conditions_of_each_year": partial(discovery.conditions_of_each_year, k=None, head=20),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {NAMES[key]: _discovery(function) for key, function in DISCOVERIES.items()}
    out |= {name: _discovery(function) for name, function in HEADS.items()}
    out |= {NAMES[key]: _cohort(cohort) for key, cohort in COHORTS.items()}
    return out | extra.queries()


def oracle_sql() -> dict[str, str]:
    return {NAMES[key]: sql for key, sql in (discovery_sql() | cohort_sql()).items()} | {name: sql() for name, sql in HEAD_SQL.items()} | extra.oracle_sql()
