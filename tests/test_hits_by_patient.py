"""Hits dealt out by patient: what is moved, and lists of many that ask."""

import re

import pytest
from pyspark.sql import functions as F

from caseweave.plans import cohorts
from caseweave.plans.cohorts import COHORTS, evaluate
from caseweave.storage import keep
from checks.instances import instances_for


def moved(df):
    """Exchanges of rows that are made of events."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.split("\n") if re.search(r"Exchange hashpartitioning\((instance_id|person_id)", line)]


@pytest.mark.parametrize("key", ["F0003", "F0006", "F0009", "F0015", "F0022", "F0032", "F0033"])
def test_hits_are_not_moved_after_events(star, key):
    """Events are dealt out by patient once; after that only counts and instances move."""
    cohort = COHORTS[key]
    found = moved(evaluate(star, cohort, instances_for(star, cohort)))
    assert sum("hashpartitioning(person_id" in line for line in found) == 1
    assert not [line for line in found if re.search(r"hashpartitioning\([^)]*instance_id[^)]*person_id", line)]


@pytest.mark.parametrize("key", ["F0003", "F0006", "F0022", "F0032"])
def test_lists_of_many_that_ask(star, monkeypatch, key):
    """An item that more instances ask for than a list has gets several lists, with the same results."""
    cohort = COHORTS[key]
    instances = keep(instances_for(star, cohort), "instances")
    result = lambda: {tuple(r) for r in evaluate(star, cohort, instances).collect()}
    whole = result()
    monkeypatch.setattr(cohorts, "ASKING", 1)
    assert whole and result() == whole


def test_dateless_hits_and_those_of_nobody(star):
    """Nobody is one patient of "after", as before, and is in no period; undated hits are in neither."""
    spark = star.spark
    code = star.concept.filter("domain_id = 'Drug' AND vocabulary_id = 'RxNorm' AND concept_id % 30 <> 11").orderBy("concept_id")
    first, second = [(r.vocabulary_id, r.concept_code, r.concept_id) for r in code.limit(2).collect()]
    schema = "drug_exposure_id long, person_id long, drug_concept_id long, drug_exposure_start_date string, drug_exposure_end_date string"
    rows = [(p, n, c[2], day) for n, (p, c, day) in enumerate(
        (p, c, day) for p, days in ((1, ("2020-01-01", "2020-03-01")), (None, ("2020-01-01", "2020-03-01")), (2, ("2020-01-01", None)), (3, ("2020-01-01", "2020-01-05")))
        for c, day in zip((first, second), days, strict=True)
    )]
    exposure = spark.createDataFrame([(n, p, c, day, None) for p, n, c, day in rows], schema)
    dates = ["drug_exposure_start_date", "drug_exposure_end_date"]

    class Some:
        drug_exposure = exposure.withColumns({d: F.col(d).cast("date") for d in dates})
        __getattr__ = lambda self, name: getattr(star, name)

    codes = "instance_id long, codes array<struct<vocabulary_id: string, concept_code: string>>"
    instances = spark.createDataFrame([(7, [first[:2], second[:2]]), (None, [first[:2], second[:2]])], codes)
    count = lambda key: evaluate(Some(), COHORTS[key], instances).filter("instance_id = 7").first()[1]
    assert count("F0003") == 1 and count("F0029") == 3
