"""Physical plans: pruned scans, limited windows, top-k in one step. (Bad joins are looked for in test_against_sql.)"""

import re

from checks.starviews import StarTables, star_tables
from caseweave.operators import persons
from caseweave.plans import discovery
from caseweave.plans.cohorts import COHORTS, evaluate
from checks.instances import instances_for
from conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(star):
    text = plan(discovery.drugs(star))
    assert "ReadSchema: struct<person_id:bigint,drug_concept_id:bigint>" in text
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(domain_id,Drug\)", text)


def test_yearly_head_is_limited_before_the_shuffle(star):
    text = plan(discovery.drugs_of_each_year(star, head=20))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_top_k_is_one_step(star):
    assert "TakeOrderedAndProject" in plan(discovery.drug_pairs(star))


def test_tables_are_kept_once_per_session(spark):
    assert star_tables(spark, SF) is star_tables(spark, SF)


def test_tables_are_written_when_they_are_read(spark):
    tables = StarTables(spark, SF)
    discovery.birth_years(tables).collect()
    assert set(tables._made) == {"person"}
    rows = [getattr(tables, name).count() for name in ("drug_exposure", "drug_era", "condition_occurrence", "condition_era")]
    assert set(tables._made) == {"person", "lines"} and len(set(rows)) == 1


def test_short_overlaps_shuffle_hits_once(spark):
    hits = spark.createDataFrame([(1, 1, 0, 0, 9)], "instance_id long, person_id long, slot int, first int, last int")
    text = plan(persons.having_short_overlap(hits, 4, 30))
    assert "Join" not in text and text.count("Exchange") == 1


def test_events_of_a_trait_are_dealt_by_patient_once(star):
    cohort = COHORTS["F0034"]
    text = plan(evaluate(star, cohort, instances_for(star, cohort)))
    assert "count(distinct" not in text and len(re.findall(r"REPARTITION_BY_COL", text)) == 1
