"""Datasets: every item's SQL text, run as it stands, gives the item's answer."""

import csv
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseweave.functions.text import sql_literal
from caseweave.plans import discovery
from caseweave.plans.cohorts import COHORTS, evaluate, report
from caseweave.plans.dataset import SOURCES, bind, dataset, items
from caseweave.plans.sqltext import criterion_sql, report_sql
from caseweave.sources.writers import answers_table, sql_table, write_csv, write_dataset
from caseweave.storage import keep
from checks.instances import instances_for
from conftest import concept


# One of each shape; the registered dataset queries cover more.
SHAPES = ["F0001", "F0002", "F0010", "F0013", "F0022", "F0024", "F0027", "F0032", "F0034", "F0035", "F0048", "F0050", "F0053", "F0054", "F0056"]


@pytest.fixture(scope="module")
def made(star):
    return keep(dataset(star, SHAPES, k=2), "dataset")


def cells(rows):
    return sorted(([None if c is None else str(c) for c in row] for row in rows), key=repr)


def test_every_cohort_has_items(made):
    rows = made.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, len(rows) + 1))
    texts = [r["input"] for r in rows]
    patterns = [re.sub(r"\\\{\d+\\\}", ".+", re.escape(COHORTS[c].question)) for c in SHAPES]
    assert all(any(re.fullmatch(p, t) for t in texts) for p in patterns)
    assert re.fullmatch(patterns[0], texts[0]) and re.fullmatch(patterns[-1], texts[-1])
    assert not any("{" in t or "%" in t for t in texts)


def test_sql_text_gives_the_answer(spark, star, made):
    star.register_views()
    for r in made.collect():
        assert "\n" not in r["expected_output"] and "  " not in r["expected_output"]
        assert cells(spark.sql(r["expected_output"]).collect()) == cells(r["execution_result"]), r["input"]


def test_all_parameterless_and_parameterised_cohorts_have_a_route():
    assert set(SOURCES) == {c.id for c in COHORTS.values() if c.test != "report"}
    assert len(COHORTS) == 56


@pytest.mark.parametrize("cohort", [c for c in COHORTS.values() if c.test != "report"], ids=lambda c: c.id)
def test_sql_text_of_every_cohort(spark, star, cohort):
    """The text of some instances with patients, against the batched evaluation."""
    star.register_views()
    instances = instances_for(star, cohort)
    if "value" not in instances.columns:
        instances = instances.withColumn("value", F.lit(None).cast("string"))
    instances = keep(instances.orderBy(F.desc("instance_id")).limit(25), "some")
    counted = keep(evaluate(star, cohort, instances), "counted")
    best = counted.orderBy(F.desc("number_of_patients"), "instance_id").limit(1).select("instance_id")
    row = instances.join(best, "instance_id").select("instance_id", criterion_sql(cohort, cohort.days).alias("sql")).first()
    want = counted.filter(F.col("instance_id") == row["instance_id"]).drop("instance_id")
    assert cells(spark.sql(row["sql"]).collect()) == cells(want.collect())


@pytest.mark.parametrize("cohort", [c for c in COHORTS.values() if c.test == "report"], ids=lambda c: c.id)
def test_sql_text_of_every_report(spark, star, cohort):
    star.register_views()
    assert cells(spark.sql(report_sql(cohort)).collect()) == cells(report(star, cohort).collect())


def test_sinks(made, tmp_path):
    write_dataset(made, str(tmp_path / "json"))
    write_csv(answers_table(made), str(tmp_path / "answers"))
    write_csv(sql_table(made), str(tmp_path / "sql"))
    items = [json.loads(line) for f in Path(tmp_path / "json").glob("part*") for line in f.read_text().splitlines()]
    rows = {r["id"]: r for r in made.collect()}
    assert {i["id"] for i in items} == set(rows)
    for item in items:
        assert item["expected_output"] == rows[item["id"]]["expected_output"]
        assert all(isinstance(row[-1], int) for row in item["execution_result"])  # numbers stay numbers
    read = lambda name: [
        r for f in Path(tmp_path / name).glob("part*") for r in csv.DictReader(f.open(newline=""))
    ]
    assert {int(r["id"]): r["expected_output"] for r in read("sql")} == {k: r["expected_output"] for k, r in rows.items()}
    for r in read("answers"):
        result = rows[int(r["id"])]["execution_result"]
        if not result:
            assert r["expected_output"] == ""
        elif len(result) == 1 and len(result[0]) == 1:
            assert r["expected_output"] == result[0][0]
        else:
            assert len(json.loads(r["expected_output"])) == len(result)


def test_names_are_bound_by_place(tiny, spark):
    """A name with two codes does not shift the codes after it; a name without one drops the row."""
    concepts = [concept(1, "One", "Drug", "RxNorm", "b"), concept(2, "one", "Drug", "RxNorm", "a"), concept(3, "Two", "Drug", "ATC", "t")]
    rows = spark.createDataFrame(
        [("one", "Two", 9), ("two", "ONE", 8), ("one", "nothing", 7)], "drug1_name string, drug2_name string, person_count long"
    )
    got = bind(tiny(concept=concepts), COHORTS["F0004"], rows, SOURCES["F0004"]).orderBy("instance_id").collect()
    assert [[tuple(c) for c in r["codes"]] for r in got] == [[("RxNorm", "a"), ("ATC", "t")], [("ATC", "t"), ("RxNorm", "a")]]
    assert got[0]["input"] == "Counts of patients taking drug one and Two."


def test_quotes_in_values(tiny, spark):
    people = [(1, 1980, None, 5, None, None)]
    tables = tiny(person=people, concept=[concept(5, "O'Neil 100% %s", "Race")])
    item = items(tables, COHORTS["F0050"], 5).first()
    assert item["execution_result"] == [["1"]]
    tables.register_views()
    assert spark.sql(item["expected_output"]).first()[0] == 1


def test_days_reach_rows_question_and_sql(star):
    """One number of days in the discovery, the question, the SQL text and the answer."""
    made = items(star, COHORTS["F0003"], k=2, days=60).orderBy("place").collect()
    found = {tuple(sorted((r["drug1_name"], r["drug2_name"]))) for r in discovery.drug_pairs_within_30_days(star, k=2, days=60).collect()}
    for r in made:
        assert "60 days" in r["input"] and "30 days" not in r["input"] and "<= 60" in r["expected_output"]
        assert any(a in r["input"] and b in r["input"] for a, b in found)


def test_literals_survive_as_sql_text(spark):
    for value in ("a\\b", "it's", "two  blanks", "\\'", "tab\\t"):
        text = spark.range(1).select(sql_literal(F.lit(value))).first()[0]
        assert spark.sql(f"SELECT {text}").first()[0] == value


def test_steps_of_a_dataset_are_shared(star, monkeypatch):
    """Two cohorts of one discovery find its rows once, and two gaps share the lists of ends."""
    from caseweave.operators import pairs

    made = []
    for function in ("lists_of", "ends_of"):
        monkeypatch.setattr(pairs, function, lambda *args, f=getattr(pairs, function), name=function: made.append(name) or f(*args))
    rows = dataset(star, ["F0004", "F0005", "F0022", "F0023"], k=2)
    assert sorted(made) == ["ends_of", "lists_of"]
    assert rows.count() == 8
