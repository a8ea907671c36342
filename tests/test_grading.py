import json

import pytest

from caseweave.functions.text import numbers_in, refuses, squeeze
from caseweave.plans import grading
from caseweave.sources.answers import read_answers
from caseweave.sources.writers import write_reports

CASES = [
    # id, response, result, correct, confidence, value, explanation
    ("1", "There are 1,234 patients", "[[1234]]", True, "high", 1234.0,
     "The LLM correctly reported the value 1234.0 which matches the execution result."),
    ("2", "An ERROR occurred", "[[3]]", False, "high", None, grading.REFUSED),
    ("3", "I'll look", "[]", False, "high", None, grading.REFUSED),
    ("4", "none", "[[0]]", False, "high", None, "The LLM's response does not provide any numeric value. Expected: 0."),
    ("5", "0 patients", "[[0]]", True, "high", 0.0, "The LLM correctly reported the value 0.0 which matches the execution result."),
    ("6", "0", "0", False, "low", 0.0, grading.NO_EXPECTED),
    ("7", "total 30", '[["a", 10], ["b", 20]]', True, "high", 30.0,
     "The LLM correctly reported the value 30.0 which matches the execution result."),
    ("8", "2", "[[1], [2]]", True, "high", 2.0, "The LLM correctly reported the value 2.0 which matches the execution result."),
    ("9", "about 12.505", "12.5", True, "high", 12.505,
     "The LLM correctly reported the value 12.505 which matches the execution result."),
    ("10", "5 or 7 on 2020-01-08", "[[8]]", False, "high", 5.0, "The LLM reported 5.0 but the execution result was 8."),
    ("11", "5 or 7 on 2020-01-08", "[[2020]]", True, "high", 2020.0,
     "The LLM correctly reported the value 2020.0 which matches the execution result."),
    ("12", "Nothing", None, False, "low", None, grading.NO_EXPECTED),
    ("13", "failed 8 times", "[[8]]", True, "high", 8.0,
     "The LLM correctly reported the value 8.0 which matches the execution result."),
    ("14", "3", "[]", False, "low", 3.0, grading.NO_EXPECTED),
    ("15", "30", '[["a", "x"], ["b", 20]]', False, "high", 30.0, "The LLM reported 30.0 but the execution result was 20."),
    ("16", "1.5", '[["a", 1.5], ["b", 2]]', False, "high", 1.5, "The LLM reported 1.5 but the execution result was 3.5."),
    ("17", "12345678.25", "[[1]]", False, "high", 12345678.25, "The LLM reported 12345678.25 but the execution result was 1."),
    ("18", "0.0005", "[[1]]", False, "high", 0.0005, "The LLM reported 0.0005 but the execution result was 1."),
    ("19", "12345678901234567", "[[1]]", False, "high", 1.2345678901234567e16,
     "The LLM reported 1.2345678901234568e+16 but the execution result was 1."),
]


@pytest.fixture(scope="module")
def answers(spark):
    rows = [(c[0], "q", c[1], c[2]) for c in CASES]
    return spark.createDataFrame(rows, "query_id string, query string, response string, execution_result string")


def test_verdicts(answers):
    got = {r["id"]: r for r in grading.grade(answers).collect()}
    for case in CASES:
        r = got[case[0]]
        assert (r["correct"], r["confidence"], r["extracted_value"], r["explanation"]) == case[3:], case


def test_summary(answers):
    verdicts = grading.grade(answers)
    s = grading.summarise(verdicts).first()
    right = sum(c[3] for c in CASES)
    assert (s["total_entries"], s["total_evaluated"], s["correct_responses"], s["incorrect_responses"], s["evaluation_errors"]) == (
        len(CASES), len(CASES), right, len(CASES) - right, 0,
    )
    assert s["accuracy"] == pytest.approx(right / len(CASES) * 100)
    assert s["confidence_breakdown"].asDict() == {"high": len(CASES) - 3, "medium": 0, "low": 3}
    assert grading.incorrect(verdicts).count() == len(CASES) - right
    assert grading.summarise(verdicts.limit(0)).first()["accuracy"] == 0


def test_outside_summary(spark, answers):
    verdicts = spark.createDataFrame(
        [(c[0], c[0] != "2", "medium" if c[0] == "3" else "high", "v", "e") for c in CASES],
        "query_id string, correct boolean, confidence string, extracted_value string, explanation string",
    )
    joined = grading.outside_verdicts(answers, verdicts)
    s = grading.summarise_outside(joined).first()
    assert (s["total_entries"], s["total_evaluated"], s["evaluation_errors"]) == (len(CASES), len(CASES) - 1, 1)
    assert (s["correct_responses"], s["incorrect_responses"]) == (len(CASES) - 2, 1)
    assert s["accuracy"] == pytest.approx((len(CASES) - 2) / (len(CASES) - 1) * 100)
    assert s["confidence_breakdown"].asDict() == {"high": len(CASES) - 2, "medium": 1, "low": 1}
    missing = joined.filter("id = '12'").first()
    assert missing["error"] == "Missing execution_result" and not missing["correct"]


def test_display(spark):
    rows = [("[[4]]", "4", "4"), ("[4]", "4", "4"), ("4", "4", "4"), ("[]", None, "No results"), (None, None, "No results"),
            ('[["x"]]', '"x"', "x"), ('[["a",1]]', '["a",1]', '["a",1]'), ("[[1],[2]]", "[[1],[2]]", "[[1],[2]]")]
    df = spark.createDataFrame([r[:1] for r in rows], "r string")
    got = df.select("r", grading.normalised("r").alias("n"), grading.display("r").alias("d")).collect()
    assert [tuple(r) for r in got] == rows


def test_text(spark):
    df = spark.createDataFrame([("  a\n\tb  c ", "-1,000.5 and 3. x7", "Please PROVIDE it")], "a string, b string, c string")
    row = df.select(squeeze("a"), numbers_in("b"), refuses("c"), refuses("a")).first()
    assert tuple(row) == ("a b c", [-1000.5, 3.0, 7.0], True, False)


def test_files(spark, tmp_path):
    records = [{"query_id": c[0], "query": "q", "response": c[1],
                "metadata": {"execution_result": None if c[2] is None else json.loads(c[2])}} for c in CASES]
    (tmp_path / "whole.json").write_text(json.dumps({"results": records}, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records))
    want = {c[0]: c[3] for c in CASES}
    for answers in (read_answers(spark, str(tmp_path / "whole.json")), read_answers(spark, str(tmp_path / "lines.json"), lines=True)):
        verdicts = grading.grade(answers)
        assert {r["id"]: r["correct"] for r in verdicts.collect()} == want
    out = str(tmp_path / "report")
    write_reports(verdicts, grading.summarise(verdicts), out)
    wrong = sum(not v for v in want.values())
    assert spark.read.json(f"{out}/comparisons").count() == len(CASES)
    assert spark.read.json(f"{out}/incorrect_queries").count() == wrong
    assert spark.read.json(f"{out}/summary").first()["incorrect_responses"] == wrong
    assert spark.read.json(f"{out}/incorrect_summary").first()["percentage_of_total"] == pytest.approx(wrong / len(CASES) * 100)
