"""Answer records of one JSON object, read by many tasks."""

import json
import random

import pytest

from caseweave.sources.answers import array_records, read_answers

NASTY = ['a}b{c', '"}{"', "\\", "\\\"}", "]},{", "\n}\r\n", '"results": [{', "", "é🙂}", "}}}}{{{{[[", "plain"]


def records(seed, n):
    rng = random.Random(seed)
    pick = lambda: "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4)))
    return [{"query_id": str(i), "query": pick(), "response": pick(), "metadata": {"execution_result": pick(), "results": [{"x": pick()}]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split_bytes", [97, 1000, None])
def test_records_of_an_object_in_any_split(spark, tmp_path, indent, split_bytes):
    files = {}
    for n, (before, after) in enumerate([({}, {}), ({"title": "x}{y", "tags": ["a", "]"]}, {"note": "a}b", "end": {"results": [{"query_id": "no"}]}}), ({"meta": {"k": {"query_id": "no"}}}, {"more": [{"query_id": "no"}]})]):
        own = records(n, 25)
        (tmp_path / f"{n}.json").write_text(json.dumps(before | {"results": own} | after, indent=indent, ensure_ascii=bool(n % 2)), encoding="utf-8", newline="")
        files[f"{n}.json"] = own
    found = {}
    rows = array_records(spark, str(tmp_path), "results", split_bytes).collect()
    for r in sorted(rows, key=lambda r: r["n"]):
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["record"]))
    assert found == files


def test_many_tasks_read_one_file(spark, tmp_path):
    own = records(9, 400)
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"results": own}))
    parts = spark.read.option("lineSep", "}").text(str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert parts.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r["query_id"]: (r["query"], r["response"], r["execution_result"]) for r in read_answers(spark, str(path), split_bytes=5000).collect()}
    assert got == {r["query_id"]: (r["query"], r["response"], r["metadata"]["execution_result"]) for r in own}


@pytest.mark.parametrize("text", ['{"results": []}', "{}", '{"results": [], "x": [{"query_id": "no"}]}'])
def test_no_records(spark, tmp_path, text):
    (tmp_path / "none.json").write_text(text)
    assert read_answers(spark, str(tmp_path / "none.json")).count() == 0
