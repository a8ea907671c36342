"""Ids that are looked up by bits, so that rows with texts do not move."""

from pyspark.sql import functions as F

from caseweave.llm import graph, neardup


def test_marks_are_exact(spark):
    numbers = [0, 7, 8, 32767, 32768, 65535, (3 << 33) + 5, (3 << 33) + 40000]
    rows = spark.createDataFrame([(n,) for n in [*numbers, 1, 9, 32766, 32769, (3 << 33) + 4, None]], "number long")
    found = spark.createDataFrame([(n,) for n in numbers] + [(7,)], "number long")
    got = graph.marked(rows, F.col("number"), found, "there")
    assert sorted(r["number"] for r in got.filter("there").collect()) == sorted(numbers)
    assert got.count() == rows.count()


def test_no_id_is_lost(spark, monkeypatch):
    rows = spark.range(-50_000, 50_000)
    ids = rows.filter("id % 97 = 3").withColumn("id", F.col("id") * 1)
    got = graph.perhaps(rows, "id", ids, ids.count())
    assert got.join(ids, "id", "left_semi").count() == ids.count()
    assert got.count() < 1.2 * ids.count() + rows.count() / graph.HASHED
    monkeypatch.setattr(graph, "MOST_BITS", 1)
    assert graph.perhaps(rows, "id", ids, ids.count()).count() == ids.count()


def test_bands_and_texts_do_not_move(spark):
    """With no broadcast by size, only bits decide which rows go on."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        described = neardup.describe(spark.createDataFrame([(n, f"a b c d e f {n}") for n in range(20)], "doc_id long, text string"))
        described = described.withColumn("place", F.monotonically_increasing_id())
        whole = described.select("doc_id", "bands", "place")
        plan = graph.marked(whole, F.col("place"), whole.filter("doc_id < 5").select("place"), "copy")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
