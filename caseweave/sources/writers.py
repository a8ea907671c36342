"""Datasets and grading reports as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_dataset(dataset: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per item. Numbers in the answers are written as numbers."""
    dataset.withColumn("execution_result", as_numbers("execution_result")).write.mode(mode).json(path)


def as_numbers(result: str) -> Column:
    """Answer cells as variants: whole numbers and decimals become numbers, all else stays text."""
    return F.transform(result, lambda row: F.transform(row, _cell))


def _cell(cell: Column) -> Column:
    number = cell.try_cast("decimal(38, 10)")
    whole = cell.try_cast("long")
    return (
        F.when(whole.isNotNull() & cell.rlike(r"^-?\d+$"), F.parse_json(whole.cast("string")))
        .when(number.isNotNull() & cell.rlike(r"^-?\d+\.\d+$"), F.parse_json(number.cast("double").cast("string")))
        .when(cell.isNotNull(), F.try_parse_json(F.to_json(F.struct(cell.alias("v")))).cast("map<string,variant>")["v"])
    )


def plain_answer(result: str) -> Column:
    """An empty answer is null, a single cell stands alone, anything else is JSON text."""
    r = F.col(result)
    single = (F.size(r) == 1) & (F.size(F.get(r, F.lit(0))) == 1)
    return F.when(r.isNull() | (F.size(r) == 0), F.lit(None)).when(single, r[0][0]).otherwise(F.to_json(as_numbers(result)))


def answers_table(dataset: DataFrame) -> DataFrame:
    return dataset.select("id", "input", plain_answer("execution_result").alias("expected_output"))


def sql_table(dataset: DataFrame) -> DataFrame:
    """The SQL text as it is, without quoting it a second time."""
    return dataset.select("id", "input", "expected_output")


def write_csv(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    table.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_reports(verdicts: DataFrame, summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The full report (summary, verdicts) and the report of wrong answers, below one folder."""
    wrong = verdicts.filter("NOT correct")
    totals = summary.select(
        F.col("incorrect_responses").alias("total_incorrect"),
        (F.when(F.col("total_entries") > 0, F.col("incorrect_responses") / F.col("total_entries") * 100).otherwise(0.0)).alias(
            "percentage_of_total"
        ),
    )
    for name, df in (("summary", summary), ("comparisons", verdicts), ("incorrect_summary", totals), ("incorrect_queries", wrong)):
        df.write.mode(mode).json(f"{path}/{name}")
