"""Grading of written answers against true results, by rules, as column expressions.

Input: (query_id, query, response, execution_result), the last one as JSON text. A verdict needs
only its own row; the summary is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseweave.functions.text import numbers_in, refuses

TOLERANCE = 0.01

# Explanation texts. %s is filled in.
REFUSED = "The LLM's response indicates an error or does not provide a numeric answer."
NO_EXPECTED = "Could not extract expected value from execution result."
NO_NUMBER = "The LLM's response does not provide any numeric value. Expected: %s."
MATCH = "The LLM correctly reported the value %s which matches the execution result."
MISMATCH = "The LLM reported %s but the execution result was %s."
NO_RESULTS = "No results"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return _kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _number(v: Column) -> Column:
    """A numeric variant as a double; null for anything else."""
    return F.when(_is_number(v), F.try_variant_get(v, "$", "double"))


def float_text(x: Column) -> Column:
    """A double as 12.0, 0.5 or 12345678.25; from 1e16 up and below 1e-4 as 1.5e+17, 2e-05."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    plain = F.rtrim(x.cast("decimal(38, 16)").cast("string"), F.lit("0"))
    power = x.cast("string")
    for pattern, text in ((r"E(\d+)$", "e+$1"), (r"E-(\d)$", "e-0$1"), (r"E-(\d\d+)$", "e-$1"), (r"\.0e", "e")):
        power = F.regexp_replace(power, pattern, text)
    return (
        F.when(whole, F.concat(x.cast("long").cast("string"), F.lit(".0")))
        .when((F.abs(x) >= 1e-4) & (F.abs(x) < 1e16), F.when((F.abs(x) < 1e-3) | (F.abs(x) >= 1e7), plain).otherwise(power))
        .otherwise(power)
    )


def with_expected(answers: DataFrame) -> DataFrame:
    """Add ``expected`` (double) and ``expected_text``.

    Nothing, [] and a bare 0 give none; one cell stands for itself; when all rows are wider than
    one, the last column is summed; otherwise the rows are counted.
    """
    parsed = answers.withColumn("whole", F.try_parse_json("execution_result"))
    rows = F.try_variant_get("whole", "$", "array<variant>")
    parsed = parsed.withColumn("rows", F.transform(rows, lambda r: F.try_variant_get(r, "$", "array<variant>")))
    single = (F.size("rows") == 1) & (F.size(F.get("rows", F.lit(0))) == 1)
    cell = F.get(F.get("rows", F.lit(0)), F.lit(0))
    wide = F.forall("rows", lambda r: r.isNotNull() & (F.size(r) > 1))
    last = F.transform("rows", lambda r: F.element_at(r, -1))
    numeric = F.filter(last, _is_number)
    total = F.aggregate(numeric, F.lit(0.0), lambda acc, v: acc + _number(v))
    bare = _number(F.col("whole"))
    expected = (
        F.when(F.col("rows").isNull(), F.when(bare != 0, bare))
        .when(F.size("rows") == 0, F.lit(None))
        .when(single, _number(cell))
        .when(wide, total)
        .otherwise(F.size("rows").cast("double"))
    )
    integral = (
        F.when(F.col("rows").isNull(), _kind(F.col("whole")) == "BIGINT")
        .when(single, _kind(cell) == "BIGINT")
        .when(wide, F.forall(numeric, lambda v: _kind(v) == "BIGINT"))
        .otherwise(True)
    )
    return (
        parsed.withColumn("expected", expected)
        .withColumn("integral", integral)
        .withColumn(
            "expected_text", F.when(F.col("integral"), F.col("expected").cast("long").cast("string")).otherwise(float_text(F.col("expected")))
        )
        .drop("whole", "rows", "integral")
    )


def grade(answers: DataFrame) -> DataFrame:
    """One verdict per answer: correct, confidence, extracted_value and explanation.

    In this order: a refusal without a number, no expected value, no number, any number within
    0.01 of the expected one, and otherwise a mismatch.
    """
    rows = with_expected(answers).withColumn("numbers", numbers_in("response"))
    near = F.filter("numbers", lambda n: F.abs(n - F.col("expected")) <= TOLERANCE)
    rows = rows.withColumn("near", near).withColumn("first", F.get("numbers", F.lit(0)))
    silent = F.size("numbers") == 0
    refused = refuses("response") & silent
    unknown = F.col("expected").isNull()
    correct = ~refused & ~unknown & (F.size("near") > 0)
    hit = F.get("near", F.lit(0))
    explanation = (
        F.when(refused, F.lit(REFUSED))
        .when(unknown, F.lit(NO_EXPECTED))
        .when(silent, F.format_string(NO_NUMBER, F.col("expected_text")))
        .when(F.size("near") > 0, F.format_string(MATCH, float_text(hit)))
        .otherwise(F.format_string(MISMATCH, float_text(F.col("first")), F.col("expected_text")))
    )
    return rows.select(
        F.col("query_id").alias("id"),
        "query",
        "execution_result",
        "response",
        F.coalesce(correct, F.lit(False)).alias("correct"),
        F.when(~refused & unknown, "low").otherwise("high").alias("confidence"),
        F.when(refused, F.lit(None)).when(correct, hit).otherwise(F.col("first")).alias("extracted_value"),
        explanation.alias("explanation"),
    )


def _count(test: Column | str) -> Column:
    test = F.expr(test) if isinstance(test, str) else test
    return F.count(F.when(test, 1))


def _summary(verdicts: DataFrame, missing: Column) -> DataFrame:
    counts = verdicts.agg(
        F.count("*").alias("total_entries"),
        _count(~missing).alias("total_evaluated"),
        _count(F.col("correct") & ~missing).alias("correct_responses"),
        _count(~F.col("correct") & ~missing).alias("incorrect_responses"),
        _count(missing).alias("evaluation_errors"),
        *[_count(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")],
    )
    share = F.when(F.col("total_evaluated") > 0, F.col("correct_responses") / F.col("total_evaluated") * 100).otherwise(0.0)
    return counts.select(
        "total_entries", "total_evaluated", "correct_responses", "incorrect_responses", "evaluation_errors",
        share.alias("accuracy"), F.struct("high", "medium", "low").alias("confidence_breakdown"),
    )


def summarise(verdicts: DataFrame) -> DataFrame:
    """Totals and accuracy of rule-based verdicts; every entry counts."""
    return _summary(verdicts, F.lit(False))


def outside_verdicts(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts made elsewhere, joined to their answers.

    ``verdicts``: (query_id, correct, confidence, extracted_value, explanation). An answer without
    a true result gets a verdict of its own, with low confidence.
    """
    missing = F.col("execution_result").isNull()
    joined = answers.join(verdicts, "query_id", "left")
    return joined.select(
        F.col("query_id").alias("id"), "query",
        normalised("execution_result").alias("execution_result"),
        "response",
        F.when(missing, False).otherwise(F.coalesce("correct", F.lit(False))).alias("correct"),
        F.when(missing, "low").otherwise(F.col("confidence")).alias("confidence"),
        F.when(~missing, F.col("extracted_value")).alias("extracted_value"),
        F.when(missing, "No execution result found in metadata").otherwise(F.col("explanation")).alias("explanation"),
        F.when(missing, "Missing execution_result").alias("error"),
    )


def summarise_outside(verdicts: DataFrame) -> DataFrame:
    """Answers without a true result are errors: left out of the accuracy, counted under low confidence."""
    return _summary(verdicts, F.col("error").isNotNull())


def incorrect(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(~F.col("correct"))


def normalised(result: str | Column) -> Column:
    """A true result without needless brackets, as JSON text: [[x]] and [x] give x, [row] the row, [] null."""
    whole = F.try_parse_json(F.col(result) if isinstance(result, str) else result)
    rows = F.try_variant_get(whole, "$", "array<variant>")
    only = F.get(rows, F.lit(0))
    cells = F.try_variant_get(only, "$", "array<variant>")
    return (
        F.when(rows.isNull(), F.to_json(whole))
        .when(F.size(rows) == 0, F.lit(None))
        .when(F.size(rows) > 1, F.to_json(whole))
        .when(cells.isNull(), F.to_json(only))
        .when(F.size(cells) == 1, F.to_json(F.get(cells, F.lit(0))))
        .otherwise(F.to_json(only))
    )


def display(result: str | Column) -> Column:
    """The result for reading: text without quotes, anything else as JSON, nothing as 'No results'."""
    text = normalised(result)
    plain = F.try_variant_get(F.try_parse_json(text), "$", "string")
    quoted = text.startswith('"')
    return F.when(text.isNull() | (text == "null"), NO_RESULTS).when(quoted, plain).otherwise(text)
