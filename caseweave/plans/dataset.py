"""From discovered rows to a dataset of question, SQL and answer.

A discovered row names concepts and perhaps a value. Each name is looked up for its own slot, the
row becomes an instance of a cohort, all instances of the cohort are evaluated in one job, and an
item is written per instance:

    id long, input string, expected_output string, execution_result array<array<string>>
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseweave.operators.concepts import first_code
from caseweave.plans import discovery
from caseweave.plans.cohorts import COHORTS, Cohort, evaluate, report, reports, shown
from caseweave.plans.sqltext import criterion_sql, report_sql
from caseweave.schema import Shared, Tables
from caseweave.storage import keep


@dataclass(frozen=True)
class Source:
    """Where the rows of a cohort come from: row = columns in question order, names = those of the slots."""

    find: Callable[..., DataFrame]
    names: tuple[str, ...] = ()
    value: str | None = None
    row: tuple[str, ...] = ()
    order: tuple[str, ...] = ()


def _set(find: Callable[..., DataFrame], what: str, size: int) -> Source:
    names = tuple(f"{what}{n}_name" for n in range(1, size + 1))
    return Source(find, names, None, names, ("-person_count", *names))


def _pair(find: Callable[..., DataFrame], first: str, second: str) -> Source:
    return Source(find, (first, second), None, (first, second), ("-person_count", first, second))


def _common(find: Callable[..., DataFrame], value: str, value_first: bool = False) -> Source:
    row = (value, "condition_name") if value_first else ("condition_name", value)
    return Source(find, ("condition_name",), value, row, ("-total", "condition_name", value))


def _yearly(find: Callable[..., DataFrame], name: str, value: str | None) -> Source:
    return Source(find, (name,), value, (name, "year"), ("year", "-patient_count", name))


def _one(find: Callable[..., DataFrame], column: str, concept: bool) -> Source:
    return Source(find, (column,) if concept else (), None if concept else column, (column,), ("-patient_count", column))


SOURCES: dict[str, Source] = {
    "F0003": _set(discovery.drug_pairs_within_30_days, "drug", 2),
    "F0004": _set(discovery.drug_pairs, "drug", 2),
    "F0005": _set(discovery.drug_pairs, "drug", 2),  # its own discovery gives four drugs, not two
    "F0006": _set(discovery.drug_quads_overlapping, "drug", 4),
    "F0007": _set(discovery.drug_quads_overlapping_in_head, "drug", 4),
    "F0008": _set(discovery.drug_quads_in_head, "drug", 4),
    "F0009": _set(discovery.drug_triples_within_30_days, "drug", 3),
    "F0010": Source(
        discovery.drug_triples_overlapping, ("drug1_name", "drug2_name", "drug3_name"), None,
        ("drug1_name", "drug2_name", "drug3_name"),
        ("person_id", "drug1_name", "drug2_name", "drug3_name", "overlap_start", "overlap_end"),
    ),
    "F0011": _set(discovery.drug_triples_separate, "drug", 3),
    "F0012": _set(discovery.condition_pairs_within_30_days, "condition", 2),
    "F0013": _set(discovery.condition_pairs, "condition", 2),
    "F0014": _set(discovery.condition_pairs_separate, "condition", 2),
    "F0015": _set(discovery.condition_quads_within_1000_days, "condition", 4),
    "F0016": _set(discovery.condition_quads, "condition", 4),
    "F0017": _set(discovery.condition_quads_separate, "condition", 4),
    "F0018": _set(discovery.condition_triples_within_300_days, "condition", 3),
    "F0019": _set(discovery.condition_triples, "condition", 3),
    "F0020": _set(discovery.condition_triples_separate, "condition", 3),
    "F0022": _pair(discovery.condition_then_condition, "first_condition", "second_condition"),
    "F0023": _pair(discovery.condition_30_days_after_condition, "condition_a_name", "condition_b_name"),
    "F0024": _common(discovery.condition_common_age, "most_common_age"),
    "F0025": _common(discovery.condition_common_race, "most_common_race"),
    "F0026": _common(discovery.condition_common_state, "most_common_state"),
    "F0027": _common(discovery.condition_common_year, "most_common_year"),
    "F0028": _pair(discovery.drug_30_days_after_drug, "drug_b_name", "drug_a_name"),
    "F0029": _pair(discovery.drug_directly_followed_by_drug, "drug_a_name", "drug_b_name"),
    "F0030": _common(discovery.condition_common_ethnicity, "most_common_ethnicity"),
    "F0031": _yearly(discovery.drugs_of_each_year, "drug_name", "year"),
    "F0032": _pair(discovery.drug_after_condition, "condition_name", "drug_name"),
    "F0033": _pair(discovery.drug_30_days_after_condition, "condition_name", "drug_name"),
    "F0034": _common(discovery.condition_common_gender, "most_common_gender", value_first=True),
    "F0035": _one(discovery.birth_years, "year", concept=False),
    "F0049": _one(discovery.ethnicities, "ethnicity", concept=False),
    "F0050": _one(discovery.races, "race", concept=False),
    "F0051": _one(discovery.genders, "gender", concept=False),
    "F0052": _one(discovery.drugs, "drug_name", concept=True),
    "F0053": _one(discovery.conditions, "condition_name", concept=True),
    "F0054": _one(discovery.states, "location", concept=False),
    "F0055": _yearly(discovery.conditions_of_each_year, "condition_name", None),
    "F0056": _yearly(discovery.drugs_of_each_year, "drug_name", None),
}


def question(pattern: str, values: list[Column]) -> Column:
    """Question text; {0}, {1} ... stand for the values."""
    text = re.sub(r"\{(\d+)\}", lambda m: f"%{int(m[1]) + 1}$s", pattern)
    return F.format_string(text, *[v.cast("string") for v in values])


def bind(tables: Tables, cohort: Cohort, rows: DataFrame, source: Source | None = None) -> DataFrame:
    """Instances from discovered rows: (instance_id, input, codes, value).

    ``rows`` are few (a top-k), so numbering them is one small sort. Every name is resolved for its
    own slot, to its first code; a row with a name that has no code is not an instance.
    """
    source = source or SOURCES[cohort.id]
    order = [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in source.order]
    numbered = rows.withColumn("instance_id", F.row_number().over(Window.orderBy(*order)).cast("long"))
    value = F.col(source.value).cast("string") if source.value else F.lit(None).cast("string")
    out = numbered.select(
        "instance_id",
        question(cohort.question, [F.col(c) for c in source.row]).alias("input"),
        value.alias("value"),
        F.array(*[F.col(c) for c in source.names]).cast("array<string>").alias("names"),
    )
    if not source.names:
        return out.drop("names")
    places = out.select("instance_id", F.posexplode("names").alias("slot", "name"))
    found = places.join(first_code(tables, places.select("name").distinct()), "name")
    coded = found.groupBy("instance_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "vocabulary_id", "concept_code"))).alias("found")
    )
    codes = F.transform("found", lambda c: F.struct(c["vocabulary_id"].alias("vocabulary_id"), c["concept_code"].alias("concept_code")))
    return (
        out.join(coded, "instance_id")
        .filter(F.size("found") == len(source.names))
        .select("instance_id", "input", "value", codes.alias("codes"))
    )


def _cells(df: DataFrame, columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def answer_rows(tables: Tables, cohort: Cohort, instances: DataFrame, days: int | None = None) -> DataFrame:
    """(instance_id, row): every row of every result, as cells."""
    result = evaluate(tables, cohort, instances, days)
    columns = [c for c in result.columns if c != "instance_id"]
    return result.select("instance_id", _cells(result, columns).alias("row"))


def collected(items: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The items with their result rows in one array, ``execution_result``, as the written format has it."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("row")).alias("execution_result"))
    empty = F.array().cast("array<array<string>>")
    return items.join(grouped, key, "left").withColumn("execution_result", F.coalesce("execution_result", empty))


def found_instances(tables: Tables, cohort: Cohort, k: int | None = 10, days: int | None = None) -> tuple[Cohort, DataFrame]:
    """The cohort, speaking of the given days, and its discovered instances in a table."""
    source, more = SOURCES[cohort.id], {}
    if days is not None and days != cohort.days:
        # the rows, the question, the SQL text and the answer all speak of the same days
        more = {"days": days} if "days" in inspect.signature(source.find).parameters else {}
        cohort = replace(cohort, days=days, question=re.sub(rf"\b{cohort.days} days\b", f"{days} days", cohort.question))
    found = tables.once((source.find, k, days if more else None), lambda: source.find(tables, k, **more))
    return cohort, keep(bind(tables, cohort, found if source.names or k is None else found.limit(k), source), "instances")


def items(tables: Tables, cohort: Cohort, k: int | None = 10, days: int | None = None) -> DataFrame:
    """Dataset items of one cohort: (place, input, expected_output, execution_result)."""
    made, rows = parts(tables, cohort, k, days)
    return collected(made, rows, "place")


def parts(tables: Tables, cohort: Cohort, k: int | None = 10, days: int | None = None, all_reports: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of one cohort without their results (place, input, expected_output), and the result rows (place, row)."""
    if cohort.test == "report":
        table = shown(all_reports, cohort) if all_reports is not None and cohort.dims else report(tables, cohort)
        rows = table.select(F.lit(1).cast("long").alias("place"), _cells(table, table.columns).alias("row"))
        one = table.sparkSession.range(1)
        return one.select(F.lit(1).cast("long").alias("place"), F.lit(cohort.question).alias("input"), F.lit(report_sql(cohort)).alias("expected_output")), rows
    cohort, instances = found_instances(tables, cohort, k, days)
    made = instances.select(F.col("instance_id").alias("place"), "input", criterion_sql(cohort, cohort.days).alias("expected_output"))
    return made, answer_rows(tables, cohort, instances, days).withColumnRenamed("instance_id", "place")


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Running numbers 1, 2, 3 ... in an order, by sums over the counts of sorted partitions.

    Rows are ranged over partitions and written with their partition and their place in it; only a count
    per partition is summed in sequence.
    """
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(placed.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND((1 << 33) - 1)}), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(counts, "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def dataset_parts(tables: Tables, cohorts: Iterable[str] | None = None, k: int | None = 10) -> tuple[DataFrame, DataFrame]:
    """The items of many cohorts (id, cohort, input, expected_output) and their result rows (id, row).

    Ids are 1, 2, 3 ... in the order of the cohorts, then of their rows. Discovery makes its tables cohort
    by cohort, several at a time, and what several of them read is made once; reports come from one pass over the patients. Items and result rows of
    all cohorts are then one plan each; a result has as many rows as it has, and none is put in an array.
    """
    wanted, tables = [COHORTS[c] for c in (cohorts or COHORTS)], Shared(tables)
    with_dims = [c.id for c in wanted if c.test == "report" and c.dims]
    all_reports = keep(reports(tables, with_dims), "reports") if with_dims else None
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda c: parts(tables, c, k, all_reports=all_reports), wanted))
    tagged = lambda n, df: df.withColumn("turn", F.lit(n))
    every = reduce(DataFrame.unionByName, [tagged(n, one.withColumn("cohort", F.lit(c.id))) for n, (c, (one, _)) in enumerate(zip(wanted, made, strict=True))])
    rows = reduce(DataFrame.unionByName, [tagged(n, result) for n, (_, result) in enumerate(made)])
    ids = numbered(every, ["turn", "place"])
    return ids.select("id", "cohort", "input", "expected_output"), rows.join(ids.select("id", "turn", "place"), ["turn", "place"]).select("id", "row")


def dataset(tables: Tables, cohorts: Iterable[str] | None = None, k: int | None = 10) -> DataFrame:
    """Items of many cohorts as they are written: (id, input, expected_output, execution_result)."""
    made, rows = dataset_parts(tables, cohorts, k)
    return collected(made.drop("cohort"), rows, "id").select("id", "input", "expected_output", "execution_result")
