"""Registered queries for the building blocks, the dataset and the grading, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseweave.functions import dates
from caseweave.operators import concepts
from caseweave.plans import dataset, grading
from caseweave.plans.cohorts import COHORTS, reports, slot_rows
from caseweave.sources.writers import plain_answer
from checks.cohort_sql import _LABELS, _criterion, cohort_sql
from checks.discovery_sql import discovery_sql, with_star
from checks.instances import _SETS, _slots_of_chains, chains
from checks.starviews import star_tables

# --- concept sets and lookups --------------------------------------------------------------------

_SET_QUERIES = {
    "CS1_map_inner": ("map_inner", "Drug"),
    "CS2_map_coalesce_raw": ("map_coalesce_raw", "Condition"),
    "CS3_map_coalesce_valid": ("map_coalesce_valid", "Condition"),
    "CS4_map_coalesce_self": ("map_coalesce_self", "Condition"),
    "CS5_map_only": ("map_only", "Drug"),
}


def _set_query(variant: str, domain: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = star_tables(spark, sf_dir)
        slots = slot_rows(chains(tables, domain, 1))
        return concepts.resolve_concepts(tables, slots, variant).select("instance_id", "concept_id")

    return run


def _set_sql(variant: str, domain: str) -> str:
    return with_star(
        f"SELECT DISTINCT CAST(instance_id AS BIGINT) AS instance_id, CAST(concept_id AS BIGINT) AS concept_id FROM ({_SETS[variant]}) q",
        _slots_of_chains(domain, 1),
    )


def trait_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star_tables(spark, sf_dir)
    wanted = tables.concept.select(F.col("concept_id").alias("instance_id"), F.col("concept_name").alias("value"))
    out = None
    for domain in ("Gender", "Race", "Ethnicity"):
        found = concepts.trait_concepts(tables, wanted, domain).withColumn("domain", F.lit(domain))
        out = found if out is None else out.unionByName(found)
    return out


TRAIT_BY_NAME = with_star(
    "SELECT DISTINCT w.concept_id AS instance_id, k.concept_id, k.domain_id AS domain FROM concept w JOIN concept k ON k.concept_name = w.concept_name "
    "WHERE k.domain_id IN ('Gender', 'Race', 'Ethnicity') AND k.standard_concept = 'S'"
)


def race_by_name_or_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star_tables(spark, sf_dir)
    names = tables.concept.select("concept_id", F.upper("concept_name").alias("value"), F.lit(0).alias("way"))
    others = tables.concept_synonym.select("concept_id", F.initcap("concept_synonym_name").alias("value"), F.lit(1).alias("way"))
    wanted = names.unionByName(others).select((F.col("concept_id") * 2 + F.col("way")).alias("instance_id"), "value")
    return concepts.trait_concepts_with_synonyms(tables, wanted, "Race")


RACE_BY_NAME = with_star(
    "SELECT DISTINCT CAST(w.instance_id AS BIGINT) AS instance_id, k.concept_id FROM concept k JOIN "
    "(SELECT concept_id * 2 AS instance_id, lower(concept_name) AS value FROM concept "
    "UNION ALL SELECT concept_id * 2 + 1, lower(concept_synonym_name) FROM concept_synonym) w "
    "ON lower(k.concept_name) = w.value OR EXISTS (SELECT 1 FROM concept_synonym y WHERE y.concept_id = k.concept_id "
    "AND lower(y.concept_synonym_name) = w.value) WHERE k.domain_id = 'Race' AND k.standard_concept = 'S' AND k.invalid_reason IS NULL"
)


def code_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star_tables(spark, sf_dir)
    names = tables.concept.select(F.upper("concept_name").alias("name")).distinct()
    return concepts.first_code(tables, names)


_RANKED = (
    "SELECT lower(concept_name) AS lowered, vocabulary_id, concept_code, CASE vocabulary_id WHEN 'RxNorm' THEN 0 WHEN 'ATC' THEN 1 "
    "WHEN 'SPL' THEN 2 WHEN 'SNOMED' THEN 3 WHEN 'ICD10CM' THEN 4 END AS r FROM concept WHERE standard_concept = 'S' "
    "AND domain_id IN ('Drug', 'Condition')"
)
FIRST_CODE = (
    f"codes AS (SELECT lowered, vocabulary_id, concept_code FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lowered ORDER BY r, concept_code) AS place "
    f"FROM ({_RANKED}) a) b WHERE place = 1)"
)
CODE_OF_NAME = with_star(
    "SELECT name, vocabulary_id, concept_code FROM (SELECT DISTINCT upper(concept_name) AS name FROM concept) n "
    "JOIN codes ON codes.lowered = lower(n.name)",
    FIRST_CODE,
)


def ranges_in_first_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure ranges against the first half of the year they start in, per drug."""
    tables = star_tables(spark, sf_dir)
    year = F.trunc("drug_exposure_start_date", "year")
    exposure = dates.date_range("drug_exposure_start_date", "drug_exposure_end_date")
    half = dates.date_range(year, F.date_add(year, 180))
    common = dates.range_intersection(exposure, half)
    days = F.when(~dates.range_is_empty(common), dates.days_between(common["start"], common["end"]) + 1)
    return tables.drug_exposure.groupBy(F.col("drug_concept_id").alias("concept_id")).agg(
        F.count(F.when(dates.ranges_overlap(exposure, half), 1)).alias("overlapping"),
        F.count(F.when(dates.range_is_empty(common), 1)).alias("apart"),
        F.coalesce(F.sum(days), F.lit(0)).alias("common_days"),
    )


RANGES = with_star(
    "SELECT i AS concept_id, COUNT(*) FILTER (WHERE s <= h) AS overlapping, COUNT(*) FILTER (WHERE s > h) AS apart, "
    "CAST(COALESCE(SUM(CASE WHEN s <= h THEN LEAST(h, f) - s + 1 END), 0) AS BIGINT) AS common_days "
    "FROM (SELECT drug_concept_id AS i, drug_exposure_start_date AS s, COALESCE(drug_exposure_end_date, DATE '9999-12-31') AS f, "
    "make_date(EXTRACT(YEAR FROM drug_exposure_start_date), 1, 1) + 180 AS h FROM drug_exposure) q GROUP BY 1"
)

# --- dataset --------------------------------------------------------------------------------------

# The discovery that each cohort's items come from; cohorts without one are reports.
_FOUND_BY = {"F0003": "Q0001", "F0004": "Q0002", "F0005": "Q0002", "F0006": "Q0004", "F0007": "Q0005", "F0008": "Q0006", "F0009": "Q0007",
             "F0010": "Q0008", "F0011": "Q0009", "F0012": "Q0010", "F0013": "Q0011", "F0014": "Q0012", "F0015": "Q0013", "F0016": "Q0014",
             "F0017": "Q0015", "F0018": "Q0016", "F0019": "Q0017", "F0020": "Q0018", "F0022": "Q0019", "F0023": "Q0020", "F0024": "Q0021",
             "F0025": "Q0022", "F0026": "Q0023", "F0027": "Q0024", "F0028": "Q0025", "F0029": "Q0026", "F0030": "Q0027", "F0031": "Q0028",
             "F0032": "Q0029", "F0033": "Q0030", "F0034": "Q0031", "F0035": "Q0032", "F0049": "Q0033", "F0050": "Q0034", "F0051": "Q0035",
             "F0052": "Q0036", "F0053": "Q0037", "F0054": "Q0038", "F0055": "Q0039", "F0056": "Q0040"}
DATASETS = list(_FOUND_BY)


def _dataset_query(cohort_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = star_tables(spark, sf_dir)
        made = dataset.items(tables, COHORTS[cohort_id])
        return made.select("place", "input", plain_answer("execution_result").alias("answer"))

    return run


def _dataset_sql(cohort_id: str, by_row: bool = False) -> str:
    """Items of a cohort with the answer in one cell, or with a row for each row of the result."""
    cohort, source = COHORTS[cohort_id], dataset.SOURCES[cohort_id]
    order = ", ".join(f"{c[1:]} DESC" if c.startswith("-") else c for c in source.order)
    text = "'" + cohort.question.replace("'", "''") + "'"
    for n, column in enumerate(source.row):
        text = f"replace({text}, '{{{n}}}', CAST({column} AS VARCHAR))"
    value = source.value or "NULL"
    slots = " UNION ALL ".join(
        f"SELECT CAST(place AS BIGINT) AS instance_id, {n} AS slot, codes.vocabulary_id AS v, codes.concept_code AS c FROM numbered "
        f"JOIN codes ON codes.lowered = lower({name})"
        for n, name in enumerate(source.names)
    ) or "SELECT CAST(NULL AS BIGINT) AS instance_id, 0 AS slot, '' AS v, '' AS c WHERE FALSE"
    given = (
        f"{FIRST_CODE}, rows_found AS ({discovery_sql()[_FOUND_BY[cohort_id]]}), "
        f"numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS place FROM rows_found), slots AS ({slots}), "
        f"inst AS (SELECT place AS instance_id, {value} AS value FROM numbered)"
    )
    counted = _valued_population(cohort, given) if cohort.test == "trait" else _criterion(cohort, given)
    if cohort.test == "by_year":
        # The rows of a report, in text order, as JSON.
        cells = "'[' || year || ',' || number_of_patients || ']'"
        answer = (
            f"CASE WHEN COUNT(c.instance_id) = 0 THEN NULL ELSE '[' || string_agg({cells}, ',' ORDER BY CAST(year AS VARCHAR), "
            "CAST(number_of_patients AS VARCHAR)) || ']' END"
        )
    else:
        answer = "CAST(MAX(number_of_patients) AS VARCHAR)"
    numbered = with_star(f"SELECT place, {text} AS input FROM numbered", given)
    if by_row:
        cells = "year || '|' || number_of_patients" if cohort.test == "by_year" else "CAST(number_of_patients AS VARCHAR)"
        return f"SELECT CAST(n.place AS BIGINT) AS place, n.input, COALESCE({cells}, '') AS result FROM ({numbered}) n LEFT JOIN ({counted}) c ON c.instance_id = n.place"
    return (
        f"SELECT CAST(n.place AS BIGINT) AS place, n.input, {answer} AS answer FROM ({numbered}) n "
        f"LEFT JOIN ({counted}) c ON c.instance_id = n.place GROUP BY 1, 2"  # an item without rows stays
    )


def _valued_population(cohort, given: str) -> str:
    """Patients of the discovered values of a demographic."""
    if cohort.trait == "birth":
        test = "LEFT JOIN person ON year_of_birth = inst.value"
    elif cohort.trait == "location":
        test = "LEFT JOIN (location l JOIN person ON person.location_id = l.location_id) ON l.state = inst.value"
    else:
        domain = cohort.trait.capitalize()
        test = (
            f"LEFT JOIN concept k ON k.concept_name = inst.value AND k.domain_id = '{domain}' AND k.standard_concept = 'S' "
            f"LEFT JOIN person ON {cohort.trait}_concept_id = k.concept_id"
        )
    return with_star(f"SELECT CAST(inst.instance_id AS BIGINT) AS instance_id, COUNT(DISTINCT person_id) AS number_of_patients FROM inst {test} GROUP BY 1", given)


_DIMS = ("gender", "race", "ethnicity", "state", "year_of_birth")


def reports_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report from one pass over the patients, a row per line of a report."""
    return reports(star_tables(spark, sf_dir)).withColumn("year_of_birth", F.col("year_of_birth").cast("long"))


def _reports_sql() -> str:
    parts = []
    for cohort in COHORTS.values():
        if cohort.test == "report" and cohort.dims:
            shown = ", ".join(
                f"{_LABELS[d][0]} AS {d}" if d in cohort.dims else f"CAST(NULL AS {'BIGINT' if d == 'year_of_birth' else 'VARCHAR'}) AS {d}" for d in _DIMS
            )
            joins, groups = (" ".join(_LABELS[d][1] for d in cohort.dims), ", ".join(_LABELS[d][0] for d in cohort.dims))
            parts.append(f"SELECT '{cohort.id}' AS report, {shown}, COUNT(DISTINCT person_id) AS number_of_patients FROM person {joins} GROUP BY {groups}")
    return with_star(" UNION ALL ".join(parts))


def whole_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of all cohorts with their ids, a row per row of a result."""
    made, rows = dataset.dataset_parts(star_tables(spark, sf_dir))
    return made.join(rows, "id", "left").select("id", "cohort", "input", F.concat_ws("|", F.transform("row", lambda c: F.coalesce(c, F.lit("-")))).alias("result"))


def _whole_dataset_sql() -> str:
    """The items of every cohort by its own SQL, numbered in the order of cohorts and places."""
    parts = []
    for turn, cohort in enumerate(COHORTS.values()):
        if cohort.test == "report":
            columns = [*cohort.dims, "number_of_patients"]
            cells = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '-')" for c in columns)
            question = cohort.question.replace("'", "''")
            parts.append(f"SELECT {turn} AS turn, 1 AS place, '{cohort.id}' AS cohort, '{question}' AS input, concat_ws('|', {cells}) AS result FROM ({cohort_sql()[cohort.id]}) r{turn}")
        else:
            parts.append(f"SELECT {turn} AS turn, place, '{cohort.id}' AS cohort, input, result FROM ({_dataset_sql(cohort.id, by_row=True)}) r{turn}")
    every = " UNION ALL ".join(parts)
    return f"SELECT CAST(DENSE_RANK() OVER (ORDER BY turn, place) AS BIGINT) AS id, cohort, input, result FROM ({every}) q"


# --- grading ---------------------------------------------------------------------------------------


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer, with results of all shapes around its size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("n_chars").cast("string")
    shape = F.col("doc_id") % 7
    result = (
        F.when(shape == 0, F.concat(F.lit("[["), n, F.lit("]]")))
        .when(shape == 1, F.lit("[]"))
        .when(shape == 2, F.lit("[[0]]"))
        .when(shape == 3, F.concat(F.lit('[["a",1],["'), F.col("lang"), F.lit('",2]]')))
        .when(shape == 4, F.lit("[[1],[2],[3]]"))
        .when(shape == 5, F.lit("0"))
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("query_id"), F.col("source").alias("query"), F.col("text").alias("response"),
        result.alias("execution_result"),
    )


def order_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per order about its number of lines or its price: right, wrong, evasive and formatted."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem"))
    sizes = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = orders.join(sizes, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    price, shape, n = F.floor("o_totalprice"), F.col("o_orderkey") % 8, F.col("n")
    one = F.concat(F.lit("[["), n, F.lit("]]"))
    response = (
        F.when(shape == 0, F.concat(F.lit("There are "), n, F.lit(" patients.")))
        .when(shape == 1, F.concat(F.lit("Count: "), n + 1))
        .when(shape == 2, F.lit("I will look that up."))
        .when(shape == 3, F.lit("The query failed, 17 times."))
        .when(shape == 4, F.concat(F.lit("In total "), F.format_number(price, 0), F.lit(" patients")))
        .when(shape == 5, F.lit("Nobody knows."))
        .when(shape == 6, F.lit("It gave 2 rows"))
        .otherwise(n.cast("string"))
    )
    result = (
        F.when(shape.isin(0, 1, 2, 5), one)
        .when(shape == 3, F.lit("[]"))
        .when(shape == 4, F.concat(F.lit('[["x",'), price, F.lit('],["y",0]]')))
        .when(shape == 6, F.concat(F.lit("[["), n, F.lit("],["), price, F.lit("]]")))
    )
    return rows.select(
        F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_orderpriority").alias("query"),
        response.alias("response"), result.alias("execution_result"),
    )


# Expected value by shape, stated directly instead of being parsed from JSON.
_DOCUMENTS = (
    "answers AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS response, CASE doc_id % 7 WHEN 0 THEN NULLIF(n_chars, -1) WHEN 2 THEN 0 "
    "WHEN 3 THEN 3 WHEN 4 THEN 3 END AS expected FROM documents)"
)
_ORDERS = (
    "sized AS (SELECT o_orderkey, o_orderkey % 8 AS shape, CAST(floor(o_totalprice) AS BIGINT) AS price, "
    "(SELECT COUNT(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders), "
    "answers AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE shape WHEN 0 THEN 'There are ' || n || ' patients.' "
    "WHEN 1 THEN 'Count: ' || (n + 1) WHEN 2 THEN 'I will look that up.' WHEN 3 THEN 'The query failed, 17 times.' "
    "WHEN 4 THEN 'In total ' || format('{:,}', price) || ' patients' WHEN 5 THEN 'Nobody knows.' WHEN 6 THEN 'It gave 2 rows' "
    "ELSE CAST(n AS VARCHAR) END AS response, CASE WHEN shape IN (0, 1, 2, 5) THEN n WHEN shape = 4 THEN price WHEN shape = 6 THEN 2 END AS expected "
    "FROM sized)"
)
# The refusal phrases, spelled out for SQL.
_REFUSES = " OR ".join(
    "contains(lower(response), '{}')".format(p.replace("'", "''"))
    for p in ("failed", "error", "incorrect", "may not be correct", "i will", "i'll", "let me", "please provide", "i'm ready", "i can help")
)
_VERDICTS = (
    "nums AS (SELECT *, list_transform(regexp_extract_all(replace(response, ',', ''), '-?\\d+\\.?\\d*'), lambda x: CAST(x AS DOUBLE)) AS numbers, "
    f"({_REFUSES}) AS refusal FROM answers), "
    "near AS (SELECT *, list_filter(numbers, lambda x: abs(x - expected) <= 0.01) AS hits FROM nums), "
    "verdicts AS (SELECT id, CASE WHEN refusal AND len(numbers) = 0 THEN FALSE WHEN expected IS NULL THEN FALSE ELSE len(hits) > 0 END AS correct, "
    "CASE WHEN refusal AND len(numbers) = 0 THEN 'high' WHEN expected IS NULL THEN 'low' ELSE 'high' END AS confidence, "
    "CASE WHEN len(numbers) = 0 THEN NULL WHEN expected IS NOT NULL AND len(hits) > 0 THEN hits[1] ELSE numbers[1] END AS extracted_value, "
    "CASE WHEN refusal AND len(numbers) = 0 THEN 'The LLM''s response indicates an error or does not provide a numeric answer.' "
    "WHEN expected IS NULL THEN 'Could not extract expected value from execution result.' "
    "WHEN len(numbers) = 0 THEN 'The LLM''s response does not provide any numeric value. Expected: ' || expected || '.' "
    "WHEN len(hits) > 0 THEN 'The LLM correctly reported the value ' || CAST(hits[1] AS BIGINT) || '.0 which matches the execution result.' "
    "ELSE 'The LLM reported ' || CAST(numbers[1] AS BIGINT) || '.0 but the execution result was ' || expected || '.' END AS explanation FROM near)"
)
_SUMMARY = (
    "SELECT COUNT(*) AS total_entries, COUNT(*) AS total_evaluated, COUNT(*) FILTER (WHERE correct) AS correct_responses, "
    "COUNT(*) FILTER (WHERE NOT correct) AS incorrect_responses, CAST(0 AS BIGINT) AS evaluation_errors, "
    "COUNT(*) FILTER (WHERE correct) / COUNT(*) * 100 AS accuracy, COUNT(*) FILTER (WHERE confidence = 'high') AS high, "
    "COUNT(*) FILTER (WHERE confidence = 'medium') AS medium, COUNT(*) FILTER (WHERE confidence = 'low') AS low FROM verdicts"
)


def _flat(summary: DataFrame) -> DataFrame:
    return summary.select(*[c for c in summary.columns if c != "confidence_breakdown"], "confidence_breakdown.*")


def grade_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.grade(document_answers(spark, sf_dir)).select("id", "correct", "confidence", "extracted_value")


def grade_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.grade(order_answers(spark, sf_dir)).select("id", "correct", "confidence", "extracted_value", "explanation")


def summary_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(grading.summarise(grading.grade(order_answers(spark, sf_dir))))


def summary_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(grading.summarise(grading.grade(document_answers(spark, sf_dir))))


def wrong_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.incorrect(grading.grade(order_answers(spark, sf_dir))).select("id", "query", "response", "explanation")


WRONG_ORDERS = (
    f"WITH {_ORDERS}, {_VERDICTS} SELECT v.id, o_orderpriority AS query, a.response, v.explanation FROM verdicts v "
    "JOIN answers a ON a.id = v.id JOIN orders ON CAST(o_orderkey AS VARCHAR) = v.id WHERE NOT correct"
)


def outside_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels of documents as verdicts of an outside judge."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = labels.select(
        F.col("doc_id").cast("string").alias("query_id"), (F.col("quality") == 1).alias("correct"),
        F.when(F.col("toxic") == 1, "medium").otherwise("high").alias("confidence"),
        F.lit(None).cast("string").alias("extracted_value"), F.lit("label").alias("explanation"),
    )
    answers = document_answers(spark, sf_dir)
    return _flat(grading.summarise_outside(grading.outside_verdicts(answers, verdicts)))


OUTSIDE = (
    "WITH rows AS (SELECT d.doc_id % 7 IN (6) AS missing, COALESCE(l.quality = 1, FALSE) AS correct, "
    "CASE WHEN d.doc_id % 7 = 6 THEN 'low' WHEN l.toxic = 1 THEN 'medium' WHEN l.doc_id IS NOT NULL THEN 'high' END AS confidence "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) "
    "SELECT COUNT(*) AS total_entries, COUNT(*) FILTER (WHERE NOT missing) AS total_evaluated, "
    "COUNT(*) FILTER (WHERE correct AND NOT missing) AS correct_responses, COUNT(*) FILTER (WHERE NOT correct AND NOT missing) AS incorrect_responses, "
    "COUNT(*) FILTER (WHERE missing) AS evaluation_errors, "
    "COUNT(*) FILTER (WHERE correct AND NOT missing) / COUNT(*) FILTER (WHERE NOT missing) * 100 AS accuracy, "
    "COUNT(*) FILTER (WHERE confidence = 'high') AS high, COUNT(*) FILTER (WHERE confidence = 'medium') AS medium, "
    "COUNT(*) FILTER (WHERE confidence = 'low') AS low FROM rows"
)


def shown_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = document_answers(spark, sf_dir)
    return answers.select(
        F.col("query_id").alias("id"), grading.normalised("execution_result").alias("result"),
        grading.display("execution_result").alias("shown"),
    )


_RESULT = (
    "CASE doc_id % 7 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 2 THEN '0' WHEN 3 THEN '[[\"a\",1],[\"' || lang || '\",2]]' "
    "WHEN 4 THEN '[[1],[2],[3]]' WHEN 5 THEN '0' END"
)
SHOWN = f"SELECT CAST(doc_id AS VARCHAR) AS id, {_RESULT} AS result, COALESCE({_RESULT}, 'No results') AS shown FROM documents"


def queries() -> dict:
    out = {name: _set_query(*spec) for name, spec in _SET_QUERIES.items()}
    out |= {
        "CS6_trait_by_name": trait_by_name,
        "CS7_race_by_name_or_synonym": race_by_name_or_synonym,
        "G1_code_of_name": code_of_name,
        "R1_ranges_in_first_half": ranges_in_first_half,
    }
    out |= {f"G_dataset_{key}": _dataset_query(key) for key in DATASETS}
    out |= {"F_reports_together": reports_together, "G_dataset_all": whole_dataset}
    out |= {
        "E4_grade_documents": grade_documents,
        "E4_grade_orders": grade_orders,
        "E5_summary_of_documents": summary_of_documents,
        "E5_summary_of_orders": summary_of_orders,
        "E6_wrong_orders": wrong_orders,
        "E7_outside_summary": outside_summary,
        "E9_shown_results": shown_results,
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: _set_sql(*spec) for name, spec in _SET_QUERIES.items()}
    out |= {
        "CS6_trait_by_name": TRAIT_BY_NAME,
        "CS7_race_by_name_or_synonym": RACE_BY_NAME,
        "G1_code_of_name": CODE_OF_NAME,
        "R1_ranges_in_first_half": RANGES,
    }
    out |= {f"G_dataset_{key}": _dataset_sql(key) for key in DATASETS}
    out |= {"F_reports_together": _reports_sql(), "G_dataset_all": _whole_dataset_sql()}
    out |= {
        "E4_grade_documents": f"WITH {_DOCUMENTS}, {_VERDICTS} SELECT id, correct, confidence, extracted_value FROM verdicts",
        "E4_grade_orders": f"WITH {_ORDERS}, {_VERDICTS} SELECT * FROM verdicts",
        "E5_summary_of_documents": f"WITH {_DOCUMENTS}, {_VERDICTS} {_SUMMARY}",
        "E5_summary_of_orders": f"WITH {_ORDERS}, {_VERDICTS} {_SUMMARY}",
        "E6_wrong_orders": WRONG_ORDERS,
        "E7_outside_summary": OUTSIDE,
        "E9_shown_results": SHOWN,
    }
    return out
