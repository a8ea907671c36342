"""The clinical tables derived from the given star-schema tables, in Spark and in DuckDB SQL.

Both definitions use the same integer formulas. See FIXTURES.md for the roles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseweave.schema import TABLES, Tables, conform
from caseweave.storage import dealt_if_many, keep

DRUG, DRUG_CLASS, DRUG_SOURCE = 1_000_000, 2_000_000, 3_000_000
CONDITION, CONDITION_CLASS, CONDITION_GROUP = 4_000_000, 5_000_000, 6_000_000
LINES = {"parquet.block.size": 2 << 20}  # a table of one small file is still read by several tasks
GENDER, RACE, ETHNICITY = 8_000_000, 8_100_000, 8_200_000


def _concepts(df: DataFrame, cid, name, code, vocabulary, domain, standard="S", invalid=None) -> DataFrame:
    return df.select(
        cid.cast("long").alias("concept_id"),
        name.cast("string").alias("concept_name"),
        code.cast("string").alias("concept_code"),
        F.lit(vocabulary).alias("vocabulary_id"),
        F.lit(domain).alias("domain_id"),
        F.lit(standard).cast("string").alias("standard_concept"),
        (F.lit(None) if invalid is None else invalid).cast("string").alias("invalid_reason"),
    )


def _pairs(df: DataFrame, ancestor, descendant) -> DataFrame:
    return df.select(ancestor.cast("long").alias("ancestor_concept_id"), descendant.cast("long").alias("descendant_concept_id"))


EVENT_TABLES = {
    "drug_exposure": (
        f"(l_orderkey * 8 + l_linenumber) * 4194304 + (drug_concept_id - {DRUG}) AS drug_exposure_id",
        "person_id", "drug_concept_id", "shipped AS drug_exposure_start_date", "supplied AS drug_exposure_end_date",
    ),
    "drug_era": (
        "person_id", "drug_concept_id", "shipped AS drug_era_start_date",
        "CASE WHEN NOT open_ended THEN supplied ELSE shipped END AS drug_era_end_date",
    ),
    "condition_occurrence": ("person_id", "condition_concept_id", "diagnosed AS condition_start_date"),
    "condition_era": (
        "person_id", "condition_concept_id", "diagnosed AS condition_era_start_date", "date_add(diagnosed, 30) AS condition_era_end_date",
    ),
}


class StarTables(Tables):
    """The clinical tables, each written to the shared folder when a query first reads it.

    A query pays for the tables it reads. The four event tables are columns of one joined table of lines.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        frames = star_frames(spark, sf_dir)
        self.__dict__.update(_frames=frames, _locks={name: Lock() for name in (*frames, "lines")}, _made={})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name in EVENT_TABLES:
            return conform(name, self._once("lines", lambda: keep(_lines(self._frames), "lines", **LINES)).selectExpr(*EVENT_TABLES[name]))
        return self._once(name, lambda: keep(conform(name, self._frames[name]), name))

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._locks[name]:  # queries of several threads may ask for one table
            if name not in self._made:
                self._made[name] = make()
            return self._made[name]


@cache
def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The clinical tables, derived once per session and kept in the shared folder, as a warehouse would."""
    return StarTables(spark, sf_dir)


def star_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    part, supplier, nation, region = read("part"), read("supplier"), read("nation"), read("region")
    customer, orders, lineitem = read("customer"), read("orders"), read("lineitem")

    brand = F.substring("p_brand", 7, 10).cast("long")
    brands = part.select("p_brand", brand.alias("brand")).distinct()
    segments = customer.select("c_mktsegment").distinct()
    segment = F.ascii("c_mktsegment")

    ethnicities = region.filter("r_regionkey < 2")
    concept = reduce(
        DataFrame.unionByName,
        [
            _concepts(
                part, DRUG + F.col("p_partkey"), F.concat("p_name", F.lit(" #"), "p_partkey"), F.col("p_partkey"),
                "RxNorm", "Drug", invalid=F.when(F.col("p_partkey") % 50 == 7, "D"),
            ),
            _concepts(brands, DRUG_CLASS + F.col("brand"), F.col("p_brand"), F.col("p_brand"), "ATC", "Drug"),
            _concepts(
                brands, DRUG_SOURCE + F.col("brand"), F.concat("p_brand", F.lit(" label")), F.col("p_brand"),
                "SPL", "Drug", standard=None,
            ),
            _concepts(
                supplier, CONDITION + F.col("s_suppkey"), F.col("s_name"), F.col("s_suppkey"), "SNOMED", "Condition",
                invalid=F.when(F.col("s_suppkey") % 25 == 13, "U"),
            ),
            _concepts(
                nation, CONDITION_CLASS + F.col("n_nationkey"), F.col("n_name"), F.concat(F.lit("N"), "n_nationkey"),
                "SNOMED", "Condition",
            ),
            _concepts(
                region, CONDITION_GROUP + F.col("r_regionkey"), F.concat("r_name", F.lit(" group")),
                F.concat(F.lit("R"), "r_regionkey"), "ICD10CM", "Condition",
            ),
            _concepts(segments, GENDER + segment, F.col("c_mktsegment"), F.col("c_mktsegment"), "Gender", "Gender"),
            _concepts(region, RACE + F.col("r_regionkey"), F.col("r_name"), F.col("r_regionkey"), "Race", "Race"),
            _concepts(
                ethnicities, ETHNICITY + F.col("r_regionkey"), F.concat(F.lit("Ethnicity "), "r_regionkey"),
                F.col("r_regionkey"), "Ethnicity", "Ethnicity",
            ),
        ],
    )

    standard = concept.filter("standard_concept = 'S'").select("concept_id")
    relationship = (
        standard.select(F.col("concept_id").alias("concept_id_1"), F.col("concept_id").alias("concept_id_2"))
        .unionByName(
            brands.select((DRUG_SOURCE + F.col("brand")).alias("concept_id_1"), (DRUG_CLASS + F.col("brand")).alias("concept_id_2"))
        )
        .withColumn("relationship_id", F.lit("Maps to"))
        .withColumn("invalid_reason", F.when(F.col("concept_id_1") % 40 == 3, "D"))
    )

    ancestor = reduce(
        DataFrame.unionByName,
        [
            _pairs(standard.filter("concept_id % 30 != 11"), F.col("concept_id"), F.col("concept_id")),
            _pairs(part, DRUG_CLASS + brand, DRUG + F.col("p_partkey")),
            _pairs(supplier, CONDITION_CLASS + F.col("s_nationkey"), CONDITION + F.col("s_suppkey")),
            _pairs(nation, CONDITION_GROUP + F.col("n_regionkey"), CONDITION_CLASS + F.col("n_nationkey")),
            _pairs(
                supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")),
                CONDITION_GROUP + F.col("n_regionkey"), CONDITION + F.col("s_suppkey"),
            ),
        ],
    )

    person = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("person_id"),
        (1930 + F.col("c_custkey") % 80).alias("year_of_birth"),
        (GENDER + segment).alias("gender_concept_id"),
        (RACE + F.col("n_regionkey")).alias("race_concept_id"),
        (ETHNICITY + F.col("c_custkey") % 3).alias("ethnicity_concept_id"),
        F.col("c_nationkey").alias("location_id"),
    )
    location = nation.select(
        F.col("n_nationkey").alias("location_id"),
        F.when(F.col("n_nationkey") % 10 != 0, F.col("n_name")).alias("state"),
    )

    return (
        {
            "concept": concept,
            "concept_relationship": relationship,
            "concept_ancestor": ancestor,
            "concept_synonym": region.select(
                (RACE + F.col("r_regionkey")).alias("concept_id"),
                F.concat(F.lower("r_name"), F.lit(" people")).alias("concept_synonym_name"),
            ),
            "person": person,
            "location": location,
            "lineitem": lineitem,
            "orders": orders,
        }
    )


def _lines(frames: dict[str, DataFrame]) -> DataFrame:
    """Line items with their orders: what the event tables are columns of."""
    shipped = F.to_date("l_shipdate")
    open_ended = F.col("l_linestatus") == "O"
    items, amount = frames["lineitem"], frames["lineitem"].count()
    items = dealt_if_many(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linestatus"), amount, "l_orderkey")
    orders = dealt_if_many(frames["orders"].select("o_orderkey", "o_custkey", "o_orderdate"), amount, "o_orderkey")
    lines = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("person_id"),
        (DRUG + F.col("l_partkey")).alias("drug_concept_id"),
        (CONDITION + F.col("l_suppkey")).alias("condition_concept_id"),
        shipped.alias("shipped"),
        F.when(~open_ended, F.date_add(shipped, F.col("l_quantity").cast("int"))).alias("supplied"),
        open_ended.alias("open_ended"),
        F.to_date("o_orderdate").alias("diagnosed"),
        "l_orderkey",
        "l_linenumber",
    )


# The same tables as common table expressions for DuckDB.
STAR_SQL = """
brands AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS brand FROM part),
segments AS (SELECT DISTINCT c_mktsegment, ascii(c_mktsegment) AS letter FROM customer),
concept AS (
  SELECT CAST(1000000 + p_partkey AS BIGINT) AS concept_id, p_name || ' #' || p_partkey AS concept_name,
         CAST(p_partkey AS VARCHAR) AS concept_code, 'RxNorm' AS vocabulary_id, 'Drug' AS domain_id,
         'S' AS standard_concept, CASE WHEN p_partkey % 50 = 7 THEN 'D' END AS invalid_reason FROM part
  UNION ALL SELECT 2000000 + brand, p_brand, p_brand, 'ATC', 'Drug', 'S', NULL FROM brands
  UNION ALL SELECT 3000000 + brand, p_brand || ' label', p_brand, 'SPL', 'Drug', NULL, NULL FROM brands
  UNION ALL SELECT 4000000 + s_suppkey, s_name, CAST(s_suppkey AS VARCHAR), 'SNOMED', 'Condition', 'S',
         CASE WHEN s_suppkey % 25 = 13 THEN 'U' END FROM supplier
  UNION ALL SELECT 5000000 + n_nationkey, n_name, 'N' || n_nationkey, 'SNOMED', 'Condition', 'S', NULL FROM nation
  UNION ALL SELECT 6000000 + r_regionkey, r_name || ' group', 'R' || r_regionkey, 'ICD10CM', 'Condition', 'S', NULL FROM region
  UNION ALL SELECT 8000000 + letter, c_mktsegment, c_mktsegment, 'Gender', 'Gender', 'S', NULL FROM segments
  UNION ALL SELECT 8100000 + r_regionkey, r_name, CAST(r_regionkey AS VARCHAR), 'Race', 'Race', 'S', NULL FROM region
  UNION ALL SELECT 8200000 + r_regionkey, 'Ethnicity ' || r_regionkey, CAST(r_regionkey AS VARCHAR), 'Ethnicity', 'Ethnicity', 'S', NULL
         FROM region WHERE r_regionkey < 2
),
concept_relationship AS (
  SELECT concept_id_1, concept_id_2, 'Maps to' AS relationship_id,
         CASE WHEN concept_id_1 % 40 = 3 THEN 'D' END AS invalid_reason
  FROM (SELECT concept_id AS concept_id_1, concept_id AS concept_id_2 FROM concept WHERE standard_concept = 'S'
        UNION ALL SELECT 3000000 + brand, 2000000 + brand FROM brands) links
),
concept_ancestor AS (
  SELECT concept_id AS ancestor_concept_id, concept_id AS descendant_concept_id
  FROM concept WHERE standard_concept = 'S' AND concept_id % 30 <> 11
  UNION ALL SELECT 2000000 + CAST(substr(p_brand, 7) AS BIGINT), 1000000 + p_partkey FROM part
  UNION ALL SELECT 5000000 + s_nationkey, 4000000 + s_suppkey FROM supplier
  UNION ALL SELECT 6000000 + n_regionkey, 5000000 + n_nationkey FROM nation
  UNION ALL SELECT 6000000 + n_regionkey, 4000000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
concept_synonym AS (
  SELECT 8100000 + r_regionkey AS concept_id, lower(r_name) || ' people' AS concept_synonym_name FROM region
),
person AS (
  SELECT c_custkey AS person_id, 1930 + c_custkey % 80 AS year_of_birth, 8000000 + ascii(c_mktsegment) AS gender_concept_id,
         8100000 + n_regionkey AS race_concept_id, 8200000 + c_custkey % 3 AS ethnicity_concept_id, c_nationkey AS location_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
location AS (
  SELECT n_nationkey AS location_id, CASE WHEN n_nationkey % 10 <> 0 THEN n_name END AS state FROM nation
),
drug_exposure AS (
  SELECT (l_orderkey * 8 + l_linenumber) * 4194304 + l_partkey AS drug_exposure_id, o_custkey AS person_id,
         1000000 + l_partkey AS drug_concept_id, CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
         CASE WHEN l_linestatus <> 'O' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS drug_exposure_end_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
drug_era AS (
  SELECT person_id, drug_concept_id, drug_exposure_start_date AS drug_era_start_date,
         COALESCE(drug_exposure_end_date, drug_exposure_start_date) AS drug_era_end_date FROM drug_exposure
),
condition_occurrence AS (
  SELECT o_custkey AS person_id, 4000000 + l_suppkey AS condition_concept_id, CAST(o_orderdate AS DATE) AS condition_start_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
condition_era AS (
  SELECT person_id, condition_concept_id, condition_start_date AS condition_era_start_date,
         condition_start_date + 30 AS condition_era_end_date FROM condition_occurrence
)
"""
