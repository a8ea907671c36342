"""Clinical tables from files, from a lakehouse catalog and over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseweave.schema import TABLES, Tables

# Event tables are read in parallel slices of this column; the vocabulary and location have their own.
SLICE_COLUMNS = {
    "concept": "concept_id",
    "concept_relationship": "concept_id_1",
    "concept_ancestor": "descendant_concept_id",
    "concept_synonym": "concept_id",
    "location": "location_id",
}


def from_files(spark: SparkSession, path: str, fmt: str = "parquet", suffix: str | None = None, **options) -> Tables:
    """One file or folder per table below ``path``; ``suffix`` is what follows the table name there.

    The default suffix is ``.<fmt>``, as in ``path/person.parquet``; pass ``""`` for ``path/person``.
    """
    suffix = f".{fmt}" if suffix is None else suffix

    def read(table: str) -> DataFrame:
        reader = spark.read.options(**options)
        if fmt in ("csv", "json"):
            reader = reader.schema(TABLES[table])
        return reader.format(fmt).load(f"{path}/{table}{suffix}")

    return Tables.of({table: read(table) for table in TABLES})


def from_catalog(spark: SparkSession, catalog: str = "main", schema: str = "default") -> Tables:
    """Tables of a lakehouse catalog: ``catalog.schema.table``."""
    if not catalog or not schema:
        raise ValueError("both catalog and schema are needed")
    return Tables.of({table: spark.table(f"`{catalog}`.`{schema}`.`{table}`") for table in TABLES})


def from_database(
    spark: SparkSession, url: str, slices: int | None = None, schema: str | None = None, **options
) -> Tables:
    """Tables of a relational database, each read in ``slices`` parallel key ranges.

    The key range of a table comes from one MIN/MAX query that the database answers.
    """
    if not url:
        raise ValueError("a JDBC url is needed")
    slices = slices or spark.sparkContext.defaultParallelism

    def read(table: str) -> DataFrame:
        name = f"{schema}.{table}" if schema else table
        key = SLICE_COLUMNS.get(table, "person_id")
        base = spark.read.format("jdbc").option("url", url).options(**options)
        bounds = base.option("query", f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {name}").load().first()
        wanted = ", ".join(field.split()[0] for field in TABLES[table].split(", "))
        plain = base.option("dbtable", f"(SELECT {wanted} FROM {name}) src")
        if bounds is None or bounds["lo"] is None:
            return plain.load()
        return (
            plain.option("partitionColumn", key)
            .option("lowerBound", int(bounds["lo"]))
            .option("upperBound", int(bounds["hi"]) + 1)
            .option("numPartitions", slices)
            .load()
        )

    return Tables.of({table: read(table) for table in TABLES})


def events(tables: Tables, kind: str) -> DataFrame:
    """Clinical events in one shape: person_id, item, start, end (dates).

    ``kind``: drug, condition, drug_era or condition_era. Conditions have no end date.
    """
    if kind == "drug":
        df, item, start, end = tables.drug_exposure, "drug_concept_id", "drug_exposure_start_date", "drug_exposure_end_date"
    elif kind == "condition":
        df, item, start, end = tables.condition_occurrence, "condition_concept_id", "condition_start_date", None
    elif kind == "drug_era":
        df, item, start, end = tables.drug_era, "drug_concept_id", "drug_era_start_date", "drug_era_end_date"
    elif kind == "condition_era":
        df, item, start, end = (
            tables.condition_era, "condition_concept_id", "condition_era_start_date", "condition_era_end_date",
        )
    else:
        raise ValueError(f"unknown event kind: {kind}")
    return df.select(
        "person_id",
        F.col(item).alias("item"),
        F.col(start).alias("start"),
        (F.col(end) if end else F.lit(None).cast("date")).alias("end"),
    )
