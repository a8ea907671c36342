import datetime
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))

from caseweave.schema import TABLES, Tables, columns  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("caseweave-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def star(spark):
    from checks.starviews import star_tables

    return star_tables(spark, SF)


def day(n: int) -> datetime.date:
    """Day n of a made-up calendar."""
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def concept(cid, name, domain="Condition", vocabulary="SNOMED", code=None, standard="S", invalid=None):
    return (cid, name, code or str(cid), vocabulary, domain, standard, invalid)


@pytest.fixture
def tiny(spark):
    """Make tables from a few rows; tables that are not given are empty."""

    def make(**rows) -> Tables:
        frames = {}
        for table in TABLES:
            schema = ", ".join(f"{name} {kind}" for name, kind in columns(table))
            frames[table] = spark.createDataFrame(rows.get(table, []), schema)
        return Tables.of(frames)

    return make


def self_links(ids):
    """'Maps to' rows and self rows of the hierarchy for standard concepts."""
    return (
        [(i, i, "Maps to", None) for i in ids],
        [(i, i) for i in ids],
    )


@pytest.fixture
def instances(spark):
    """Instances of SNOMED or RxNorm codes: instances([(1, ["10", "11"], None)])."""

    def make(rows, vocabulary="SNOMED"):
        schema = "instance_id long, codes array<struct<vocabulary_id: string, concept_code: string>>, value string"
        return spark.createDataFrame([(i, [(vocabulary, c) for c in codes], value) for i, codes, value in rows], schema)

    return make


def numbers(df):
    """instance_id -> number_of_patients"""
    return {r["instance_id"]: r["number_of_patients"] for r in df.collect()}
