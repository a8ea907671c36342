import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[2]))

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
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with the other columns and some that could clash."""

    def make(rows):
        full = [(i, text, "en", "src0", None if text is None else len(text), 1, 2.0) for i, text in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept int, tokens double")

    return make


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (None, "no id"), (6, "é " * 3), (7, "tie tie tie tie tie tie"), (7, "tie tie tie tie tie tie"), (8, "x" * 20000 + " " + "long word " * 5000)]


@pytest.fixture
def odd(documents):
    return documents(ODD)
