from unittest import mock

import pytest

from caseweave.schema import TABLES, Tables, conform
from caseweave.sources import readers


def test_files(spark, star, tmp_path):
    for table in TABLES:
        getattr(star, table).limit(50).write.parquet(str(tmp_path / "plain" / table))
        getattr(star, table).limit(50).write.csv(str(tmp_path / "text" / f"{table}.csv"), header=True)
    plain = readers.from_files(spark, str(tmp_path / "plain"), suffix="")
    text = readers.from_files(spark, str(tmp_path / "text"), "csv", header=True)
    for table in TABLES:
        assert getattr(plain, table).schema == getattr(text, table).schema
        assert sorted(getattr(plain, table).collect(), key=repr) == sorted(getattr(text, table).collect(), key=repr)


def test_catalog(spark, star):
    spark.sql("CREATE DATABASE IF NOT EXISTS clinic")
    for table in TABLES:
        getattr(star, table).limit(5).write.mode("overwrite").saveAsTable(f"clinic.{table}")
    tables = readers.from_catalog(spark, "spark_catalog", "clinic")
    assert tables.person.count() == 5
    with pytest.raises(ValueError):
        readers.from_catalog(spark, "spark_catalog", "")


def test_database_reads_in_slices():
    """The options of a JDBC read; no database is opened."""
    spark, reader = mock.MagicMock(), mock.MagicMock()
    spark.read.format.return_value = reader
    reader.option.return_value = reader.options.return_value = reader
    reader.load.return_value.first.return_value = {"lo": 3, "hi": 90}
    with mock.patch.object(Tables, "of", side_effect=lambda frames: frames):
        frames = readers.from_database(spark, "jdbc:postgresql://host/db", slices=7, schema="cdm", user="u")
    assert set(frames) == set(TABLES)
    asked = [c.args for c in reader.option.call_args_list]
    assert ("partitionColumn", "person_id") in asked and ("partitionColumn", "concept_id") in asked
    assert ("lowerBound", 3) in asked and ("upperBound", 91) in asked and ("numPartitions", 7) in asked
    assert any(a[0] == "query" and "FROM cdm.drug_exposure" in a[1] for a in asked)
    with pytest.raises(ValueError):
        readers.from_database(spark, "")


def test_missing_columns_and_tables(spark, star):
    with pytest.raises(ValueError, match="lacks columns: state"):
        conform("location", star.location.drop("state"))
    with pytest.raises(ValueError, match="missing tables: person"):
        Tables.of({t: getattr(star, t) for t in TABLES if t != "person"})


def test_timestamps_become_dates(spark):
    df = spark.sql("SELECT 1 AS person_id, 2 AS condition_concept_id, timestamp'2020-01-02 03:04:05' AS condition_start_date")
    assert dict(conform("condition_occurrence", df).dtypes) == {
        "person_id": "bigint", "condition_concept_id": "bigint", "condition_start_date": "date",
    }


def test_event_kinds(star):
    for kind in ("drug", "condition", "drug_era", "condition_era"):
        assert readers.events(star, kind).columns == ["person_id", "item", "start", "end"]
    with pytest.raises(ValueError):
        readers.events(star, "visit")


def test_kept_tables_go_when_dropped(spark, tmp_path, monkeypatch):
    from caseweave import storage

    monkeypatch.setattr(storage, "kept_folder", lambda session: str(tmp_path / "kept"))
    kept = storage.keep(spark.range(5), "numbers")
    assert kept.count() == 5 and (tmp_path / "kept").is_dir()
    storage.drop_kept(spark)
    assert not (tmp_path / "kept").exists()
