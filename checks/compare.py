"""Run registered queries in Spark and DuckDB and compare the rows: python -m checks.compare SF_DIR [name part ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.registry import oracle_sql, queries

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(master: str = "local[8]") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName("caseweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str, DataFrame]:
    start = time.time()
    df = queries()[name](spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.2f}s", df
    start = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = normal(columns, cursor.fetchall())
    same = sorted(df.columns) == sorted(columns) and got == want
    text = f"{len(got)} / {len(want)} rows, spark {took:.2f}s, duckdb {time.time() - start:.2f}s"
    if not same:
        odd = [pair for pair in zip(got, want) if pair[0] != pair[1]][:2]
        text += f" columns {sorted(df.columns)} / {sorted(columns)} first differences {odd}"
    return same, text, df


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name in queries():
        if parts and not any(p in name for p in parts):
            continue
        try:
            same, text, _ = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            same, text = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if same else "BAD ", name, text, flush=True)
        if not same:
            bad.append(name)
    print(f"{len(bad)} differ: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
