"""Intermediate tables in the shared folder of the cluster.

An event table that a query reads several times is written once and read back. This cuts the
lineage, survives the loss of executors, and gives the optimizer real file sizes to choose joins by.
All tables of an application lie in one folder of its own there; ``drop_kept`` removes it when their
results have been written.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own, until it ends."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="caseweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


def kept_folder(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_folder(spark)}/kept-{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as a new parquet table in the application's folder, with options of the writer, and read it back."""
    spark = df.sparkSession
    path = f"{kept_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def many_parts(spark: SparkSession, amount: float, per_task: int = ROWS_PER_TASK) -> int:
    """The partitions that leave a task ``per_task`` of ``amount`` on average; 0 if the session's usual number does."""
    parts = -(-int(amount or 0) // per_task)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def dealt_out(df: DataFrame, amount: float, *columns: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows by hash of columns, in so many partitions that memory of a task does not grow with the table."""
    parts = many_parts(df.sparkSession, amount, per_task)
    return df.repartition(parts, *columns) if parts else df.repartition(*columns)


def dealt_if_many(df: DataFrame, amount: float, *columns: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same before an aggregation by (at least) these columns; few rows are left as they are, to be combined first."""
    parts = many_parts(df.sparkSession, amount, per_task)
    return df.repartition(parts, *columns) if parts else df


def drop_kept(spark: SparkSession) -> None:
    """Remove all kept tables of this application; results that read them must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(kept_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
