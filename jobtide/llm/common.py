"""What the operators of this package share: sessions, stored tables and document keys."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import storage

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """Python workers find this package, and get batches of few rows since texts may be long."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = storage.scratch(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the table does not have, whatever the letter case."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n
