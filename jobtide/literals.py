"""DataFrames made from literals that belong to the program, not to the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BROADCAST_ROWS = 10_000


def literal_frame(spark: SparkSession, data: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A one-partition DataFrame of rows given by the caller.

    Up to ``BROADCAST_ROWS`` rows carry a broadcast hint; beyond that the optimizer chooses the join.
    """
    frame = spark.createDataFrame(list(data), schema).coalesce(1)
    return frame.hint("broadcast") if len(data) <= BROADCAST_ROWS else frame
