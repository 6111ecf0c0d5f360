"""Session settings for jobs that start their own session."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # recording a call site per column expression costs more than planning a small query
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
LOCAL_SETTINGS = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}


def session(app: str = "jobtide", master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with UTC times and adaptive execution.

    The number of shuffle partitions is left to the cluster unless given; adaptive execution merges
    small ones, so it should be sized for the largest shuffle.
    """
    builder = SparkSession.builder.appName(app)
    merged = dict(SETTINGS)
    if master is not None:
        builder = builder.master(master)
        merged.update(LOCAL_SETTINGS)
    if partitions is not None:
        merged["spark.sql.shuffle.partitions"] = str(partitions)
    for name, value in {**merged, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
