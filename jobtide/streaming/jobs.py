"""Streaming forms of ingest and trend counting.

All of them run with ``availableNow`` by default: they take what has landed since the last run and
stop, which is how the recurring batch is scheduled.  Pass another trigger for a standing query.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from jobtide import schemas, storage
from jobtide.sources import tables

# Week windows are aligned to 1970-01-01, a Thursday; four days later is a Monday.
MONDAY_OFFSET = "4 days"


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).load(path)


def incremental_ingest(
    spark: SparkSession,
    raw_dir: str,
    payload: T.StructType,
    normalize: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    keys: Sequence[str] = ("source_name", "external_id"),
) -> StreamingQuery:
    """Clean newly landed raw files once.

    Each batch appends only keys that no other batch has stored, and has its rows, keys and rejects in folders named after
    the stream and the batch. So a batch that is replayed after a failure adds nothing, and a stream that starts over with an
    empty checkpoint is another stream, whose batches replace none of the first one's.
    """
    session, named = spark, {}

    def write(batch: DataFrame, number: int) -> None:
        name = named.setdefault("stream", stream_id(session, checkpoint))
        tables.append_batch(batch.sparkSession, normalize(batch), out, keys, f"{name}-{number}")

    stream = read_stream(spark, raw_dir, schemas.raw_schema(payload))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was made."""
    return json.loads(storage.read_text(spark, f"{checkpoint}/metadata"))["id"].replace("-", "")


def distinct_stream(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row per key; a key is remembered for as long as late rows are allowed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_skill_counts(
    stream: DataFrame, time: str, skill: str = "skill", width: str = "1 day", delay: str = "1 day", weight: Column | None = None
) -> DataFrame:
    """Records per skill and tumbling window; ``width="1 week"`` gives Monday weeks."""
    at = F.col(time)
    window = F.window(at, "7 days", "7 days", MONDAY_OFFSET) if width == "1 week" else F.window(at, width)
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    grouped = stream.withWatermark(time, delay).groupBy(window.alias("window"), F.col(skill).alias("skill"))
    return grouped.agg(counted.alias("job_count")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "skill", "job_count"
    )


def latest_run_per_week(stream: DataFrame, run: str, time: str, delay: str = "7 days") -> DataFrame:
    """Newest run of each Monday week."""
    window = F.window(F.col(time), "7 days", "7 days", MONDAY_OFFSET)
    newest = F.max(F.struct(F.col(time).alias("run_timestamp"), F.col(run).alias("run_id")))
    return stream.withWatermark(time, delay).groupBy(window.alias("window")).agg(newest.alias("newest")).select(
        F.col("window.start").alias("window_start"), "newest.run_id", "newest.run_timestamp"
    )


class LatestRun(StatefulProcessor):
    """Keeps the newest run of a week until the watermark has passed the week and the delay."""

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at timestamp, run string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        held = self.newest.get()
        new = max(((at, run) for part in rows for at, run in zip(part["at"], part["run"], strict=True)), default=None)
        if new is not None and (held is None or new > (pd.Timestamp(held[0]), held[1])):
            self.newest.update((new[0].to_pydatetime(), new[1]))
            if held is None:
                # the timer that ends the state is set once for each week
                self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + 7 * 86_400_000 + self.delay_ms)
            yield pd.DataFrame({"window_start": [key[0]], "run_id": [new[1]], "run_timestamp": [new[0]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_run_state(stream: DataFrame, run: str, time: str, delay: str = "7 days") -> DataFrame:
    """Newest run of each Monday week as keyed state, given out whenever it changes.

    Runs may come in any order; a run that is older than the watermark is dropped, and a week's state goes by a timer once
    the watermark is `delay` past its end. The windowed form keeps an aggregate for each window instead; this one
    puts out a week only when its newest run did change. Needs the RocksDB state store.
    """
    spark = stream.sparkSession
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != provider:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {provider}")
    milliseconds = spark.sql(f"SELECT CAST(1000 * (unix_timestamp(TIMESTAMP '2000-01-01' + INTERVAL {delay}) - unix_timestamp(TIMESTAMP '2000-01-01')) AS BIGINT)").first()[0]
    window = F.window(F.col(time), "7 days", "7 days", MONDAY_OFFSET)
    rows = stream.withWatermark(time, delay).select(F.col(time).alias("at"), F.col(run).alias("run"), window["start"].alias("window_start"))
    return rows.groupBy("window_start").transformWithStateInPandas(
        statefulProcessor=LatestRun(milliseconds), outputStructType="window_start timestamp, run_id string, run_timestamp timestamp",
        outputMode="Update", timeMode="EventTime",
    )


def write_updates(df: DataFrame, out: str, checkpoint: str, keys: Sequence[str], window: str = "window_start") -> StreamingQuery:
    """Merge the changed results of each batch into a table partitioned by the day on which their windows start.

    Only the days that a batch changes are read and written again; of the rows of a key the batch's own wins. A batch carries whole
    results, so one that is replayed writes the same days again and changes nothing.
    """

    def write(batch: DataFrame, _number: int) -> None:
        spark, folder = batch.sparkSession, storage.scratch(batch.sparkSession, "updates")
        fresh = batch.withColumn("window_day", F.to_date(window))
        fresh.write.parquet(f"{folder}/batch")
        fresh = spark.read.schema(fresh.schema).parquet(f"{folder}/batch")
        days = [r[0] for r in fresh.select("window_day").distinct().collect()]
        if not days:
            return
        rows = fresh
        if storage.exists(spark, out):
            held = spark.read.schema(fresh.schema).parquet(out).where(F.col("window_day").isin(days))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"h.{k}").eqNullSafe(F.col(f"f.{k}"))
            kept = held.alias("h").join(fresh.select(*keys).alias("f"), same, "left_anti").select(*fresh.columns)
            rows = fresh.unionByName(kept)
        # days are not read and replaced in one job
        rows.write.parquet(f"{folder}/merged")
        merged = spark.read.schema(fresh.schema).parquet(f"{folder}/merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_day").parquet(out)
        storage.delete(spark, folder)

    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_updates(spark: SparkSession, out: str) -> DataFrame:
    """Current results."""
    return spark.read.parquet(out).drop("window_day")


def append_rows(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
