"""Readers and writers: raw records, run snapshots, catalogs, warehouse tables, exports and logs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide import schemas, storage
from jobtide.literals import literal_frame
from jobtide.operators.kpis import run_summary
from jobtide.operators.trends import latest_per_group
from jobtide.values import catalogs, sources


# --- raw records --------------------------------------------------------------------------------

def read_raw(spark: SparkSession, path: str, payload: T.StructType) -> DataFrame:
    """Landed JSON lines with the declared payload; blank lines are skipped by the reader."""
    return spark.read.schema(schemas.raw_schema(payload)).json(path)


def write_raw(df: DataFrame, root: str, dataset: str, run_id: str) -> str:
    """Raw records of a run as JSON lines; writing a run again replaces it."""
    path = f"{root}/{dataset}"
    (
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false").partitionBy("run_id").json(path)
    )
    return f"{path}/run_id={run_id}"


# --- snapshots ----------------------------------------------------------------------------------

def write_snapshot(df: DataFrame, root: str, dataset: str, run_id: str) -> str:
    """One immutable snapshot per dataset and run; writing a run again replaces only that run."""
    path = f"{root}/{dataset}/run_id={run_id}"
    # the folder of the run itself: a snapshot without rows is one too, and replaces an earlier one
    df.drop("run_id").write.mode("overwrite").parquet(path)
    return path


#: Folder of the marks of published runs, beside the datasets of a snapshot root.
PUBLISHED, STAGED = "_published", "_staged"


def runs_of(spark: SparkSession, root: str, dataset: str) -> list[str]:
    """Run ids with a snapshot, from the partition names alone; where runs are published, the published ones only."""
    names = storage.children(spark, f"{root}/{dataset}")
    runs = [n.removeprefix("run_id=") for n in names if n.startswith("run_id=")]
    if not storage.exists(spark, f"{root}/{PUBLISHED}"):
        return runs
    published = set(storage.children(spark, f"{root}/{PUBLISHED}"))
    return [r for r in runs if f"run_id={r}" in published]


def withdraw_run(spark: SparkSession, root: str, run_id: str) -> None:
    """Make a run invisible before its snapshots are written: from here on until it is published, readers do not see it."""
    storage.make_folder(spark, f"{root}/{PUBLISHED}")
    storage.delete(spark, f"{root}/{PUBLISHED}/run_id={run_id}")


def publish_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Make a run visible in all datasets at once, if its output is complete; gives the check of the output.

    The check is written as the run's mark, which one rename puts in place. A run that lacks a dataset, or a column of
    one, is refused and stays invisible.
    """
    missing = []
    for name, (dataset, schema) in schemas.DATASETS.items():
        path = f"{root}/{dataset}/run_id={run_id}"
        if not storage.exists(spark, path):
            missing.append(name)
            continue
        # files of a snapshot without rows have a schema too
        lacking = set(schema.fieldNames()) - set(spark.read.parquet(path).columns) - {"run_id"}
        missing += [f"{name}.{c}" for c in sorted(lacking)]
    if missing:
        raise ValueError(f"run {run_id} is not published, it lacks {', '.join(missing)}")
    counts = [
        spark.read.parquet(f"{root}/{dataset}/run_id={run_id}").agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("name"), F.lit(dataset).alias("dataset"), F.lit(run_id).alias("run_id"), "records")
        for name, (dataset, _) in schemas.DATASETS.items()
    ]
    stage, mark = f"{root}/{STAGED}/run_id={run_id}", f"{root}/{PUBLISHED}/run_id={run_id}"
    report = reduce(DataFrame.unionByName, counts)
    report.write.mode("overwrite").json(stage)
    storage.make_folder(spark, f"{root}/{PUBLISHED}")
    storage.rename(spark, stage, mark)
    return spark.read.schema(report.schema).json(mark)


def _with_run(schema: T.StructType) -> T.StructType:
    fields = [f for f in schema.fields if f.name != "run_id"]
    return T.StructType([*fields, T.StructField("run_id", T.StringType())])


def read_history(spark: SparkSession, root: str, dataset: str, schema: T.StructType) -> DataFrame:
    """All snapshots of a dataset; columns a snapshot lacks are null."""
    runs = runs_of(spark, root, dataset)
    if not runs:
        return spark.createDataFrame([], _with_run(schema))
    history = spark.read.schema(_with_run(schema)).parquet(f"{root}/{dataset}")
    # partitions of runs that are not published are not opened
    return history.where(F.col("run_id").isin(runs)) if storage.exists(spark, f"{root}/{PUBLISHED}") else history


def read_latest(spark: SparkSession, root: str, dataset: str, schema: T.StructType) -> DataFrame:
    """The newest snapshot; the other partitions are not read.  No snapshot gives an empty frame."""
    runs = runs_of(spark, root, dataset)
    history = read_history(spark, root, dataset, schema)
    return history.where(F.col("run_id") == max(runs)) if runs else history


def load_outputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The latest snapshot of every dataset, and the whole trend history."""
    latest = {name: read_latest(spark, root, d, s) for name, (d, s) in schemas.DATASETS.items()}
    dataset, schema = schemas.DATASETS["skill_trends"]
    return {**latest, "trend_history": read_history(spark, root, dataset, schema)}


def dataset_status(spark: SparkSession, root: str) -> DataFrame:
    """Latest run and record count per dataset; datasets without a snapshot have neither."""
    parts = []
    for name, (dataset, schema) in schemas.DATASETS.items():
        runs = runs_of(spark, root, dataset)
        count = read_latest(spark, root, dataset, schema).agg(F.count(F.lit(1)).alias("records"))
        parts.append(count.select(
            F.lit(name).alias("name"), F.lit(dataset).alias("dataset"),
            F.lit(max(runs) if runs else None).cast("string").alias("latest_run_id"), "records",
        ))
    return reduce(DataFrame.unionByName, parts)


def health(spark: SparkSession, root: str) -> dict[str, object]:
    missing = [d for d, _ in schemas.DATASETS.values() if not runs_of(spark, root, d)]
    gap_runs = runs_of(spark, root, schemas.DATASETS["skill_gaps"][0])
    return {
        "status": "missing_data" if missing else "ok",
        "latest_run_id": max(gap_runs) if gap_runs else None,
        "missing_datasets": missing,
    }


# --- files handed over by people ----------------------------------------------------------------

def read_jobs_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Jobs from CSV files with a header; with multi_line quoted values may hold line ends, and a file is one split."""
    return spark.read.schema(schemas.JOB_CSV).csv(path, header=True, quote='"', escape='"', enforceSchema=False, multiLine=multi_line)


def read_courses_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Courses from CSV files with a header; with multi_line quoted values may hold line ends, and a file is one split."""
    return spark.read.schema(schemas.COURSE_CSV).csv(path, header=True, quote='"', escape='"', enforceSchema=False, multiLine=multi_line)


#: What a JSON text consists of besides plain characters: strings are entered and left, brackets nest.
_STRUCTURE = re.compile(r'["\\\\{}\[\]]')


class _Entries:
    """Cuts the objects out of a JSON array, or of JSON lines, that comes in pieces in their order.

    Only the object at hand is held. Entries that are no objects are passed over.
    """

    def __init__(self, path: str) -> None:
        self.path, self.parts, self.depth, self.base, self.text, self.escaped = path, [], 0, None, False, False

    def add(self, piece: str) -> Iterator[str]:
        if self.base is None:
            piece = piece.lstrip("\ufeff")
            first = piece.lstrip()[:1]
            if not first:
                return
            if first not in "[{":
                raise ValueError(f"a certification catalog must be a JSON array or lines of JSON objects: {self.path}")
            self.base = 1 if first == "[" else 0
        begin, skip = 0, -1
        if self.escaped:
            skip, self.escaped = 0, False
        for found in _STRUCTURE.finditer(piece):
            at, sign = found.start(), found.group()
            if at == skip:
                continue
            if sign == "\\":
                skip = at + 1
                self.escaped = skip == len(piece)
            elif sign == '"':
                self.text = not self.text
            elif not self.text and sign in "{[":
                if self.depth == self.base and sign == "{":
                    begin, self.parts = at, [""]
                self.depth += 1
            elif not self.text:
                self.depth -= 1
                if self.depth == self.base and sign == "}" and self.parts:
                    yield "".join(self.parts) + piece[begin : at + 1]
                    self.parts = []
        if self.parts:
            self.parts.append(piece[begin:])

    def end(self) -> Iterator[str]:
        """What the brace that ends a file's last piece closes; the reader does not tell whether there is one."""
        if self.parts:
            yield from self.add("}")


def read_certifications_json(spark: SparkSession, path: str) -> DataFrame:
    """Certifications from files with a JSON array each, or with an object a line; entries that are no objects are dropped.

    Files are read in pieces that end with a closing brace, as splits of any size; the pieces of a file are put in their
    order and its objects cut out one by one, so no file is in memory whole. A file that holds something else fails the job.
    """
    read = spark.read.option("lineSep", "}").text(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    ordered = read.select(*place, "value").repartition("file").sortWithinPartitions("file", "block", "at").select("file", "value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _Entries("")
        for batch in batches:
            out = []
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if entries.path == file:
                    out += entries.add("}")
                else:
                    out += entries.end()
                    entries = _Entries(file)
                out += entries.add(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["entry"])
        yield pa.RecordBatch.from_arrays([pa.array(list(entries.end()), pa.string())], ["entry"])

    found = ordered.mapInArrow(cut, "entry string").select(F.from_json("entry", schemas.CERTIFICATION).alias("c")).select("c.*")
    # an entry that does not parse has no field at all
    return found.where(F.coalesce(*[F.col(f).cast("string") for f in found.columns]).isNotNull())


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An exported table with its declared column types.  List columns come as text."""
    flat = T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in schema.fields
    ])
    return spark.read.schema(flat).csv(path, header=True, quote='"', escape='"', encoding="UTF-8")


# --- built-in catalogs --------------------------------------------------------------------------

_COURSE_TYPES = (
    "external_id string, title string, platform string, level string, rating double, duration_minutes int, "
    "description string, subjects string, roles string, products string, last_modified string, url string"
)
_JOB_TYPES = (
    "external_id string, title string, company string, location string, remote_type string, salary_min int, "
    "salary_max int, posted_at string, url string, description string"
)


def _strings(columns: Sequence[str]) -> str:
    return ", ".join(f"{c} string" for c in columns)


CATALOGS: dict[str, tuple[list, str]] = {
    "seed_job_postings": (catalogs.SEED_JOBS, _JOB_TYPES),
    "startup_data_jobs": (catalogs.STARTUP_JOBS, _JOB_TYPES),
    "enterprise_analytics_jobs": (catalogs.ENTERPRISE_JOBS, _JOB_TYPES),
    "seed_course_listings": (catalogs.SEED_COURSES, _COURSE_TYPES),
    "youtube_learning": (catalogs.VIDEO_COURSES, _COURSE_TYPES),
    "open_course_catalog": (catalogs.OPEN_COURSES, _COURSE_TYPES),
    "vendor_docs_catalog": (catalogs.VENDOR_COURSES, _COURSE_TYPES),
    "university_open_catalog": (catalogs.UNIVERSITY_COURSES, _COURSE_TYPES),
    "curriculum_tracks": (catalogs.CURRICULUM_TRACKS, _strings(catalogs.TRACK_COLUMNS)),
    "learning_topics": (catalogs.LEARNING_TOPICS, _strings(catalogs.TOPIC_COLUMNS)),
    "builtin_certifications": (
        catalogs.BUILTIN_CERTIFICATIONS,
        "skill string, certification_name string, provider string, level string, free_or_paid string, "
        "estimated_cost_usd double, target_roles string, url string, priority_score int",
    ),
    "supported_sources": (catalogs.SUPPORTED_SOURCES, _strings(catalogs.SUPPORTED_COLUMNS)),
    "source_confidence": (list(sources.SOURCE_CONFIDENCE.items()), "source_name string, source_confidence string"),
}


def reference_table(spark: SparkSession, name: str) -> DataFrame:
    if name not in CATALOGS:
        raise ValueError(f"unknown catalog {name!r}; there are {', '.join(sorted(CATALOGS))}")
    data, schema = CATALOGS[name]
    return literal_frame(spark, data, schema)


def raw_records(items: DataFrame, source_name: str, source_type: str, collected_at: str, payload: T.StructType) -> DataFrame:
    """Catalog or normalised rows wrapped as raw records; columns they lack are null."""
    fields = [
        (F.col(f.name) if f.name in items.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in payload.fields
    ]
    return items.select(
        F.lit(source_name).alias("source_name"), F.lit(source_type).alias("source_type"), F.col("url").alias("source_url"),
        F.lit(collected_at).cast("timestamp").alias("collected_at"), F.struct(*fields).alias("payload"),
    )


# --- source modes and status --------------------------------------------------------------------

def sources_of(mode: str, kind: str) -> tuple[str, ...]:
    """Ordered source names of a job or course mode."""
    modes = {"jobs": sources.JOB_MODES, "courses": sources.COURSE_MODES}[kind]
    chosen = mode.strip().lower()
    for aliases, names in modes.items():
        if chosen in aliases:
            return names
    known = ", ".join(aliases[0] for aliases in modes)
    raise ValueError(f"unsupported {kind} source mode {mode!r}; use one of {known}")


def union_sources(mode: str, kind: str, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Raw records of the mode's sources in order; sources without landed data are left out."""
    present = [frames[n] for n in sources_of(mode, kind) if n in frames]
    if not present:
        raise ValueError(f"no landed data for mode {mode!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def source_status(
    df: DataFrame,
    expected: Sequence[tuple[str, str]] | DataFrame,
    started_at,
    completed_at,
    failures: DataFrame | None = None,
) -> DataFrame:
    """One row per expected source: success with rows, empty without, failed where an error was handled.

    ``failures`` holds (source_name, error_type, error_message).
    """
    spark = df.sparkSession
    if not isinstance(expected, DataFrame):
        expected = literal_frame(spark, list(expected), "source_name string, source_type string")
    counts = df.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    if failures is None:
        failures = literal_frame(spark, [], "source_name string, error_type string, error_message string")
    joined = expected.join(counts, "source_name", "left").join(failures, "source_name", "left")
    failed = F.col("error_type").isNotNull()
    start, end = (F.lit(t).cast("timestamp") if isinstance(t, str) else t for t in (started_at, completed_at))
    return joined.select(
        "source_name", "source_type",
        F.when(failed, F.lit("failed")).when(F.col("n") > 0, F.lit("success")).otherwise(F.lit("empty")).alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("record_count"),
        start.alias("started_at"), end.alias("completed_at"),
        ((F.unix_millis(end) - F.unix_millis(start))).alias("duration_ms"),
        "error_type", F.substring("error_message", 1, 500).alias("error_message"),
    )


# --- warehouse ----------------------------------------------------------------------------------

def split_rejects(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a complete key, and the rows that lack part of it."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(complete), df.where(~complete)


def _cleaned(df: DataFrame) -> DataFrame:
    """NaN as null."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def new_rows(df: DataFrame, existing: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows whose key is complete and not stored yet, the first of each key, NaN stored as null.

    order says which row of a key is the first. Without it that is the order in which the rows of df stand,
    which is an order of the input only as long as df was not shuffled.
    """
    complete, _ = split_rejects(_cleaned(df), keys)
    numbered = complete.withColumn("_ordinal", F.monotonically_increasing_id() if order is None else order)
    return latest_per_group(numbered, list(keys), F.asc("_ordinal")).drop("_ordinal").join(existing.select(*keys), list(keys), "left_anti")


def _staged(spark: SparkSession, df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written once to the shared folder, since rows and rejects both come from them."""
    path = storage.scratch(spark, "batch")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def append_idempotent(
    spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], run_id: str | None = None, order: Column | None = None
) -> None:
    """Append the rows whose key is not stored yet to a table partitioned by run.

    Rows of one run are compared with that run's partition only.  Rows that lack part of the key go
    to ``<path>_rejects``; those of a run replace what an earlier attempt of it rejected. Without a run id nothing
    tells a repeated call from a new one, so its rejects are added again; :func:`append_batch` has a batch id.
    """
    batch = df if run_id is None else df.drop("run_id").withColumn("run_id", F.lit(run_id))
    if storage.exists(spark, path):
        existing = spark.read.schema(batch.schema).parquet(path)
        if run_id is not None:
            existing = existing.where(F.col("run_id") == run_id)
    else:
        existing = spark.createDataFrame([], batch.schema)
    ordinal = F.monotonically_increasing_id() if order is None else order
    staged, stage = _staged(spark, batch.withColumn("_order", ordinal))
    rows = new_rows(staged, existing, keys, F.col("_order")).drop("_order")
    writer = rows.write.mode("append")
    (writer.partitionBy("run_id") if "run_id" in rows.columns else writer).parquet(path)
    rejects = split_rejects(staged, keys)[1].drop("_order")
    if run_id is None:
        rejects.write.mode("append").parquet(f"{path}_rejects")
    else:
        _replace_run(rejects, f"{path}_rejects")
    storage.delete(spark, stage)


#: Parts of the keys that a table of batches has stored, by hash.
KEY_BUCKETS = 64


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")


def _batch_folder(path: str, batch_id: int | str) -> str:
    return f"{path}/batch={batch_id}"


def _batches(spark: SparkSession, path: str) -> set[str]:
    """Names of the batches that have a folder; nothing is opened."""
    return {n.removeprefix("batch=") for n in storage.children(spark, path) if n.startswith("batch=")}


#: Folders of keys merged from those of several batches, and marks of the batches that are in them.
_MERGED, _DONE = "merged-", "done="


def stored_keys(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType, batch_id: int | str, buckets: Sequence[int]) -> DataFrame:
    """The keys in these buckets that batches other than this one have stored.

    They come from ``<path>_keys``, which holds nothing but keys, by batch and bucket; buckets that are not asked for are not
    opened. A batch that was cut off between its rows and its keys has its keys read from the rows.
    """
    whole, index_path = T.StructType([schema[k] for k in keys]), f"{path}_keys"
    indexed = _batches(spark, index_path) - {str(batch_id)}
    merged = {n.removeprefix(_DONE) for n in storage.children(spark, index_path) if n.startswith(_DONE)}
    bare = _batches(spark, path) - indexed - merged - {str(batch_id)}
    out = spark.createDataFrame([], whole)
    wanted = F.col("bucket").isin([int(b) for b in buckets])
    if indexed:
        fields = T.StructType([*whole.fields, T.StructField("bucket", T.IntegerType())])
        index = spark.read.schema(fields).option("basePath", index_path).parquet(*[_batch_folder(index_path, b) for b in sorted(indexed)])
        out = out.unionByName(index.where(wanted).select(*keys))
    if bare:
        rows = spark.read.schema(whole).option("basePath", path).parquet(*[_batch_folder(path, b) for b in sorted(bare)])
        out = out.unionByName(rows.withColumn("bucket", _bucket(keys)).where(wanted).select(*keys))
    return out


def _brings_nothing(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], batch_id: int | str) -> bool:
    """Whether other batches have stored every whole key of these rows; their other columns are not computed for that."""
    if not {n for p in (path, f"{path}_keys") for n in _batches(spark, p)} - {str(batch_id)}:
        return False
    whole = split_rejects(df.select(*keys), keys)[0].distinct()
    held, stage = _staged(spark, whole.withColumn("_bucket", _bucket(keys)))
    buckets = sorted(r[0] for r in held.select("_bucket").distinct().collect())
    known = stored_keys(spark, path, keys, df.schema, batch_id, buckets)
    again = known.join(held.select(*keys), list(keys), "left_semi").distinct()
    nothing = held.select(*keys).join(again, list(keys), "left_anti").isEmpty()
    storage.delete(spark, stage)
    return nothing


def append_batch(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], batch_id: int | str, order: Column | None = None) -> None:
    """Append the rows of a numbered batch whose key no other batch has stored.

    Rows, their keys and the rejects of a batch have folders of their own, and a batch that comes again replaces them,
    so a replay adds nothing, neither rows nor rejects. A batch meets only the stored keys of its own buckets; a small one is
    sent to them (by Spark's size limit for broadcasts), so the stored keys are not shuffled. Of a batch without a new key, which
    its keys tell alone, only the rejects are computed.
    """
    ordinal = F.monotonically_increasing_id() if order is None else order
    cleaned = _cleaned(df)
    if _brings_nothing(spark, cleaned, path, keys, batch_id):
        cleaned = split_rejects(cleaned, keys)[1]
    staged, stage = _staged(spark, cleaned.withColumn("_order", ordinal).withColumn("_bucket", _bucket(keys)))
    complete, rejects = split_rejects(staged, keys)
    buckets = sorted(r[0] for r in complete.select("_bucket").distinct().collect())
    known = stored_keys(spark, path, keys, df.schema, batch_id, buckets)
    again = known.join(complete.select(*keys).distinct(), list(keys), "left_semi")
    rows = latest_per_group(complete, list(keys), F.asc("_order")).join(again.distinct(), list(keys), "left_anti").drop("_order", "_bucket")
    target = _batch_folder(path, batch_id)
    rows.write.mode("overwrite").parquet(target)
    written = spark.read.schema(df.schema).parquet(target).select(*keys).withColumn("bucket", _bucket(keys))
    written.repartition("bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(_batch_folder(f"{path}_keys", batch_id))
    rejects.drop("_order", "_bucket").write.mode("overwrite").parquet(_batch_folder(f"{path}_rejects", batch_id))
    storage.delete(spark, stage)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def compact_keys(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType, keep: Sequence[int | str] = ()) -> None:
    """One folder of keys in place of those of all batches, other than those to keep, so that their number does not grow for ever.

    Keep the newest batch of each stream, since it may come again. The merged folder is complete before the others go, and
    a mark stays for each of them; a key that stands in both for a while does no harm.
    """
    index_path = f"{path}_keys"
    old = sorted(_batches(spark, index_path) - {str(k) for k in keep})
    if len(old) < 2:
        return
    whole = T.StructType([*[schema[k] for k in keys], T.StructField("bucket", T.IntegerType())])
    every = spark.read.schema(whole).option("basePath", index_path).parquet(*[_batch_folder(index_path, b) for b in old]).select(*keys, "bucket").distinct()
    merged = _batch_folder(index_path, f"{_MERGED}{uuid.uuid4().hex[:12]}")
    every.repartition("bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(merged)
    for batch in old:
        if not batch.startswith(_MERGED):
            storage.make_folder(spark, f"{index_path}/{_DONE}{batch}")
        storage.delete(spark, _batch_folder(index_path, batch))


def _replace_run(rows: DataFrame, path: str) -> None:
    """Write rows partitioned by run; a run that is there already is replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def ensure_tables(spark: SparkSession, database: str = "market_intel", location: str | None = None) -> list[str]:
    """Create the warehouse tables, or add the columns an older table lacks; a new database may get a folder of its own."""
    place = "" if location is None else f" LOCATION '{location}'"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
    done = []
    for table, schema in schemas.WAREHOUSE_TABLES.items():
        name = f"{database}.{table}"
        fields = [f for f in schema.fields if f.name != "run_id"] + [T.StructField("loaded_at", T.TimestampType())]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, run_id STRING) USING parquet PARTITIONED BY (run_id)")
        present = set(spark.table(name).columns)
        missing = [f for f in fields if f.name not in present]
        if missing:
            added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in missing)
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({added})")
        done.append(name)
    return done


def load_table(spark: SparkSession, df: DataFrame, database: str, table: str, run_id: str | None = None) -> None:
    """Append new rows to a warehouse table, matching its columns; list columns stay arrays."""
    name = f"{database}.{table}"
    batch = df if run_id is None else df.drop("run_id").withColumn("run_id", F.lit(run_id))
    stored = spark.table(name)
    if run_id is not None:
        stored = stored.where(F.col("run_id") == run_id)
    rows = new_rows(batch, stored, schemas.WAREHOUSE_KEYS[table]).withColumn("loaded_at", F.current_timestamp())
    have = set(rows.columns)
    target = spark.table(name).schema
    rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields
    ]).write.mode("append").insertInto(name)


# --- exports and logs ---------------------------------------------------------------------------

def as_text_lists(df: DataFrame) -> DataFrame:
    """List columns as ``|``-joined text, as the file formats need them."""
    return df.select(*[F.concat_ws("|", c).alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])


STAR_TABLES = (
    "fact_job_skill_mentions", "fact_course_skill_coverage", "fact_skill_trend_history", "dim_skill", "dim_role", "dim_location", "dim_source", "dim_time",
    "mart_skill_opportunity", "mart_role_skill_demand", "mart_role_readiness_inputs", "fact_jobs", "fact_courses", "fact_certification_recommendations",
    "fact_quality_checks",
)


def export_star(spark: SparkSession, tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv") -> dict[str, str]:
    """Write every table below ``out_dir`` and remove star tables of an earlier export that are gone.

    Entries that are no table of the star are left alone.

    Each table keeps its partitions; large facts become several files instead of passing through
    one task.
    """
    for name in storage.children(spark, out_dir):
        if name in STAR_TABLES and name not in tables:
            storage.delete(spark, f"{out_dir}/{name}")
    written = {}
    for name, df in tables.items():
        path = f"{out_dir}/{name}"
        writer = as_text_lists(df).write.mode("overwrite")
        if fmt == "csv":
            writer.csv(path, header=True, quote='"', escape='"')
        else:
            writer.format(fmt).save(path)
        written[name] = path
    return written


def append_run_log(
    jobs: DataFrame, courses: DataFrame, gaps: DataFrame, trends: DataFrame, path: str, run_id: str, run_timestamp, warehouse: str
) -> None:
    _replace_run(run_summary(jobs, courses, gaps, trends, run_id, run_timestamp, warehouse), path)


def append_source_log(status: DataFrame, path: str, run_id: str) -> None:
    _replace_run(status.withColumn("run_id", F.lit(run_id)), path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
