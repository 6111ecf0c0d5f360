"""What is stored: appends, rejects, logs and exports."""

import os

from pyspark.sql import functions as F

from jobtide import storage
from jobtide.literals import BROADCAST_ROWS, literal_frame
from jobtide.sources import tables

KEYS = ["source_name", "external_id"]


def rows(spark, *values):
    return spark.createDataFrame(list(values), "source_name string, external_id string, title string").coalesce(1)


def test_append_keeps_the_first_and_stores_rejects(spark, tmp_path):
    path = str(tmp_path / "jobs")
    tables.append_idempotent(spark, rows(spark, ("a", "1", "first"), ("a", "1", "second"), ("a", None, "no key")), path, KEYS)
    tables.append_idempotent(spark, rows(spark, ("a", "1", "later"), ("b", "2", "new")), path, KEYS)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", "1", "first"), ("b", "2", "new")}
    assert [tuple(r) for r in spark.read.parquet(f"{path}_rejects").collect()] == [("a", None, "no key")]


def test_rejects_of_a_run_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "jobs")
    for _ in range(2):
        tables.append_idempotent(spark, rows(spark, ("a", "1", "x"), (None, "1", "no key")), path, KEYS, run_id="r1")
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(f"{path}_rejects").count() == 1


def test_source_log_of_a_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    status = spark.createDataFrame([("a", "success")], "source_name string, status string")
    for run in ("r1", "r2", "r1"):
        tables.append_source_log(status, path, run)
    assert spark.read.parquet(path).groupBy("run_id").count().where("count <> 1").isEmpty() and spark.read.parquet(path).count() == 2


def test_export_leaves_foreign_entries(spark, tmp_path):
    out = str(tmp_path / "star")
    os.makedirs(f"{out}/notes")
    one = spark.createDataFrame([("k", ["a", "b"])], "skill_key string, skills array<string>")
    tables.export_star(spark, {"dim_skill": one, "dim_role": one}, out)
    tables.export_star(spark, {"dim_skill": one}, out)
    assert sorted(os.listdir(out)) == ["dim_skill", "notes"]
    assert [tuple(r) for r in spark.read.csv(f"{out}/dim_skill", header=True).collect()] == [("k", "a|b")]


def test_literal_rows_have_no_limit(spark):
    many = literal_frame(spark, [(i,) for i in range(BROADCAST_ROWS + 1)], "i int")
    assert many.count() == BROADCAST_ROWS + 1
    assert literal_frame(spark, [], "i int").agg(F.count("i")).first()[0] == 0


def test_shared_folder_is_one_for_the_session(spark):
    assert storage.shared_dir(spark) == storage.shared_dir(spark)
    assert storage.scratch(spark, "x") != storage.scratch(spark, "x")
