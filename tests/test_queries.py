"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
NAMES = (
    "skill_extract", "skill_counts", "salary_baseline", "score_functions", "normalize_jobs", "normalize_courses", "normalize_credentials", "html_to_text",
    "remote_type", "hiring_fields", "stable_id", "salary_parse", "dim_role", "dim_skill", "trend_history", "weekly_runs", "dedupe_first", "filter_jobs", "filter_gaps",
)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sql, name):
    got = entry.queries()[name](spark, SF)
    want = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_one_role_has_one_key(spark):
    roles = entry.queries()["dim_role"](spark, SF)
    assert roles.count() == roles.select("role_key").distinct().count() == roles.select("role_name").distinct().count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
