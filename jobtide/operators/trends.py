"""Trend history and the series derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions import roles as rl
from jobtide.functions.scalars import monday, number, numeric, parse_time, run_timestamp
from jobtide.functions.text import blank_to_null
from jobtide.operators.gaps import explode_skills, skill_counts

TREND_COLUMNS = (
    "run_id run_timestamp source_name skill job_count course_count salary_min_avg salary_max_avg location "
    "role_category role_family"
).split()


def skill_trend_history(jobs: DataFrame, courses: DataFrame, run_id: str | Column) -> DataFrame:
    """Job counts and average salaries per run, source, skill, location and role.

    Course counts depend on the skill alone, so they are joined to the grouped rows rather than to
    the exploded ones.
    """
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    # the title is only looked at where role columns are missing, as it costs a rule chain per row; the chain stands within a
    # function over an array, or the code generated for the whole step is too long for the JVM to compile
    number_of = F.element_at(F.transform(F.array(F.col("title")), lambda title: rl.role_number(title)), 1)
    role = blank_to_null(F.col("role_category"))
    family = blank_to_null(F.col("role_family"))
    if "title" in jobs.columns:
        role = F.when(role.isNull(), rl.role_name(number_of)).otherwise(role)
        family = F.when(family.isNull(), rl.role_family(number_of)).otherwise(family)
    exploded = explode_skills(
        jobs,
        run.alias("run_id"),
        F.coalesce(blank_to_null(F.col("source_name")), F.lit("unknown")).alias("source_name"),
        F.coalesce(blank_to_null(F.col("location")), F.lit("Unknown")).alias("location"),
        role.alias("role_category"),
        family.alias("role_family"),
        numeric(jobs, "salary_min").alias("salary_min"),
        numeric(jobs, "salary_max").alias("salary_max"),
    )
    grouped = exploded.groupBy("run_id", "source_name", "skill", "location", "role_category", "role_family").agg(
        F.count(F.lit(1)).alias("job_count"),
        F.bround(F.avg("salary_min"), 2).alias("salary_min_avg"),
        F.bround(F.avg("salary_max"), 2).alias("salary_max_avg"),
    )
    return (
        grouped.join(skill_counts(courses, "course_count"), "skill", "left")
        .withColumns(
            {
                "course_count": F.coalesce("course_count", F.lit(0).cast("long")),
                "run_timestamp": run_timestamp(F.col("run_id")),
            }
        )
        .select(*TREND_COLUMNS)
    )


def snapshot(trends: DataFrame, *keys: str) -> DataFrame:
    """Per key and skill: total jobs, most courses, role families of the rows."""
    families = F.array_distinct(
        F.flatten(F.transform(F.collect_set("role_family"), lambda f: F.transform(F.split(f, r"\|"), lambda p: F.trim(p))))
    )
    return trends.groupBy(*keys, "skill").agg(
        F.sum(F.coalesce(number(F.col("job_count")), F.lit(0.0))).cast("long").alias("job_count"),
        F.max(F.coalesce(number(F.col("course_count")), F.lit(0.0))).cast("long").alias("course_count"),
        F.array_join(F.array_sort(F.filter(families, lambda f: f != "")), " | ").alias("role_families"),
    )


def _pivot(trends: DataFrame, key: Column, name: str, skills: Sequence[str]) -> DataFrame:
    chosen = trends.where(F.col("skill").isin(*skills)).withColumn(name, key)
    wide = chosen.groupBy(name).pivot("skill", list(skills)).agg(F.sum("job_count"))
    return wide.na.fill(0).orderBy(name)


def trend_pivot(trends: DataFrame, skills: Sequence[str]) -> DataFrame:
    """Jobs per run time, one column per skill."""
    return _pivot(trends, F.col("run_timestamp"), "run_timestamp", skills)


def weekly_pivot(trends: DataFrame, skills: Sequence[str]) -> DataFrame:
    """Jobs per Monday week, one column per skill; empty unless the history spans seven days."""
    at = parse_time(F.col("run_timestamp"))
    span = trends.agg(
        F.coalesce(F.floor((F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))) / 86400), F.lit(0))
    ).scalar()
    return _pivot(trends, monday(at), "week", skills).where(span >= 7)


def daily_series(trends: DataFrame, skills: Sequence[str], last: int = 30) -> DataFrame:
    """Jobs per calendar date, one column per skill, for the last dates seen."""
    wide = _pivot(trends, F.substring(F.col("run_timestamp").cast("string"), 1, 10), "date", skills)
    return wide.orderBy(F.desc("date")).limit(last).orderBy("date")


def run_skill_rollup(trends: DataFrame) -> DataFrame:
    """Sources, locations and roles folded into one row per run and skill."""
    return trends.groupBy("run_id", "skill").agg(
        F.min("run_timestamp").alias("run_timestamp"),
        F.sum("job_count").alias("job_count"),
        F.max("course_count").alias("course_count"),
    ).withColumns(
        {
            "source_name": F.lit("all"),
            "location": F.lit("All locations"),
            "role_category": F.lit("All technology roles"),
        }
    )


def trend_extent(trends: DataFrame) -> DataFrame:
    """First run time and the number of role categories and locations."""
    return trends.agg(
        F.min(parse_time(F.col("run_timestamp"))).alias("first_snapshot"),
        F.count_distinct(blank_to_null(F.col("role_category"))).alias("role_categories"),
        F.count_distinct(blank_to_null(F.col("location"))).alias("locations"),
    )


def rising_skills(trends: DataFrame) -> DataFrame:
    """Number of skills with more jobs in the newest run than in the run before; 0 with one run."""
    at = F.col("run_timestamp")
    newest = trends.agg(F.max(at)).scalar()
    before = trends.where(at < newest).agg(F.max(at)).scalar()
    per_skill = trends.where((at == newest) | (at == before)).groupBy("skill_key").agg(
        F.sum(F.when(at == newest, F.col("job_count"))).alias("now"),
        F.sum(F.when(at == before, F.col("job_count"))).alias("then"),
        F.max(F.when(at == before, F.lit(1))).alias("had"),
    )
    risen = F.col("now") > F.coalesce("then", F.lit(0))
    return per_skill.agg(
        F.when(F.max("had").isNull(), F.lit(0)).otherwise(F.count_if(risen)).cast("long").alias("rising_skills")
    )


def latest_per_group(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """First row per key in the given order.

    Written as ``row_number() = 1``: Spark keeps one row per key and task before the shuffle, so a
    key with very many copies does not reach one task whole.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")
