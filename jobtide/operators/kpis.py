"""Key figures, summaries and run statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import iso_offset, number, parse_time
from jobtide.operators.enrich import role_family_frame
from jobtide.operators.filters import contains_text, filter_courses, filter_jobs, head
from jobtide.operators.gaps import explode_skills


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row frames in one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def coverage() -> Column:
    """Share of rows with at least one skill, four decimals; 0 for an empty table."""
    covered = F.when(F.coalesce(number(F.col("skill_count")), F.lit(0.0)) > 0, 1.0).otherwise(0.0)
    return F.coalesce(F.bround(F.avg(covered), 4), F.lit(0.0))


def top_value(value: str, by: str, ascending: bool = False, tie: str | None = None) -> Column:
    """Value of the row that sorts first; ties go to the smaller value."""
    tie = tie or value
    if ascending:
        return F.min_by(value, F.struct(F.col(by), F.col(tie)))
    return F.min_by(value, F.struct((-F.col(by)).alias("a"), F.col(tie).alias("b")))


def kpis(
    jobs: DataFrame, courses: DataFrame, gaps: DataFrame, trends: DataFrame, quality: DataFrame, run_id: str | None = None
) -> DataFrame:
    """The key figures in one row.  Each table is read once."""
    return one_row(
        jobs.agg(F.count(F.lit(1)).alias("job_postings"), coverage().alias("job_skill_coverage")),
        courses.agg(F.count(F.lit(1)).alias("course_listings"), coverage().alias("course_skill_coverage")),
        gaps.agg(
            F.count_distinct("skill").alias("unique_skills"),
            F.count_if(F.col("status") == "High opportunity").alias("high_opportunity_skills"),
            F.count_if(F.col("opportunity_label") == "High-value").alias("high_value_skills"),
            top_value("skill", "opportunity_index").alias("top_opportunity_skill"),
            top_value("skill", "gap_score").alias("top_gap_skill"),
            top_value("skill", "gap_score", ascending=True).alias("top_course_heavy_skill"),
        ),
        trends.agg(
            F.count(F.lit(1)).alias("trend_snapshot_rows"), F.count_distinct("run_id").alias("historical_runs_available")
        ),
        quality.agg(F.count_if(F.col("status").isin("warning", "fail")).alias("quality_warnings")),
    ).withColumn("run_id", F.lit(run_id).cast("string"))


def skill_coverage(df: DataFrame) -> DataFrame:
    return df.agg(coverage().alias("coverage"))


def source_summary(jobs: DataFrame, courses: DataFrame) -> DataFrame:
    """Records per dataset, source and confidence label."""

    def part(df: DataFrame, name: str) -> DataFrame:
        label = F.col("source_confidence") if "source_confidence" in df.columns else F.lit("unclassified")
        return (
            df.select(F.lit(name).alias("dataset"), "source_name", label.alias("source_confidence"))
            .groupBy("dataset", "source_name", "source_confidence")
            .agg(F.count(F.lit(1)).alias("record_count"))
        )

    return part(jobs, "jobs").unionByName(part(courses, "courses"))


def source_totals(summary: DataFrame) -> DataFrame:
    def total(dataset: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("dataset") == dataset, F.col("record_count"))), F.lit(0)).cast("long")

    return summary.agg(
        total("jobs").alias("job_records"),
        total("courses").alias("course_records"),
        F.count_if(F.col("source_confidence") == "live_verified").alias("live_verified"),
        F.count(F.lit(1)).alias("sources"),
    )


def role_family_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per role family, families without jobs included."""
    counts = jobs.groupBy("role_family").agg(F.count(F.lit(1)).alias("job_count"))
    families = role_family_frame(jobs.sparkSession)
    return counts.join(families, "role_family", "full").select(
        "role_family", F.coalesce("job_count", F.lit(0)).alias("job_count"), "position"
    ).orderBy(F.asc_nulls_last("position"), "role_family").drop("position")


def quality_score(checks: DataFrame) -> DataFrame:
    """Passed checks, failed records, datasets, and the pass rate rounded half up."""
    passed = F.count_if(F.col("status") == "pass")
    return checks.agg(
        passed.alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.coalesce(F.sum("failed_count"), F.lit(0)).cast("long").alias("failed_records"),
        F.count_distinct("dataset").alias("datasets"),
        F.coalesce(F.floor(passed * 100 / F.nullif(F.count(F.lit(1)), F.lit(0)) + 0.5), F.lit(0)).cast("long").alias("score"),
    )


def source_failures(source_runs: DataFrame, run_id: str) -> DataFrame:
    return source_runs.where(F.col("run_id").cast("string") == run_id).agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(F.col("status") == "failed").alias("failed")
    )


def run_summary(
    jobs: DataFrame, courses: DataFrame, gaps: DataFrame, trends: DataFrame, run_id: str, run_timestamp, warehouse: str
) -> DataFrame:
    """The run-log row of a pipeline run."""
    row = one_row(
        jobs.agg(F.count(F.lit(1)).alias("job_records")),
        courses.agg(F.count(F.lit(1)).alias("course_records")),
        gaps.agg(
            F.count_distinct("skill").alias("unique_skills"),
            F.min_by(
                "skill",
                F.struct(
                    (-F.col("opportunity_index")).alias("a"), (-F.col("gap_score")).alias("b"),
                    (-F.col("job_demand")).alias("c"), F.col("skill").alias("d"),
                ),
            ).alias("top_opportunity_skill"),
        ),
        trends.agg(F.count(F.lit(1)).alias("trend_rows")),
    )
    return row.select(
        F.lit(run_id).alias("run_id"), F.lit(run_timestamp).cast("timestamp").alias("run_timestamp"), "job_records",
        "course_records", "unique_skills", "trend_rows", "top_opportunity_skill", F.lit(warehouse).alias("warehouse"),
    )


def scheduler_view(runs: DataFrame, interval_minutes: int = 1440) -> DataFrame:
    """Latest run and the time the next one is due."""
    latest = F.max(parse_time(F.col("run_timestamp")))
    return runs.agg(latest.alias("latest")).select(
        F.lit(interval_minutes).alias("interval_minutes"),
        iso_offset(F.col("latest")).alias("latest_run_timestamp"),
        iso_offset(F.col("latest") + F.make_dt_interval(mins=F.lit(interval_minutes))).alias("estimated_next_run"),
    )


def skill_profile(skill: str, jobs: DataFrame, courses: DataFrame, gaps: DataFrame, samples: int = 10) -> dict[str, DataFrame]:
    """Gap row, counts and samples of one skill.

    The gap row is the exact skill where there is one, else the first that contains the text.
    Counts cover all rows; the samples are the first `samples` rows.
    """
    exact = F.lower("skill") == skill.lower()
    gap = contains_text(gaps, "skill", skill).orderBy(
        F.desc(exact), F.desc("opportunity_index"), F.desc("gap_score"), F.desc("job_demand"), F.asc("skill")
    ).limit(1)
    found_jobs, found_courses = filter_jobs(jobs, skill=skill, limit=None), filter_courses(courses, skill=skill, limit=None)
    counts = one_row(
        found_jobs.agg(F.count(F.lit(1)).alias("job_count")),
        found_courses.agg(F.count(F.lit(1)).alias("course_count")),
    )
    order = ("source_name", "external_id")
    return {
        "gap": gap,
        "counts": counts,
        "sample_jobs": head(found_jobs, samples, *order),
        "sample_courses": head(found_courses, samples, *order),
    }


def samples_per_skill(df: DataFrame, n: int = 10, order: Sequence[str] = ("source_name", "external_id")) -> DataFrame:
    """The first rows of every skill.  At most ``n`` rows per skill and task reach the shuffle."""
    from pyspark.sql import Window as W

    exploded = explode_skills(df, *[c for c in df.columns if c != "skills"])
    ranked = exploded.withColumn("rank", F.row_number().over(W.partitionBy("skill").orderBy(*order)))
    return ranked.where(F.col("rank") <= n)
