"""Weekly market reports from retained run snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.scalars import grouped_number, iso_offset, monday, number, parse_time
from jobtide.operators.trends import snapshot

METHODOLOGY_NOTE = (
    "Directional analysis from retained pipeline snapshots. "
    "It is not a representative estimate of the full labor market."
)


def history(trends: DataFrame) -> DataFrame:
    """Usable trend rows: a run time that parses and a skill."""
    out = trends
    for name, default in (("course_count", F.lit(0)), ("role_family", F.lit(""))):
        out = out if name in out.columns else out.withColumn(name, default)
    return out.withColumn("run_timestamp", parse_time(F.col("run_timestamp"))).where(
        F.col("run_timestamp").isNotNull() & F.col("skill").isNotNull()
    )


def weekly_runs(trends: DataFrame) -> DataFrame:
    """Latest run of each Monday week with the run retained in the week before it.

    One row per week, so the window over all weeks is over a short list whatever the history holds.
    """
    per_run = history(trends).groupBy("run_id").agg(F.max("run_timestamp").alias("run_timestamp"))
    per_week = per_run.withColumn("week_start", monday(F.col("run_timestamp"))).groupBy("week_start").agg(
        F.max_by(F.struct("run_id", "run_timestamp"), F.struct("run_timestamp", "run_id")).alias("run")
    )
    order = W.orderBy("week_start")
    return per_week.select("week_start", "run.run_id", "run.run_timestamp").withColumns(
        {
            "previous_run_id": F.lag("run_id").over(order),
            "is_latest": F.lead("run_id").over(order).isNull(),
        }
    )


def weekly_snapshots(trends: DataFrame, runs: DataFrame) -> DataFrame:
    """Skills of each retained run: jobs, courses, role families."""
    kept = history(trends).join(runs.select("run_id"), "run_id", "left_semi")
    return snapshot(kept, "run_id")


def weekly_top_skills(trends: DataFrame, n: int = 6) -> DataFrame:
    """The skills with most jobs in each retained run."""
    shots = weekly_snapshots(trends, weekly_runs(trends))
    rank = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("job_count"), F.asc("skill")))
    return shots.withColumn("rank", rank).where(F.col("rank") <= n)


def weekly_movement(trends: DataFrame) -> DataFrame:
    """Change of every skill from one retained week to the next; none for the first week.

    A skill counts in its own week as ``current`` and in the following week as ``previous``; adding
    the two up per week replaces a full outer join.
    """
    runs = weekly_runs(trends)
    shots = weekly_snapshots(trends, runs).select("run_id", "skill", "job_count")
    zero = F.lit(0).cast("long")
    later = runs.where(F.col("previous_run_id").isNotNull())
    now = shots.join(later.select("run_id"), "run_id", "left_semi").select(
        "run_id", "skill", F.col("job_count").alias("current"), zero.alias("previous")
    )
    then = shots.join(
        later.select(F.col("run_id").alias("next_run_id"), F.col("previous_run_id").alias("run_id")), "run_id"
    ).select(F.col("next_run_id").alias("run_id"), "skill", zero.alias("current"), F.col("job_count").alias("previous"))
    return now.unionByName(then).groupBy("run_id", "skill").agg(
        F.sum("current").alias("current"), F.sum("previous").alias("previous")
    ).withColumn("change", F.col("current") - F.col("previous"))


def weekly_movers(trends: DataFrame, n: int = 5) -> DataFrame:
    """The strongest risers and decliners of each week, ranked within their direction."""
    moved = weekly_movement(trends).where(F.col("change") != 0).withColumn(
        "direction", F.when(F.col("change") > 0, F.lit("rising")).otherwise(F.lit("declining"))
    )
    rank = F.row_number().over(
        W.partitionBy("run_id", "direction").orderBy(F.desc(F.abs("change")), F.asc("skill"))
    )
    return moved.withColumn("rank", rank).where(F.col("rank") <= n)


def weekly_reports(
    trends: DataFrame, gaps: DataFrame | None = None, runs_log: DataFrame | None = None, limit: int = 12
) -> DataFrame:
    """One report per retained week, newest first, all weeks in one plan.

    Nested lists hold at most six or five entries; they are cut before they are collected.
    """
    runs = weekly_runs(trends)
    shots = weekly_snapshots(trends, runs)
    totals = shots.groupBy("run_id").agg(
        F.sum("job_count").alias("sum_jobs"), F.max("course_count").alias("max_courses"),
        F.count(F.lit(1)).alias("n_skills"),
    )
    top = weekly_top_skills(trends)
    if gaps is not None:
        index = gaps.select("skill", F.col("opportunity_index").cast("double").alias("opportunity_index"))
        top = top.join(index, "skill", "left")
    else:
        top = top.withColumn("opportunity_index", F.lit(None).cast("double"))
    entry = ("rank", "skill", "job_count", "course_count", "role_families", "opportunity_index")
    top_lists = top.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("top_skills"))

    mover = F.struct("rank", "skill", "current", "previous", "change")
    movers = weekly_movers(trends).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("direction") == "rising", mover))).alias("rising_skills"),
        F.array_sort(F.collect_list(F.when(F.col("direction") == "declining", mover))).alias("declining_skills"),
    )
    log_columns = ("job_records", "course_records", "unique_skills", "top_opportunity_skill")
    if runs_log is not None:
        log = runs_log.select(F.col("run_id").cast("string").alias("run_id"), *log_columns)
    else:
        log = runs.select("run_id", *[F.lit(None).cast("string").alias(c) for c in log_columns])
    joined = (
        runs.join(totals, "run_id", "left").join(top_lists, "run_id", "left")
        .join(movers, "run_id", "left").join(log, "run_id", "left")
    )

    def logged(column: str, fallback: str):
        return F.coalesce(number(F.col(column)), F.col(fallback).cast("double"), F.lit(0.0)).cast("long")

    empty_movers = F.filter(F.array(F.lit(None).cast("struct<rank:int,skill:string,current:bigint,previous:bigint,change:bigint>")), lambda x: x.isNotNull())
    filled = joined.withColumns(
        {
            "jobs": logged("job_records", "sum_jobs"),
            "courses": logged("course_records", "max_courses"),
            "skills": logged("unique_skills", "n_skills"),
            "top_skill": F.coalesce(
                F.get("top_skills", F.lit(0))["skill"], F.nullif("top_opportunity_skill", F.lit("")), F.lit("No skill")
            ),
            "rising_skills": F.coalesce("rising_skills", empty_movers),
            "declining_skills": F.coalesce("declining_skills", empty_movers),
        }
    )
    leader = F.get("rising_skills", F.lit(0))["skill"]
    change = (
        F.when(leader.isNotNull(), F.concat(leader, F.lit(" recorded the largest increase from the previous retained week.")))
        .when(
            F.col("previous_run_id").isNull(),
            F.lit("This is the first retained weekly baseline, so no week-over-week movement is shown yet."),
        )
        .otherwise(F.lit("No skill gained jobs over the previous retained week."))
    )
    return filled.select(
        F.concat_ws("-", F.date_format("week_start", "yyyy-MM-dd"), "run_id").alias("report_id"),
        "run_id",
        iso_offset(F.col("run_timestamp")).alias("published_at"),
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
        F.date_format(F.date_add("week_start", 6), "yyyy-MM-dd").alias("week_end"),
        F.concat(F.col("top_skill"), F.lit(" leads the weekly technology skill snapshot")).alias("title"),
        F.concat(
            F.lit("The latest retained snapshot includes "), grouped_number(F.col("jobs")), F.lit(" jobs, "),
            grouped_number(F.col("courses")), F.lit(" learning resources, and "), grouped_number(F.col("skills")),
            F.lit(" scored skills. "), change,
        ).alias("summary"),
        "jobs", "courses", "skills",
        F.coalesce(F.nullif("top_opportunity_skill", F.lit("")), F.col("top_skill")).alias("top_opportunity_skill"),
        "top_skills", "rising_skills", "declining_skills",
        F.when(F.col("is_latest"), F.lit("Latest snapshot")).otherwise(F.lit("Archived snapshot")).alias("status"),
        F.lit(METHODOLOGY_NOTE).alias("methodology_note"),
    ).orderBy(F.desc("week_start")).limit(limit)
