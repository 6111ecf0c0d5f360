"""Trend history, series, weekly movement and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.operators import enrich, filters, gaps, kpis, trends, weekly
from workload import bindings as b
from workload.registry import query

SKILLS = ["click", "error", "purchase", "signup", "view"]


@query("trend_history", f"""
WITH {b.PART_JOBS_SQL}, m AS (SELECT *, unnest(skills) AS skill FROM pjobs), c AS (SELECT skill, count(*) AS n FROM (SELECT unnest(skills) AS skill FROM pcourses) GROUP BY 1)
SELECT run_id, substr(run_id, 1, 4) || '-' || substr(run_id, 5, 2) || '-01T00:00:00+00:00' AS run_timestamp, source_name, m.skill, count(*) AS job_count,
  coalesce(max(c.n), 0) AS course_count, round(avg(salary_min), 1) AS salary_min_avg, round(avg(salary_max), 1) AS salary_max_avg, location, role_category, role_family
FROM m LEFT JOIN c ON m.skill = c.skill GROUP BY run_id, source_name, m.skill, location, role_category, role_family""")
def trend_history(spark, sf):
    out = trends.skill_trend_history(b.part_jobs(spark, sf), b.part_courses(spark, sf), F.col("run_id"))
    return out.withColumns({c: F.round(c, 1) for c in ("salary_min_avg", "salary_max_avg")})


def _pivot_sql(key: str, name: str, tail: str = "") -> str:
    sums = ", ".join(f"CAST(coalesce(sum(job_count) FILTER (WHERE skill = '{s}'), 0) AS BIGINT) AS \"{s}\"" for s in SKILLS)
    return f"WITH {b.TRENDS_SQL} SELECT {key} AS {name}, {sums} FROM trends GROUP BY 1{tail}"


@query("trend_pivot", _pivot_sql("run_timestamp", "run_timestamp"))
def trend_pivot(spark, sf):
    return trends.trend_pivot(b.trends(spark, sf), SKILLS)


@query("weekly_pivot", _pivot_sql("strftime(date_trunc('week', CAST(substr(run_timestamp, 1, 10) AS DATE)), '%Y-%m-%d')", "week"))
def weekly_pivot(spark, sf):
    return trends.weekly_pivot(b.trends(spark, sf), SKILLS).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("daily_series", _pivot_sql("substr(run_timestamp, 1, 10)", "date", " ORDER BY 1 DESC LIMIT 30"))
def daily_series(spark, sf):
    return trends.daily_series(b.trends(spark, sf), SKILLS)


@query("run_skill_rollup", f"""
WITH {b.TRENDS_SQL} SELECT run_id, skill, min(run_timestamp) AS run_timestamp, CAST(sum(job_count) AS BIGINT) AS job_count, max(course_count) AS course_count,
  'all' AS source_name, 'All locations' AS location, 'All technology roles' AS role_category FROM trends GROUP BY 1, 2""")
def run_skill_rollup(spark, sf):
    return trends.run_skill_rollup(b.trends(spark, sf))


@query("trend_extent", f"""
WITH {b.TRENDS_SQL} SELECT min(substr(run_timestamp, 1, 10)) AS first_snapshot, count(DISTINCT role_category) AS role_categories, count(DISTINCT location) AS locations FROM trends""")
def trend_extent(spark, sf):
    return trends.trend_extent(b.trends(spark, sf)).withColumn("first_snapshot", F.date_format("first_snapshot", "yyyy-MM-dd"))


_RECODE = "CASE role_category WHEN 'Data Engineering' THEN 'Data Engineer' WHEN 'Data Science' THEN 'Data Scientist' WHEN 'Other Data Role' THEN 'Other Technology Role' ELSE role_category END"
_FAMILY = "CASE role_category WHEN 'Data Science' THEN 'AI & Machine Learning' WHEN 'Data Engineering' THEN 'Data & Analytics' ELSE role_family END"


@query("trend_roles", f"""
WITH {b.TRENDS_SQL} SELECT {_RECODE} AS role_category, {_FAMILY} AS role_family, CAST(sum(job_count) AS BIGINT) AS jobs FROM trends GROUP BY 1, 2""")
def trend_roles(spark, sf):
    return enrich.normalize_trend_roles(b.trends(spark, sf)).groupBy("role_category", "role_family").agg(F.sum("job_count").alias("jobs"))


@query("trend_snapshot", f"""
WITH {b.TRENDS_SQL} SELECT run_id, skill, CAST(sum(job_count) AS BIGINT) AS job_count, max(course_count) AS course_count, coalesce(max(role_family), '') AS role_families FROM trends GROUP BY 1, 2""")
def trend_snapshot(spark, sf):
    return trends.snapshot(b.trends(spark, sf), "run_id")


# --- weekly reports -----------------------------------------------------------------------------

WEEKLY_SQL = f"""{b.TRENDS_SQL},
rt AS (SELECT run_id, max(CAST(substr(run_timestamp, 1, 10) AS DATE)) AS d FROM trends GROUP BY 1),
wk AS (SELECT run_id, d, date_trunc('week', d)::DATE AS week_start FROM rt QUALIFY row_number() OVER (PARTITION BY date_trunc('week', d) ORDER BY d DESC, run_id DESC) = 1),
wr AS (SELECT *, lag(run_id) OVER (ORDER BY week_start) AS previous_run_id, lead(run_id) OVER (ORDER BY week_start) AS next_run_id FROM wk),
shot AS (SELECT run_id, skill, CAST(sum(job_count) AS BIGINT) AS job_count, max(course_count) AS course_count FROM trends WHERE run_id IN (SELECT run_id FROM wr) GROUP BY 1, 2),
mv AS (SELECT wr.run_id, s.skill, coalesce(c.job_count, 0) AS current, coalesce(p.job_count, 0) AS previous, coalesce(c.job_count, 0) - coalesce(p.job_count, 0) AS change
  FROM wr JOIN (SELECT run_id AS r, skill FROM shot) s ON s.r IN (wr.run_id, wr.previous_run_id)
  LEFT JOIN shot c ON c.run_id = wr.run_id AND c.skill = s.skill LEFT JOIN shot p ON p.run_id = wr.previous_run_id AND p.skill = s.skill
  WHERE wr.previous_run_id IS NOT NULL GROUP BY ALL)"""


@query("weekly_runs", f"""
WITH {WEEKLY_SQL} SELECT strftime(week_start, '%Y-%m-%d') AS week_start, run_id, previous_run_id, next_run_id IS NULL AS is_latest FROM wr""")
def weekly_runs(spark, sf):
    return weekly.weekly_runs(b.trends(spark, sf)).select(F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "run_id", "previous_run_id", "is_latest")


@query("weekly_top", f"""
WITH {WEEKLY_SQL} SELECT run_id, skill, job_count, course_count, CAST(row_number() OVER (PARTITION BY run_id ORDER BY job_count DESC, skill) AS INTEGER) AS rank FROM shot QUALIFY rank <= 3""")
def weekly_top(spark, sf):
    return weekly.weekly_top_skills(b.trends(spark, sf), 3).select("run_id", "skill", "job_count", "course_count", "rank")


@query("weekly_movement", f"WITH {WEEKLY_SQL} SELECT run_id, skill, current, previous, change FROM mv")
def weekly_movement(spark, sf):
    return weekly.weekly_movement(b.trends(spark, sf))


@query("weekly_movers", f"""
WITH {WEEKLY_SQL}, d AS (SELECT *, CASE WHEN change > 0 THEN 'rising' ELSE 'declining' END AS direction FROM mv WHERE change <> 0)
SELECT run_id, direction, skill, current, previous, change, CAST(row_number() OVER (PARTITION BY run_id, direction ORDER BY abs(change) DESC, skill) AS INTEGER) AS rank
FROM d QUALIFY rank <= 2""")
def weekly_movers(spark, sf):
    return weekly.weekly_movers(b.trends(spark, sf), 2).select("run_id", "direction", "skill", "current", "previous", "change", "rank")


@query("weekly_reports", f"""
WITH {WEEKLY_SQL}, {b.RUNS_SQL},
top AS (SELECT run_id, string_agg(skill || ' ' || job_count, ', ' ORDER BY job_count DESC, skill) AS top, arg_min(skill, (-job_count, skill)) AS leader FROM shot GROUP BY 1),
dir AS (SELECT *, row_number() OVER (PARTITION BY run_id, change > 0 ORDER BY abs(change) DESC, skill) AS k FROM mv WHERE change <> 0),
up AS (SELECT run_id, string_agg(skill || ' ' || change, ', ' ORDER BY change DESC, skill) AS rising, arg_min(skill, (-change, skill)) AS riser FROM dir WHERE change > 0 AND k <= 5 GROUP BY 1),
down AS (SELECT run_id, string_agg(skill || ' ' || change, ', ' ORDER BY change, skill) AS declining FROM dir WHERE change < 0 AND k <= 5 GROUP BY 1)
SELECT strftime(week_start, '%Y-%m-%d') || '-' || wr.run_id AS report_id, strftime(d, '%Y-%m-%d') || 'T00:00:00+00:00' AS published_at, strftime(week_start, '%Y-%m-%d') AS week_start,
  strftime(week_start + 6, '%Y-%m-%d') AS week_end, leader || ' leads the weekly technology skill snapshot' AS title,
  'The latest retained snapshot includes ' || format('{{:,}}', job_records) || ' jobs, ' || format('{{:,}}', course_records) || ' learning resources, and ' || format('{{:,}}', unique_skills) || ' scored skills. ' ||
    CASE WHEN riser IS NOT NULL THEN riser || ' recorded the largest increase from the previous retained week.'
      WHEN previous_run_id IS NULL THEN 'This is the first retained weekly baseline, so no week-over-week movement is shown yet.' ELSE 'No skill gained jobs over the previous retained week.' END AS summary,
  job_records AS jobs, course_records AS courses, unique_skills AS skills, top_opportunity_skill, top AS top_skills, coalesce(rising, '') AS rising_skills, coalesce(declining, '') AS declining_skills,
  CASE WHEN next_run_id IS NULL THEN 'Latest snapshot' ELSE 'Archived snapshot' END AS status
FROM wr JOIN runs USING (run_id) LEFT JOIN top USING (run_id) LEFT JOIN up USING (run_id) LEFT JOIN down USING (run_id) ORDER BY week_start DESC LIMIT 12""")
def weekly_reports(spark, sf):
    out = weekly.weekly_reports(b.trends(spark, sf), None, b.runs(spark, sf))

    def listed(column: str, value: str):
        return F.concat_ws(", ", F.transform(column, lambda s: F.concat_ws(" ", s["skill"], s[value]))).alias(column)

    return out.select(
        "report_id", "published_at", "week_start", "week_end", "title", "summary", "jobs", "courses", "skills", "top_opportunity_skill",
        listed("top_skills", "job_count"), listed("rising_skills", "change"), listed("declining_skills", "change"), "status")


# --- logs ---------------------------------------------------------------------------------------

@query("filter_source_runs", f"""
WITH {b.SOURCE_RUNS_SQL} SELECT run_id, source_name, status, record_count, completed_at FROM source_runs WHERE run_id = '20240105_000000' ORDER BY completed_at DESC, source_name LIMIT 200""")
def filter_source_runs(spark, sf):
    return filters.filter_source_runs(b.source_runs(spark, sf), "20240105_000000").select("run_id", "source_name", "status", "record_count", "completed_at")


@query("source_failures", f"""
WITH {b.SOURCE_RUNS_SQL} SELECT count(*) AS sources, count(*) FILTER (WHERE status = 'failed') AS failed FROM source_runs WHERE run_id = '20240105_000000'""")
def source_failures(spark, sf):
    return kpis.source_failures(b.source_runs(spark, sf), "20240105_000000")


@query("scheduler_view", f"""
WITH {b.RUNS_SQL}, m AS (SELECT max(CAST(run_timestamp AS TIMESTAMP)) AS t FROM runs)
SELECT 1440 AS interval_minutes, strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') AS latest_run_timestamp, strftime(t + INTERVAL 1440 MINUTE, '%Y-%m-%dT%H:%M:%S+00:00') AS estimated_next_run FROM m""")
def scheduler_view(spark, sf):
    return kpis.scheduler_view(b.runs(spark, sf))


@query("recent_runs", f"WITH {b.RUNS_SQL} SELECT run_id, run_timestamp, job_records FROM runs ORDER BY run_timestamp DESC, run_id DESC LIMIT 20")
def recent_runs(spark, sf):
    return filters.recent_runs(b.runs(spark, sf), 20).select("run_id", "run_timestamp", "job_records")
