"""Report measures over the star schema; each takes the columns to group by.

Facts are summed per dimension key before they meet a dimension, so the joins see one row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.trends import rising_skills

Star = Mapping[str, DataFrame]

# dimension -> (its key, the columns a report can group by)
DIMENSIONS = {
    "dim_skill": ("skill_key", ("skill", "category", "taxonomy_source", "onet_evidence_status")),
    "dim_role": ("role_key", ("role_name", "role_family")),
    "dim_location": ("location_key", ("location",)),
    "dim_source": ("source_key", ("source_name", "source_confidence")),
    "dim_time": ("time_key", ("run_id", "run_timestamp", "year", "month", "week", "day")),
}


def _dimension_of(column: str) -> str | None:
    return next((d for d, (_, columns) in DIMENSIONS.items() if column in columns), None)


def summarize(star: Star, fact: str, by: Sequence[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """Measures of a fact grouped by dimension columns.

    A measure is ("sum" or "avg", column).  Averages are carried as sum and count until the end.
    """
    table = star[fact]
    homes = {c: _dimension_of(c) for c in by if c not in table.columns}
    unknown = [c for c, d in homes.items() if d is None]
    if unknown:
        raise ValueError(f"{unknown} belong to no dimension")
    dims = sorted(set(homes.values()))
    keys = [DIMENSIONS[d][0] for d in dims] + [c for c in by if c in table.columns]
    partial = []
    for name, (_, column) in measures.items():
        partial += [F.sum(column).alias(f"{name}_sum"), F.count(column).alias(f"{name}_n")]
    grouped = table.groupBy(*keys).agg(*partial)
    for dim in dims:
        key, columns = DIMENSIONS[dim]
        wanted = [c for c, d in homes.items() if d == dim]
        grouped = grouped.join(star[dim].select(key, *wanted), key, "left")
    final = []
    for name, (kind, _) in measures.items():
        total, n = F.sum(f"{name}_sum"), F.sum(f"{name}_n")
        final.append((total if kind == "sum" else total / F.nullif(n, F.lit(0))).alias(name))
    return grouped.groupBy(*by).agg(*final)


def _score(star: Star, fact: str, column: str, by: Sequence[str], out: str) -> DataFrame:
    """Share of the largest per-skill total, 0-100, rounded half up."""
    largest = star[fact].groupBy("skill_key").agg(F.sum(column).alias("t")).agg(F.max("t")).scalar()
    total = summarize(star, fact, by, {"total": ("sum", F.col(column))})
    share = F.when(largest > 0, F.col("total") * 100.0 / largest).otherwise(F.lit(0.0))
    return total.select(*by, F.floor(share + 0.5).cast("long").alias(out))


def skill_demand_score(star: Star, by: Sequence[str] = ("skill",)) -> DataFrame:
    return _score(star, "fact_job_skill_mentions", "mention_count", by, "skill_demand_score")


def skill_supply_score(star: Star, by: Sequence[str] = ("skill",)) -> DataFrame:
    return _score(star, "fact_course_skill_coverage", "coverage_count", by, "skill_supply_score")


def _single(fact: str, kind: str, column: str, out: str):
    def measure(star: Star, by: Sequence[str] = ()) -> DataFrame:
        return summarize(star, fact, by, {out: (kind, F.col(column))})

    return measure


opportunity_index = _single("mart_skill_opportunity", "avg", "opportunity_index", "opportunity_index")

def high_confidence_demand_only(star: Star, by: Sequence[str] = ()) -> DataFrame:
    value = F.when(F.col("high_confidence_demand") == 1, F.col("mention_count"))
    return summarize(star, "fact_job_skill_mentions", by, {"high_confidence_demand_only": ("sum", value)})


job_mentions = _single("fact_job_skill_mentions", "sum", "mention_count", "job_mentions")
course_coverage = _single("fact_course_skill_coverage", "sum", "coverage_count", "course_coverage")
role_demand = _single("mart_role_skill_demand", "sum", "job_demand", "role_demand")
average_readiness_gap = _single("mart_role_readiness_inputs", "avg", "readiness_gap", "average_readiness_gap")
trend_job_count = _single("fact_skill_trend_history", "sum", "job_count", "trend_job_count")
trend_course_count = _single("fact_skill_trend_history", "sum", "course_count", "trend_course_count")
quality_failures = _single("fact_quality_checks", "sum", "failed_count", "quality_failures")
average_salary_maximum = _single("fact_skill_trend_history", "avg", "salary_max_avg", "average_salary_maximum")


def rising_skills_count(star: Star) -> DataFrame:
    return rising_skills(star["fact_skill_trend_history"])


def total_jobs(star: Star) -> DataFrame:
    return star["fact_jobs"].agg(F.count_distinct("job_key").alias("total_jobs"))


def total_courses(star: Star) -> DataFrame:
    return star["fact_courses"].agg(F.count_distinct("course_key").alias("total_courses"))


def tracked_skills(star: Star) -> DataFrame:
    return star["dim_skill"].agg(F.count_distinct("skill_key").alias("tracked_skills"))


# --- report queries -----------------------------------------------------------------------------

def demand_by_skill(star: Star) -> DataFrame:
    return job_mentions(star, ["skill"]).orderBy(F.desc("job_mentions"), F.asc("skill"))


def opportunity_table(star: Star) -> DataFrame:
    return opportunity_index(star, ["skill", "category"]).orderBy(F.desc("opportunity_index"), F.asc("skill"))


def role_chart(star: Star, family: str | None = None, least: int | None = None) -> DataFrame:
    """Demand per role, optionally of one family and only where demand exceeds a bound."""
    out = role_demand(star, ["role_name", "role_family"])
    out = out if family is None else out.where(F.col("role_family") == family)
    out = out if least is None else out.where(F.col("role_demand") > least)
    return out.orderBy(F.desc("role_demand"), F.asc("role_name"))


def role_skill_table(star: Star, family: str | None = None) -> DataFrame:
    by = ["role_name", "skill"] if family is None else ["role_name", "skill", "role_family"]
    out = role_demand(star, by)
    out = out if family is None else out.where(F.col("role_family") == family).drop("role_family")
    return out.orderBy(F.desc("role_demand"), F.asc("role_name"), F.asc("skill"))


def trend_by_run(star: Star) -> DataFrame:
    measures = {
        "trend_job_count": ("sum", F.col("job_count")), "trend_course_count": ("sum", F.col("course_count")),
        "average_salary_maximum": ("avg", F.col("salary_max_avg")),
    }
    return summarize(star, "fact_skill_trend_history", ["run_id"], measures).orderBy("run_id")


def readiness_by_skill(star: Star, category: str | None = None) -> DataFrame:
    out = average_readiness_gap(star, ["skill", "category"])
    out = out if category is None else out.where(F.col("category") == category)
    return out.orderBy(F.desc("average_readiness_gap"), F.asc("skill"))


def source_table(star: Star) -> DataFrame:
    """Mentions and coverage per source, both summed before they meet."""
    by = ["source_name", "source_confidence"]
    zero = F.lit(0).cast("long")
    jobs = job_mentions(star, by).withColumn("course_coverage", zero)
    courses = course_coverage(star, by).withColumn("job_mentions", zero)
    return jobs.unionByName(courses).groupBy(*by).agg(
        F.sum("job_mentions").alias("job_mentions"), F.sum("course_coverage").alias("course_coverage")
    ).orderBy("source_name")


def certification_table(star: Star) -> DataFrame:
    return star["fact_certification_recommendations"].select(
        "skill", "certification_name", "provider", "free_or_paid", "recommendation_score"
    ).orderBy(F.desc("recommendation_score"), "skill", "certification_name")


def quality_table(star: Star) -> DataFrame:
    return star["fact_quality_checks"].select("dataset", "check_name", "status", "severity", "failed_count").orderBy("dataset", "check_name")
