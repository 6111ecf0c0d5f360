"""Skill demand, supply, salary premium and opportunity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import scoring
from jobtide.functions.scalars import numeric
from jobtide.functions.text import text_list
from jobtide.operators.enrich import skill_attributes
from jobtide.operators.medians import exact_median
from jobtide.taxonomy import DEFAULT_CATEGORY, DEFAULT_FAMILY, DEFAULT_ROLE, DEFAULT_SIGNAL, Taxonomy, builtin
from jobtide.values import occupations

GAP_COLUMNS = (
    "skill category job_demand course_supply gap_score demand_supply_ratio demand_score growth_score "
    "salary_premium_score course_supply_score saturation_score opportunity_index opportunity_label market_direction "
    "target_job_roles taxonomy_source onet_evidence_status onet_workplace_examples role_families onet_soc_codes "
    "onet_occupations onet_wage_median_annual onet_growth_outlook bls_growth_percent bls_wage_year "
    "bls_projection_period onet_projected_openings onet_reference_url status"
).split()


def skill_list(df: DataFrame, column: str = "skills"):
    """The skills column as an array, whichever way the table stores it."""
    return text_list(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def explode_skills(df: DataFrame, *keep, column: str = "skills") -> DataFrame:
    """One row per record and skill, blank skills dropped.

    The outer form: from the other the optimizer infers a filter on the list, with a copy of whatever computes it. The
    columns to keep are computed once a record, before its skills are told apart.
    """
    listed = df.select(*keep, skill_list(df, column).alias("_skills"))
    return listed.select(*listed.columns[:-1], F.explode_outer("_skills").alias("skill")).where(F.trim("skill") != "")


def midpoint(df: DataFrame):
    """Middle of the salary range; null unless both ends are numbers."""
    if not {"salary_min", "salary_max"} <= set(df.columns):
        return F.lit(None).cast("double")
    return (numeric(df, "salary_min") + numeric(df, "salary_max")) / 2


def skill_counts(df: DataFrame, out: str = "records") -> DataFrame:
    return explode_skills(df).groupBy("skill").agg(F.count(F.lit(1)).alias(out))


def salary_baseline(jobs: DataFrame) -> DataFrame:
    """One row: the exact median of all salary midpoints, null without any."""
    values = jobs.select(F.lit(0).alias("g"), midpoint(jobs).alias("value"))
    return exact_median(values, ["g"], "value", "baseline").select("baseline")


# the key under which every job counts once, whatever its skills; no skill is blank
_EVERY_JOB = ""


def skill_totals(jobs: DataFrame, courses: DataFrame | None = None) -> DataFrame:
    """Per skill: demand, supply, median salary midpoint, the largest demand and supply, and the baseline over all jobs.

    One pass over the jobs serves all of it.  Every job is also counted under a blank key, whose
    median is the baseline.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    blank = F.when(F.col("skill") == _EVERY_JOB, one).otherwise(zero).alias("every_job")
    named = F.filter(skill_list(jobs), lambda s: F.trim(s) != "")
    keys = F.concat(F.coalesce(named, F.array().cast("array<string>")), F.array(F.lit(_EVERY_JOB)))
    listed = jobs.select(keys.alias("_keys"), midpoint(jobs).alias("value"))
    rows = listed.select(F.explode_outer("_keys").alias("skill"), "value", one.alias("job_demand"), zero.alias("course_supply"))
    if courses is not None:
        rows = rows.unionByName(
            explode_skills(courses, F.lit(None).cast("double").alias("value"), zero.alias("job_demand"), one.alias("course_supply"))
        )
    per_skill = exact_median(rows.select("*", blank), ["skill"], "value", "median_salary", ["job_demand", "course_supply", "every_job"])
    # a sum, not the key: a filter of the key would be pushed down to the rows, and the two uses of the medians would share no
    # pass over the jobs
    is_skill = F.col("every_job") == 0
    # one row of maxima, whatever the number of skills; one struct of all columns, so that its plan keeps the columns
    # of the one it is compared with and shares its shuffles
    most = per_skill.agg(
        F.struct(
            F.max(F.when(is_skill, F.col("job_demand"))).alias("most_demand"),
            F.max(F.when(is_skill, F.col("course_supply"))).alias("most_supply"),
            F.max(F.when(~is_skill, F.col("median_salary"))).alias("baseline"),
        ).alias("most")
    )
    return per_skill.where(is_skill).withColumn("most", most.scalar()).select("skill", "median_salary", "job_demand", "course_supply", "most.*")


def skill_support(jobs: DataFrame, courses: DataFrame) -> DataFrame:
    """Demand and supply per skill and nothing else, which is all that the check of their support needs."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = explode_skills(jobs, one.alias("job_demand"), zero.alias("course_supply")).unionByName(
        explode_skills(courses, zero.alias("job_demand"), one.alias("course_supply"))
    )
    return both.groupBy("skill").agg(F.sum("job_demand").alias("job_demand"), F.sum("course_supply").alias("course_supply"))


def _premium() -> Column:
    """Occupation evidence first, then the median against the baseline, then the taxonomy's signal."""
    return F.coalesce(
        "salary_evidence",
        scoring.premium_score(F.col("median_salary"), F.col("baseline")).cast("int"),
        "salary_signal",
        F.lit(DEFAULT_SIGNAL[1]),
    )


def salary_premium(jobs: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Salary premium score per skill found in the jobs."""
    known = skill_attributes(jobs.sparkSession, taxonomy or builtin())
    joined = skill_totals(jobs).join(known.select("skill", "salary_signal", "salary_evidence").hint("broadcast"), "skill", "left")
    return joined.select("skill", "median_salary", _premium().alias("salary_premium_score"))


def skill_gap_summary(jobs: DataFrame, courses: DataFrame, taxonomy: Taxonomy | None = None) -> DataFrame:
    """Demand, supply, scores and evidence of every skill in the jobs or courses, best first."""
    known = skill_attributes(jobs.sparkSession, taxonomy or builtin())
    joined = skill_totals(jobs, courses).join(known, "skill", "left")
    texts = (
        "onet_workplace_examples", "onet_soc_codes", "onet_occupations", "onet_growth_outlook", "bls_projection_period",
        "onet_reference_url",
    )
    scored = joined.withColumns(
        {
            "category": F.coalesce("category", F.lit(DEFAULT_CATEGORY)),
            "gap_score": F.col("job_demand") - F.col("course_supply"),
            "demand_supply_ratio": scoring.demand_supply_ratio(F.col("job_demand"), F.col("course_supply")),
            "demand_score": scoring.normalize_count(F.col("job_demand"), F.col("most_demand")),
            "course_supply_score": scoring.normalize_count(F.col("course_supply"), F.col("most_supply")),
            "growth_score": F.coalesce("growth_evidence", "growth_signal", F.lit(DEFAULT_SIGNAL[0])),
            "salary_premium_score": _premium(),
            "saturation_score": F.coalesce("saturation_score", F.lit(DEFAULT_SIGNAL[2])),
            "market_direction": F.coalesce("market_direction", F.lit(DEFAULT_SIGNAL[3])),
            "target_job_roles": F.coalesce("target_job_roles", F.lit(DEFAULT_ROLE)),
            "role_families": F.coalesce("role_families", F.lit(DEFAULT_FAMILY)),
            "taxonomy_source": F.coalesce("taxonomy_source", F.lit(occupations.FALLBACK_SOURCE)),
            "onet_evidence_status": F.coalesce("onet_evidence_status", F.lit("project_fallback")),
            **{c: F.coalesce(c, F.lit("")) for c in texts},
        }
    )
    indexed = scored.withColumn(
        "opportunity_index",
        scoring.opportunity_index(
            F.col("demand_score"), F.col("growth_score"), F.col("salary_premium_score"), F.col("course_supply_score"),
            F.col("saturation_score"),
        ).cast("int"),
    )
    index, gap = F.col("opportunity_index"), F.col("gap_score")
    labels = {"opportunity_label": scoring.opportunity_label(index), "status": scoring.gap_status(gap)}
    return rank_gaps(indexed.withColumns(labels).select(*GAP_COLUMNS))


def rank_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.desc("opportunity_index"), F.desc("gap_score"), F.desc("job_demand"), F.asc("skill"))
