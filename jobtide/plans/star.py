"""Star schema: staging, facts, dimensions and marts.

Keys follow the warehouse model by default (``md5`` of run, source and external id); ``keys="export"``
gives the run-independent keys of the file export.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.roles import recode_family, recode_role, role_family, role_name, role_number
from jobtide.functions.scalars import parse_time, run_timestamp, surrogate_key
from jobtide.functions.text import blank_to_null
from jobtide.operators.gaps import explode_skills
from jobtide.operators.trends import latest_per_group
from jobtide.taxonomy import lookup
from jobtide.values.sources import CONFIDENCE_LABELS

LIST_COLUMNS = ("skills", "skill_categories", "skill_match_terms")


def record_key(keys: str = "warehouse") -> Column:
    if keys == "export":
        source = F.coalesce(F.col("source_name"), F.lit("unknown"))
        return F.md5(F.concat_ws(":", source, F.coalesce(F.col("external_id").cast("string"), F.lit(""))))
    return surrogate_key(F.col("run_id"), F.col("source_name"), F.col("external_id"))


def stg_jobs(jobs: DataFrame, keys: str = "warehouse") -> DataFrame:
    def default(name: str, value: str) -> Column:
        return F.coalesce(blank_to_null(F.col(name)), F.lit(value)).alias(name)

    return jobs.select(
        "run_id", record_key(keys).alias("job_key"), "source_name", "source_confidence", "external_id", "title", "company",
        default("location", "Unknown"), default("role_category", "Legacy Unclassified Role"),
        default("role_family", "Other Technology"), "remote_type", "salary_min", "salary_max", "posted_at", "url", "skills",
        "skill_confidence", "skill_count", "collected_at",
    )


def stg_courses(courses: DataFrame, keys: str = "warehouse") -> DataFrame:
    return courses.select(
        "run_id", record_key(keys).alias("course_key"), "source_name", "source_confidence", "external_id", "title", "platform",
        "level", "rating", "duration_minutes", "url", "skills", "skill_confidence", "skill_count", "role_families", "collected_at",
    )


def _mentions(staged: DataFrame, key: str, kind: str, *extra: str) -> DataFrame:
    exploded = explode_skills(
        staged, F.lit(kind).alias("mention_type"), "run_id", F.col(key).alias("record_key"), "source_name",
        "source_confidence", "skill_confidence", *extra,
    ).withColumn("skill", F.trim("skill"))
    return exploded.withColumn("mention_key", surrogate_key(F.col("record_key"), F.col("skill")))


def int_skill_mentions(jobs: DataFrame, courses: DataFrame) -> DataFrame:
    """Every record and skill, jobs and courses, from the staged tables."""
    both = _mentions(jobs, "job_key", "job").unionByName(_mentions(courses, "course_key", "course"))
    return both.select(
        "mention_key", "mention_type", "run_id", "record_key", "source_name", "source_confidence", "skill", "skill_confidence"
    )


def fact_job_skill_mentions(jobs: DataFrame) -> DataFrame:
    """Job and skill.  Role and location travel with the exploded row, so no join back to the jobs."""
    m = _mentions(jobs, "job_key", "job", "role_category", "location")
    return m.select(
        F.col("mention_key").alias("job_skill_mention_key"), F.md5("skill").alias("skill_key"),
        F.md5("role_category").alias("role_key"), F.md5("location").alias("location_key"),
        F.md5("source_name").alias("source_key"), F.md5("run_id").alias("time_key"), "run_id",
        F.col("record_key").alias("job_key"), "skill_confidence",
        F.when(F.col("source_confidence") == "live_verified", 1).otherwise(0).alias("high_confidence_demand"),
        F.lit(1).alias("mention_count"),
    )


def fact_course_skill_coverage(courses: DataFrame) -> DataFrame:
    m = _mentions(courses, "course_key", "course")
    return m.select(
        F.col("mention_key").alias("course_skill_coverage_key"), F.md5("skill").alias("skill_key"),
        F.md5("source_name").alias("source_key"), F.md5("run_id").alias("time_key"), "run_id",
        F.col("record_key").alias("course_key"), "skill_confidence", F.lit(1).alias("coverage_count"),
    )


def fact_skill_trend_history(trends: DataFrame, keys: str = "warehouse") -> DataFrame:
    role = recode_role(F.col("role_category"))
    grain = [F.col("run_id"), F.col("source_name"), F.col("skill"), F.col("location"), role]
    if keys == "export":
        grain.append(F.col("role_family"))
    return trends.select(
        surrogate_key(*grain).alias("skill_trend_key"), F.md5("skill").alias("skill_key"), F.md5(role).alias("role_key"),
        F.md5("location").alias("location_key"), F.md5("source_name").alias("source_key"), F.md5("run_id").alias("time_key"),
        "run_id", "run_timestamp", "job_count", "course_count", "salary_min_avg", "salary_max_avg",
    )


def dim_skill(gaps: DataFrame) -> DataFrame:
    """Latest attributes per skill over the stored gap summaries."""
    latest = latest_per_group(gaps, ["skill"], F.desc("run_id"))
    return latest.select(
        F.md5("skill").alias("skill_key"), "skill", "category", "taxonomy_source", "onet_evidence_status", "onet_soc_codes",
        "onet_occupations",
    )


def dim_skill_export(gaps: DataFrame, jobs: DataFrame, courses: DataFrame, trends: DataFrame) -> DataFrame:
    """Skills of the gap summary first, then skills only seen elsewhere with default attributes."""
    known = gaps.select("skill", F.struct(
        F.lit(0).alias("p"), F.coalesce("category", F.lit("Other")).alias("category"),
        F.coalesce("taxonomy_source", F.lit("")).alias("taxonomy_source"),
        F.coalesce("onet_evidence_status", F.lit("project_fallback")).alias("onet_evidence_status")).alias("a"))
    seen = explode_skills(jobs).unionByName(explode_skills(courses)).unionByName(
        trends.select("skill").where(F.col("skill").isNotNull()))
    rest = seen.select("skill", F.struct(
        F.lit(1).alias("p"), F.lit("Other").alias("category"), F.lit("").alias("taxonomy_source"),
        F.lit("project_fallback").alias("onet_evidence_status")).alias("a"))
    first = known.unionByName(rest).groupBy("skill").agg(F.min("a").alias("a"))
    return first.select(F.md5("skill").alias("skill_key"), "skill", "a.category", "a.taxonomy_source", "a.onet_evidence_status")


def dim_role(jobs: DataFrame, trends: DataFrame) -> DataFrame:
    """One row per role over staged jobs and trends, retired labels replaced.

    A role that occurs with several families has the last of them by name.
    """
    from_trends = trends.select(
        recode_role(F.col("role_category")).alias("role_name"),
        recode_family(F.col("role_category"), F.col("role_family")).alias("role_family"),
    )
    both = from_trends.unionByName(jobs.select(F.col("role_category").alias("role_name"), "role_family"))
    known = both.where(F.col("role_name").isNotNull() & F.col("role_family").isNotNull())
    return known.groupBy("role_name").agg(F.max("role_family").alias("role_family")).select(F.md5("role_name").alias("role_key"), "role_name", "role_family")


def dim_role_export(jobs: DataFrame, trends: DataFrame) -> DataFrame:
    """One family per role; a family from the trends overrides one from the jobs."""
    title = role_number(F.col("title"))
    from_jobs = jobs.select(
        F.coalesce(blank_to_null(F.col("role_category")), role_name(title)).alias("role_name"),
        F.coalesce(blank_to_null(F.col("role_family")), role_family(title)).alias("role_family"), F.lit(0).alias("p"))
    label = F.coalesce(blank_to_null(F.col("role_category")), F.lit("Other Technology Role"))
    from_trends = trends.select(
        label.alias("role_name"),
        F.coalesce(blank_to_null(F.col("role_family")), role_family(role_number(label))).alias("role_family"), F.lit(1).alias("p"))
    chosen = from_jobs.unionByName(from_trends).groupBy("role_name").agg(
        F.max_by("role_family", F.struct("p", "role_family")).alias("role_family"))
    return chosen.select(F.md5("role_name").alias("role_key"), "role_name", "role_family")


def dim_location(jobs: DataFrame, trends: DataFrame) -> DataFrame:
    """Distinct locations of staged jobs and trends."""
    both = jobs.select(F.coalesce("location", F.lit("Unknown")).alias("location")).unionByName(
        trends.select("location").where(F.col("location").isNotNull()))
    return both.distinct().select(F.md5("location").alias("location_key"), "location")


def dim_source(jobs: DataFrame, courses: DataFrame, trends: DataFrame) -> DataFrame:
    """Sources with the label observed on their records; ``test_source`` where none was observed.

    Of several labels of a source the one that stands for the best evidence holds, in the order of `CONFIDENCE_LABELS`; others come last.
    """
    unknown = F.lit("unknown")
    observed = jobs.select("source_name", "source_confidence").unionByName(courses.select("source_name", "source_confidence"))
    seen = trends.select("source_name", F.lit(None).cast("string").alias("source_confidence")).where(F.col("source_name").isNotNull())
    rank = lookup({label: n for n, label in enumerate(CONFIDENCE_LABELS)}, F.col("source_confidence"), len(CONFIDENCE_LABELS))
    best = F.min(F.when(F.col("source_confidence").isNotNull(), F.struct(rank.alias("rank"), "source_confidence")))["source_confidence"]
    merged = observed.unionByName(seen).select(F.coalesce("source_name", unknown).alias("source_name"), "source_confidence").groupBy("source_name").agg(
        F.coalesce(best, F.lit("test_source")).alias("source_confidence")
    )
    return merged.select(F.md5("source_name").alias("source_key"), "source_name", "source_confidence")


def dim_time(trends: DataFrame, run_id: str | None = None) -> DataFrame:
    """One row per run with the parts of its time; the current run is added when the trends lack it."""
    runs = trends.select("run_id", F.col("run_timestamp").cast("string").alias("run_timestamp")).where(F.col("run_timestamp").isNotNull())
    if run_id is not None:
        current = trends.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), run_timestamp(F.lit(run_id)).alias("run_timestamp"))
        runs = runs.unionByName(current)
    per_run = runs.groupBy("run_id").agg(F.min("run_timestamp").alias("run_timestamp"))
    at = parse_time(F.col("run_timestamp"))
    return per_run.select(
        F.md5("run_id").alias("time_key"), "run_id", "run_timestamp", F.year(at).alias("year"), F.month(at).alias("month"),
        F.weekofyear(at).alias("week"), F.dayofmonth(at).alias("day"),
    )


def mart_skill_opportunity(gaps: DataFrame) -> DataFrame:
    return gaps.select(
        F.md5("skill").alias("skill_key"), "run_id", "job_demand", "course_supply", "demand_score",
        F.col("course_supply_score").alias("supply_score"), "growth_score", "salary_premium_score", "saturation_score",
        "opportunity_index", "opportunity_label", "market_direction", "bls_growth_percent",
    )


def mart_role_skill_demand(trend_fact: DataFrame) -> DataFrame:
    return trend_fact.groupBy("role_key", "skill_key", "time_key").agg(
        F.sum("job_count").alias("job_demand"), F.avg("salary_min_avg").alias("salary_min_avg"),
        F.avg("salary_max_avg").alias("salary_max_avg"))


def mart_role_readiness(demand: DataFrame, coverage: DataFrame) -> DataFrame:
    per_role = demand.groupBy("role_key", "skill_key").agg(F.sum("job_demand").alias("job_demand"))
    supply = coverage.groupBy("skill_key").agg(F.sum("coverage_count").alias("course_supply"))
    joined = per_role.join(supply, "skill_key", "left").withColumn("course_supply", F.coalesce("course_supply", F.lit(0)).cast("long"))
    return joined.select("role_key", "skill_key", "job_demand", "course_supply",
                         (F.col("job_demand") - F.col("course_supply")).alias("readiness_gap"))


def fact_records(df: DataFrame, run_id: str, key: str, keys: str = "export") -> DataFrame:
    """Drill-through table: every column but the skill lists, with run and key first."""
    own = df.withColumn("run_id", F.lit(run_id))
    rest = [c for c in df.columns if c not in (*LIST_COLUMNS, "run_id")]
    return own.select("run_id", record_key(keys).alias(key), *rest)


def with_run_id(df: DataFrame, run_id: str) -> DataFrame:
    return df.select(F.lit(run_id).alias("run_id"), *[c for c in df.columns if c != "run_id"])


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per day from January 1 of the first year to December 31 of the last."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month_no"), F.date_format("date", "MMMM").alias("month"),
        F.quarter("date").alias("quarter_no"), F.concat(F.lit("Qtr "), F.quarter("date")).alias("quarter"), F.dayofmonth("date").alias("day"),
    )


def calendar_for(df: DataFrame, column: str) -> DataFrame:
    """Calendar over the years that a date column spans."""
    at = parse_time(F.col(column))
    span = df.agg(F.min(at).alias("a"), F.max(at).alias("b")).where(F.col("a").isNotNull())
    days = span.select(F.explode(F.sequence(
        F.make_date(F.year("a"), F.lit(1), F.lit(1)), F.make_date(F.year("b"), F.lit(12), F.lit(31)))).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month_no"), F.date_format("date", "MMMM").alias("month"),
        F.quarter("date").alias("quarter_no"), F.concat(F.lit("Qtr "), F.quarter("date")).alias("quarter"), F.dayofmonth("date").alias("day"),
    )


def on_calendar(fact: DataFrame, column: str, days: DataFrame) -> DataFrame:
    """Facts with the calendar columns of their date, time of day ignored."""
    return fact.withColumn("date", F.to_date(parse_time(F.col(column)))).join(days, "date", "left")


class Tables(Mapping):
    """Named tables, each planned when first asked for and then kept."""

    def __init__(self, makers: dict[str, Callable[["Tables"], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name](self)
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def build(outputs: Mapping[str, DataFrame], run_id: str, keys: str = "warehouse") -> Mapping[str, DataFrame]:
    """The fifteen tables.  ``outputs`` holds jobs, courses, skill_gaps, trend_history, certifications, quality."""
    export = keys == "export"

    def jobs() -> DataFrame:
        return stg_jobs(with_run_id(outputs["jobs"], run_id), keys)

    def courses() -> DataFrame:
        return stg_courses(with_run_id(outputs["courses"], run_id), keys)

    def gaps() -> DataFrame:
        return with_run_id(outputs["skill_gaps"], run_id)

    def trends() -> DataFrame:
        return outputs["trend_history"]

    return Tables({
        "fact_job_skill_mentions": lambda t: fact_job_skill_mentions(jobs()),
        "fact_course_skill_coverage": lambda t: fact_course_skill_coverage(courses()),
        "fact_skill_trend_history": lambda t: fact_skill_trend_history(trends(), keys),
        "dim_skill": lambda t: dim_skill_export(gaps(), jobs(), courses(), trends()) if export else dim_skill(gaps()),
        "dim_role": lambda t: dim_role_export(jobs(), trends()) if export else dim_role(jobs(), trends()),
        "dim_location": lambda t: dim_location(jobs(), trends()),
        "dim_source": lambda t: dim_source(jobs(), courses(), trends()),
        "dim_time": lambda t: dim_time(trends(), run_id),
        "mart_skill_opportunity": lambda t: gaps().withColumn("skill_key", F.md5("skill")) if export else mart_skill_opportunity(gaps()),
        "mart_role_skill_demand": lambda t: mart_role_skill_demand(t["fact_skill_trend_history"]),
        "mart_role_readiness_inputs": lambda t: mart_role_readiness(t["mart_role_skill_demand"], t["fact_course_skill_coverage"]),
        "fact_jobs": lambda t: fact_records(outputs["jobs"], run_id, "job_key", keys),
        "fact_courses": lambda t: fact_records(outputs["courses"], run_id, "course_key", keys),
        "fact_certification_recommendations": lambda t: with_run_id(outputs["certifications"], run_id),
        "fact_quality_checks": lambda t: with_run_id(outputs["quality"], run_id),
    })
