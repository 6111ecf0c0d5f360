"""Declared schemas.  Reads use these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Struct of ``name type`` pairs.  (Spark's own DDL parser needs a running session.)"""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


JOB_PAYLOAD = _schema(
    "external_id string, title string, company string, location string, remote_type string, salary_min bigint, "
    "salary_max bigint, description string, posted_at string, url string"
)
COURSE_PAYLOAD = _schema(
    "external_id string, title string, platform string, level string, rating double, duration_minutes double, "
    "description string, subjects string, roles string, products string, last_modified string, url string"
)


def raw_schema(payload: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("source_name", T.StringType()),
            T.StructField("source_type", T.StringType()),
            T.StructField("source_url", T.StringType()),
            T.StructField("collected_at", T.TimestampType()),
            T.StructField("payload", payload),
        ]
    )


JOB_CSV = _schema(
    "external_id string, title string, company string, location string, remote_type string, salary_min bigint, "
    "salary_max bigint, posted_at string, url string, description string"
)
COURSE_CSV = _schema(
    "external_id string, title string, platform string, level string, rating string, duration_minutes string, "
    "description string, subjects string, roles string, products string, last_modified string, url string"
)
CERTIFICATION = _schema(
    "skill string, certification_name string, provider string, level string, free_or_paid string, "
    "estimated_cost_usd double, target_roles string, url string, priority_score int, source_name string, "
    "source_confidence string, last_verified date"
)
JOBS = _schema(
    "source_name string, source_confidence string, external_id string, title string, company string, location string, "
    "role_category string, role_family string, remote_type string, salary_min bigint, salary_max bigint, "
    "posted_at string, url string, skills array<string>, skill_categories array<string>, "
    "skill_match_terms array<string>, skill_confidence double, skill_count int, collected_at timestamp"
)
COURSES = _schema(
    "source_name string, source_confidence string, external_id string, title string, platform string, level string, "
    "rating double, duration_minutes double, subjects string, roles string, products string, last_modified string, "
    "url string, skills array<string>, role_families array<string>, skill_categories array<string>, "
    "skill_match_terms array<string>, skill_confidence double, skill_count int, collected_at timestamp"
)
GAPS = _schema(
    "skill string, category string, job_demand bigint, course_supply bigint, gap_score bigint, "
    "demand_supply_ratio double, demand_score int, growth_score int, salary_premium_score int, "
    "course_supply_score int, saturation_score int, opportunity_index int, opportunity_label string, "
    "market_direction string, target_job_roles string, taxonomy_source string, onet_evidence_status string, "
    "onet_workplace_examples string, role_families string, onet_soc_codes string, onet_occupations string, "
    "onet_wage_median_annual double, onet_growth_outlook string, bls_growth_percent double, bls_wage_year int, "
    "bls_projection_period string, onet_projected_openings double, onet_reference_url string, status string"
)
TRENDS = _schema(
    "run_id string, run_timestamp string, source_name string, skill string, job_count bigint, course_count bigint, "
    "salary_min_avg double, salary_max_avg double, location string, role_category string, role_family string"
)
QUALITY = _schema(
    "dataset string, check_name string, status string, severity string, records_checked bigint, failed_count bigint, "
    "message string"
)
RECOMMENDATIONS = T.StructType(
    CERTIFICATION.fields
    + _schema(
        "role_families string, opportunity_index int, opportunity_label string, job_demand bigint, "
        "target_job_roles string, market_priority double, recommendation_score int"
    ).fields
)
RUN_LOG = _schema(
    "run_id string, run_timestamp timestamp, job_records bigint, course_records bigint, unique_skills bigint, "
    "trend_rows bigint, top_opportunity_skill string, warehouse string"
)
SOURCE_LOG = _schema(
    "run_id string, source_name string, source_type string, status string, record_count bigint, started_at timestamp, "
    "completed_at timestamp, duration_ms bigint, error_type string, error_message string"
)

# Snapshot datasets and the warehouse tables they load, with their keys.
DATASETS = {
    "jobs": ("job_postings_clean", JOBS),
    "courses": ("course_listings_clean", COURSES),
    "skill_gaps": ("skill_gap_summary", GAPS),
    "skill_trends": ("skill_trend_history", TRENDS),
    "certifications": ("certification_recommendations", RECOMMENDATIONS),
    "quality": ("quality_summary", QUALITY),
}
WAREHOUSE_KEYS = {
    "job_postings": ("run_id", "source_name", "external_id"),
    "course_listings": ("run_id", "source_name", "external_id"),
    "skill_gap_summary": ("run_id", "skill"),
    "quality_checks": ("run_id", "dataset", "check_name"),
    # the family is part of the trend grain, so it is part of the key as well
    "skill_trend_history": ("run_id", "source_name", "skill", "location", "role_category", "role_family"),
    "certification_recommendations": ("run_id", "skill", "certification_name"),
}
WAREHOUSE_TABLES = {
    "job_postings": JOBS,
    "course_listings": COURSES,
    "skill_gap_summary": GAPS,
    "quality_checks": QUALITY,
    "skill_trend_history": TRENDS,
    "certification_recommendations": RECOMMENDATIONS,
}
