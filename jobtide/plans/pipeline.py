"""The batch run: raw records to snapshots, checks, warehouse tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import schemas
from jobtide.operators import enrich
from jobtide.operators.certifications import certification_recommendations
from jobtide.operators.gaps import skill_gap_summary
from jobtide.operators.quality import run_quality
from jobtide.operators.trends import skill_trend_history
from jobtide.sources import tables
from jobtide.taxonomy import Taxonomy

LOADS = {
    "jobs": "job_postings",
    "courses": "course_listings",
    "skill_gaps": "skill_gap_summary",
    "skill_trends": "skill_trend_history",
    "certifications": "certification_recommendations",
    "quality": "quality_checks",
}


def run_pipeline(
    spark: SparkSession,
    raw_jobs: DataFrame,
    raw_courses: DataFrame,
    root: str,
    run_id: str,
    as_of: str,
    catalog: DataFrame,
    taxonomy: Taxonomy | None = None,
    expected_sources: list[tuple[str, str]] | None = None,
    database: str | None = None,
) -> dict[str, DataFrame]:
    """Run every step and return the stored snapshots of this run.

    The clean tables are written once and read back.  Everything that follows starts from those
    files, so text is matched once and a lost executor repeats a read, not the extraction.  Writing
    a run again replaces its partitions, so a failed run can simply be started again.

    Readers see nothing of a run until all of its snapshots are written and checked; then one rename publishes it. A run
    that fails leaves no trace that they see, and one that is started again is withdrawn first. The warehouse and the logs
    follow the publication, each of them repeatable.
    """
    processed = f"{root}/processed"
    tables.withdraw_run(spark, processed, run_id)

    def store(name: str, df: DataFrame) -> DataFrame:
        dataset, schema = schemas.DATASETS[name]
        path = tables.write_snapshot(df, processed, dataset, run_id)
        return spark.read.schema(schema).parquet(path)

    out = {
        "jobs": store("jobs", enrich.normalize_jobs(raw_jobs, taxonomy)),
        "courses": store("courses", enrich.normalize_courses(raw_courses, taxonomy)),
    }
    out["skill_gaps"] = store("skill_gaps", skill_gap_summary(out["jobs"], out["courses"], taxonomy))
    out["skill_trends"] = store("skill_trends", skill_trend_history(out["jobs"], out["courses"], run_id))
    out["certifications"] = store(
        "certifications", certification_recommendations(catalog, out["skill_gaps"], taxonomy, ordinal="ordinal")
    )
    out["quality"] = store("quality", run_quality(out["jobs"], out["courses"], out["skill_gaps"], as_of))

    tables.publish_run(spark, processed, run_id)
    warehouse = "skipped"
    if database is not None:
        tables.ensure_tables(spark, database)
        for name, table in LOADS.items():
            tables.load_table(spark, out[name], database, table, run_id)
        warehouse = "loaded"
    if expected_sources is not None:
        both = out["jobs"].select("source_name").unionByName(out["courses"].select("source_name"))
        status = tables.source_status(both, expected_sources, as_of, as_of)
        tables.append_source_log(status, f"{root}/logs/source_runs", run_id)
    tables.append_run_log(
        out["jobs"], out["courses"], out["skill_gaps"], out["skill_trends"], f"{root}/logs/pipeline_runs", run_id, as_of, warehouse
    )
    return out
