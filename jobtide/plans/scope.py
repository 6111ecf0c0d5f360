"""Outputs restricted to a source view and a role family, scores recomputed on what remains."""

from __future__ import annotations

from pyspark.sql import DataFrame

from jobtide.operators.certifications import MARKET_COLUMNS, certification_recommendations
from jobtide.operators.filters import filter_courses, filter_jobs, filter_skill_trends, filter_sources
from jobtide.operators.gaps import explode_skills, skill_gap_summary
from jobtide.taxonomy import Taxonomy
from jobtide.values.sources import SOURCE_VIEWS

Outputs = dict[str, DataFrame]


def scope(
    outputs: Outputs,
    source_view: str = "all",
    role_family: str | None = None,
    taxonomy: Taxonomy | None = None,
    views: dict | None = None,
    catalog: DataFrame | None = None,
) -> Outputs:
    """One lazy plan: filters reach the scans, gaps and certifications are recomputed above them.

    ``catalog`` holds the certifications with their ``ordinal``; without it those of the outputs are scored
    anew on the gaps that remain.  An unknown view means every source.
    """
    job_sources, course_sources = (views or SOURCE_VIEWS).get(source_view, (None, None))
    if job_sources is None and course_sources is None and not role_family:
        return outputs
    out = dict(outputs)
    out["jobs"] = filter_jobs(filter_sources(outputs["jobs"], job_sources), role_family=role_family, limit=None)
    out["courses"] = filter_courses(filter_sources(outputs["courses"], course_sources), role_family=role_family, limit=None)
    if "trend_history" in outputs:
        out["trend_history"] = filter_skill_trends(
            filter_sources(outputs["trend_history"], job_sources), role_family=role_family, limit=None
        )
    out["skill_gaps"] = skill_gap_summary(out["jobs"], out["courses"], taxonomy)
    if catalog is None and "certifications" in outputs:
        # what earlier gaps gave them goes; keys are unique already
        catalog = outputs["certifications"].drop(*MARKET_COLUMNS, "market_priority", "recommendation_score")
        scored = certification_recommendations(catalog, out["skill_gaps"], taxonomy)
    elif catalog is not None:
        scored = certification_recommendations(catalog, out["skill_gaps"], taxonomy, ordinal="ordinal")
    else:
        return out
    # no skills at all leave no certifications either
    skills = explode_skills(out["jobs"]).unionByName(explode_skills(out["courses"]))
    out["certifications"] = scored.where(skills.limit(1).exists())
    return out
