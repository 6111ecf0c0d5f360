"""Certification catalog and recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions import scoring
from jobtide.functions.scalars import number
from jobtide.literals import literal_frame
from jobtide.operators.enrich import certification_families
from jobtide.operators.trends import latest_per_group
from jobtide.schemas import CERTIFICATION
from jobtide.taxonomy import Taxonomy, lookup
from jobtide.values import catalogs

MODES = ("curated", "freecodecamp", "credential_engine", "all")
MARKET_COLUMNS = {
    "opportunity_index": "int",
    "opportunity_label": "string",
    "job_demand": "long",
    "target_job_roles": "string",
}


def target_roles(skill: Column) -> Column:
    return lookup(catalogs.CREDENTIAL_ROLES, skill, "Technology professional")


def builtin_certifications(spark: SparkSession) -> DataFrame:
    schema = "skill string, certification_name string, provider string, level string, free_or_paid string, " \
             "estimated_cost_usd double, target_roles string, url string, priority_score int"
    return literal_frame(spark, catalogs.BUILTIN_CERTIFICATIONS, schema)


def track_certifications(tracks: DataFrame, source: str, confidence: str, verified: str) -> DataFrame:
    """Curriculum tracks as certification rows."""
    return tracks.select(
        "skill",
        F.concat(F.lit("freeCodeCamp "), F.col("title")).alias("certification_name"),
        F.lit("freeCodeCamp").alias("provider"),
        F.lit("Beginner").alias("level"),
        F.lit("Free").alias("free_or_paid"),
        F.lit(0.0).alias("estimated_cost_usd"),
        target_roles(F.col("skill")).alias("target_roles"),
        F.concat(F.lit("https://www.freecodecamp.org/learn/"), F.col("slug"), F.lit("/")).alias("url"),
        F.lit(76).alias("priority_score"),
        F.lit(source).alias("source_name"),
        F.lit(confidence).alias("source_confidence"),
        F.lit(verified).cast("date").alias("last_verified"),
    )


def build_cert_catalog(
    mode: str,
    cloud: DataFrame,
    tracks: DataFrame,
    live_tracks: DataFrame | None = None,
    credentials: DataFrame | None = None,
    verified: str = "2026-07-19",
) -> DataFrame:
    """Cloud certifications, curriculum certifications and, when the mode asks for them, credentials.

    The live curriculum is used in the modes that fetch it and where it was landed; the built-in
    tracks otherwise.
    """
    chosen = mode.strip().lower()
    if chosen not in MODES:
        raise ValueError(f"unknown certification mode {mode!r}; use one of {', '.join(MODES)}")
    if chosen in ("freecodecamp", "all") and live_tracks is not None:
        curriculum = track_certifications(live_tracks, "freecodecamp_curriculum", "live_verified", verified)
    else:
        curriculum = track_certifications(tracks, "freecodecamp_curriculum_snapshot", "curated_demo", "2026-07-19")
    parts = [cloud, curriculum]
    if chosen in ("credential_engine", "all") and credentials is not None:
        parts.append(credentials)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def certification_recommendations(
    certifications: DataFrame,
    gaps: DataFrame | None,
    taxonomy: Taxonomy | None = None,
    ordinal: str | Sequence[str] | None = None,
) -> DataFrame:
    """Certifications with market columns and a score, best first.

    ``ordinal`` names the input order; the last row per (skill, certification) wins.  Without gaps
    the market columns are null.
    """
    out = certifications
    for name, default in (
        ("source_name", F.lit("curated_certification_catalog")),
        ("source_confidence", F.lit("curated_demo")),
        ("last_verified", F.lit("2026-07-20").cast("date")),
    ):
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in out.columns else default)
    out = out.withColumn("role_families", certification_families(F.col("skill"), taxonomy))
    if ordinal is not None:
        names = [ordinal] if isinstance(ordinal, str) else list(ordinal)
        out = latest_per_group(out, ["skill", "certification_name"], *[F.desc(n) for n in names]).drop(*names)
    if gaps is None:
        empty = {c: F.lit(None).cast(t) for c, t in MARKET_COLUMNS.items()}
        return out.withColumns(
            {**empty, "market_priority": F.lit(None).cast("double"), "recommendation_score": F.lit(None).cast("int")}
        )
    market = gaps.select("skill", *MARKET_COLUMNS)
    scored = out.join(market, "skill", "left").withColumns(
        {
            "market_priority": F.coalesce(number(F.col("opportunity_index")), F.lit(0.0)),
            "recommendation_score": scoring.recommendation_score(F.col("priority_score"), F.col("opportunity_index")),
        }
    )
    return scored.orderBy(
        F.desc("recommendation_score"), F.desc("priority_score"), F.asc("skill"), F.asc("certification_name")
    )


def full_catalog(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """Built-in certifications followed by a catalog, with the ordinal the recommendations need."""
    first = builtin_certifications(spark).withColumn("ordinal", F.lit(0))
    second = catalog.withColumn("ordinal", F.lit(1))
    both = first.unionByName(second, allowMissingColumns=True)
    return both.select(*[F.col(f.name).cast(f.dataType) for f in CERTIFICATION], "ordinal")


def certification_summary(recommendations: DataFrame) -> DataFrame:
    """Recommendations, free ones, providers and the mean score rounded half up."""
    return recommendations.agg(
        F.count(F.lit(1)).alias("recommendations"),
        F.count_if(F.col("free_or_paid") == "Free").alias("free"),
        F.count_distinct("provider").alias("providers"),
        F.coalesce(F.floor(F.avg("recommendation_score") + 0.5), F.lit(0)).cast("long").alias("mean_score"),
    )
