"""Raw records to clean jobs and courses, and the lookups that enrich them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions import roles as rl
from jobtide.functions import scoring
from jobtide.functions import text as tx
from jobtide.literals import literal_frame
from jobtide.taxonomy import DEFAULT_FAMILY, Taxonomy, builtin, lookup
from jobtide.values import occupations, roles, skills, sources

JOB_TEXT = ("title", "description", "company", "location", "remote_type")
COURSE_TEXT = ("title", "description", "subjects", "roles", "products", "platform")


def source_confidence(source: Column, labels: dict[str, str] | None = None) -> Column:
    known = sources.SOURCE_CONFIDENCE if labels is None else labels
    return lookup(known, F.trim(source), sources.DEFAULT_CONFIDENCE)


def add_source_confidence(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    if "source_name" not in df.columns:
        return df.withColumn("source_confidence", F.lit(sources.DEFAULT_CONFIDENCE))
    return df.withColumn("source_confidence", source_confidence(F.col("source_name"), labels))


def extract_skills(df: DataFrame, text: str | Column, taxonomy: Taxonomy, out: str = "matches") -> DataFrame:
    """Add the skill matches of a text column."""
    column = F.col(text) if isinstance(text, str) else text
    return df.withColumn("_text", tx.normalize_skill_text(column)).withColumn(
        out, tx.match_skills(F.col("_text"), taxonomy)
    ).drop("_text")


def _match_columns(matches: Column) -> dict[str, Column]:
    return {
        "skills": F.transform(matches, lambda m: m["skill"]),
        "skill_categories": F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["category"]))),
        "skill_match_terms": F.transform(
            matches, lambda m: F.concat(m["skill"], F.lit(":"), F.concat_ws(",", m["terms"]))
        ),
        "skill_confidence": tx.mean_confidence(matches),
        "skill_count": F.size(matches),
    }


def normalize_jobs(
    raw: DataFrame,
    taxonomy: Taxonomy | None = None,
    rules: Sequence[rl.Rule] | None = None,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Raw records with a job payload to the clean job table.  List columns stay arrays."""
    taxonomy = taxonomy or builtin()
    flat = raw.select("source_name", "collected_at", "payload.*")
    flat = extract_skills(flat, tx.skill_text(*[F.col(c) for c in JOB_TEXT]), taxonomy)
    flat = rl.with_role(flat, "title", rules)
    return flat.withColumns(_match_columns(F.col("matches"))).select(
        "source_name",
        source_confidence(F.col("source_name"), labels).alias("source_confidence"),
        "external_id", "title", "company", "location", "role_category", "role_family", "remote_type",
        "salary_min", "salary_max", "posted_at", "url", "skills", "skill_categories", "skill_match_terms",
        "skill_confidence", "skill_count", "collected_at",
    )


def skill_families(matches: Column, taxonomy: Taxonomy) -> Column:
    """Sorted distinct role families of the matched skills."""
    pairs = [x for s in taxonomy.skills for x in (F.lit(s.name), F.array(*[F.lit(f) for f in taxonomy.families(s)]))]
    known = F.create_map(*pairs)
    families = F.transform(
        matches, lambda m: F.coalesce(F.element_at(known, m["skill"]), F.array(F.lit(DEFAULT_FAMILY)))
    )
    return F.array_sort(F.array_distinct(F.flatten(families)))


def normalize_courses(
    raw: DataFrame, taxonomy: Taxonomy | None = None, labels: dict[str, str] | None = None
) -> DataFrame:
    """Raw records with a course payload to the clean course table.  List columns stay arrays."""
    taxonomy = taxonomy or builtin()
    flat = raw.select("source_name", "collected_at", "payload.*")
    flat = extract_skills(flat, tx.skill_text(*[F.col(c) for c in COURSE_TEXT]), taxonomy)
    flat = flat.withColumn("role_families", skill_families(F.col("matches"), taxonomy))
    return flat.withColumns(_match_columns(F.col("matches"))).select(
        "source_name",
        source_confidence(F.col("source_name"), labels).alias("source_confidence"),
        "external_id", "title", "platform", "level", "rating", "duration_minutes", "subjects", "roles", "products",
        "last_modified", "url", "skills", "role_families", "skill_categories", "skill_match_terms",
        "skill_confidence", "skill_count", "collected_at",
    )


def normalize_trend_roles(trends: DataFrame, rules: Sequence[rl.Rule] | None = None) -> DataFrame:
    """Bring retired role labels of stored snapshots forward and fill in missing families."""
    if "role_category" not in trends.columns:
        return trends
    out = trends if "role_family" in trends.columns else trends.withColumn("role_family", F.lit(None).cast("string"))
    out = out.withColumn("role_category", rl.recode_role(F.col("role_category")))
    given = F.when(~F.trim(F.col("role_family")).isin("", "nan"), F.col("role_family"))
    number = rl.role_number(F.col("role_category"), rules)
    return out.withColumn("role_family", F.coalesce(given, rl.role_family(number, rules)))


def ensure_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    missing = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def to_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with nulls kept and NaN as null."""
    cleaned = [
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ]
    return df.select(F.to_json(F.struct(*cleaned), {"ignoreNullFields": "false"}).alias("record"))


def certification_families(skill: Column, taxonomy: Taxonomy | None = None) -> Column:
    """Role families of a certification's skill, as text."""
    taxonomy = taxonomy or builtin()
    own = {s.name: "|".join(s.families) for s in taxonomy.skills if s.families}
    fallback = {name: "|".join(families) for name, families in skills.CERTIFICATION_FAMILIES.items()}
    return lookup({**fallback, **own}, skill, DEFAULT_FAMILY)


# --- occupation evidence ------------------------------------------------------------------------

def occupation_profile(profiles: DataFrame, occupations_df: DataFrame) -> DataFrame:
    """One row per skill: what its occupations say about wage, outlook, growth and openings.

    ``profiles`` holds (skill, position, soc_code); lists keep that position.
    """
    joined = profiles.join(occupations_df, "soc_code")
    listed = F.array_sort(F.collect_list(F.struct("position", "soc_code", "title")))
    return joined.groupBy("skill").agg(
        F.concat_ws(" | ", F.transform(listed, lambda o: o["soc_code"])).alias("soc_codes"),
        F.concat_ws(" | ", F.transform(listed, lambda o: o["title"])).alias("occupations"),
        scoring.half_even(F.avg("wage")).cast("long").alias("wage"),
        F.concat_ws(" | ", F.array_sort(F.collect_set("outlook"))).alias("outlook"),
        F.sum("openings").alias("openings"),
        F.avg("growth").alias("mean_growth"),
        F.concat_ws(
            " | ", F.array_sort(F.array_union(F.collect_set("onet_url"), F.collect_set("bls_url")))
        ).alias("urls"),
    )


def skill_evidence(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """Evidence columns of every skill with an occupation profile.

    Built from literals only, so it is small by construction; the literals sit in one partition and
    no step below needs a shuffle.
    """
    profile = occupation_profile(taxonomy.profile_frame(spark), taxonomy.occupation_frame(spark))
    examples = taxonomy.example_frame(spark).groupBy("skill").agg(
        F.concat_ws(
            " | ", F.transform(F.array_sort(F.collect_list(F.struct("position", "workplace_example"))),
                               lambda e: e["workplace_example"])
        ).alias("examples")
    ).hint("broadcast")
    verified = F.col("examples").isNotNull()
    everything = W.partitionBy()
    return profile.join(examples, "skill", "left").select(
        "skill",
        scoring.wage_score(F.col("wage"), F.min("wage").over(everything), F.max("wage").over(everything)).alias("salary_evidence"),
        scoring.growth_score(F.col("mean_growth")).cast("int").alias("growth_evidence"),
        F.when(verified, F.lit(occupations.VERIFIED_SOURCE)).otherwise(F.lit(occupations.MAPPED_SOURCE)).alias("taxonomy_source"),
        F.when(verified, F.lit("software_skill_verified")).otherwise(F.lit("occupation_mapping_only")).alias("onet_evidence_status"),
        F.coalesce("examples", F.lit("")).alias("onet_workplace_examples"),
        F.col("soc_codes").alias("onet_soc_codes"),
        F.col("occupations").alias("onet_occupations"),
        F.col("wage").cast("double").alias("onet_wage_median_annual"),
        F.col("outlook").alias("onet_growth_outlook"),
        F.bround("mean_growth", 1).alias("bls_growth_percent"),
        F.lit(occupations.WAGE_YEAR).alias("bls_wage_year"),
        F.lit(occupations.PROJECTION_PERIOD).alias("bls_projection_period"),
        F.col("openings").cast("double").alias("onet_projected_openings"),
        F.col("urls").alias("onet_reference_url"),
    ).hint("broadcast")


_attributes: dict[tuple[str, int], tuple[Taxonomy, list, T.StructType]] = {}


def skill_attributes(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """Taxonomy attributes and occupation evidence of every skill, one row each.

    Both come from the taxonomy's literals, so they are evaluated once per taxonomy and kept as
    literals; a plan that scores skills then carries one small table instead of their derivation.
    """
    key = (spark.sparkContext.applicationId, id(taxonomy))
    if key not in _attributes:
        both = taxonomy.attributes(spark).join(skill_evidence(spark, taxonomy), "skill", "full")
        _attributes[key] = (taxonomy, [tuple(r) for r in both.collect()], both.schema)
    _, rows_, schema = _attributes[key]
    return literal_frame(spark, rows_, T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))


def build_evidence(software_skills: DataFrame, profiles: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows that verify a tracked skill: its workplace example within an occupation of its profile."""
    expected = examples.select("skill", "workplace_example").join(profiles.select("skill", "soc_code"), "skill")
    found = software_skills.select(
        "workplace_example",
        F.col("onetsoc_code").alias("soc_code"),
        F.col("title").alias("occupation"),
        (F.col("hot_technology") == "Y").alias("hot_technology"),
        (F.col("in_demand") == "Y").alias("in_demand"),
    )
    return found.join(expected, ["workplace_example", "soc_code"]).select(
        "skill", "workplace_example", "soc_code", "occupation", "hot_technology", "in_demand"
    ).orderBy("skill", "soc_code", "workplace_example")


def missing_evidence(evidence: DataFrame, examples: DataFrame) -> DataFrame:
    """Expected (skill, example) pairs without any evidence row; empty when the evidence is complete."""
    return examples.select("skill", "workplace_example").join(
        evidence.select("skill", "workplace_example").distinct(), ["skill", "workplace_example"], "left_anti"
    )


def require_evidence(evidence: DataFrame, examples: DataFrame) -> DataFrame:
    missing = missing_evidence(evidence, examples)
    first = missing.orderBy("skill", "workplace_example").take(20)
    if first:
        raise ValueError(f"no evidence for {missing.count()} examples, first of all {[tuple(r) for r in first]}")
    return evidence


def role_family_frame(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, [(n, f) for n, f in enumerate(roles.ROLE_FAMILIES)], "position int, role_family string")
