"""Scores, filters, scopes and key figures over line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide import storage
from jobtide.functions import scoring
from jobtide.operators import certifications as ce
from jobtide.operators import enrich, filters, gaps, kpis
from jobtide.operators.quality import run_quality
from jobtide.plans.scope import scope
from jobtide.values import roles
from workload import bindings as b
from workload.registry import query

GAP_LIST = ", ".join(gaps.GAP_COLUMNS)
AS_OF = "2001-12-31 00:00:00"


def part_gaps(spark, sf):
    # written once, with the columns that are read, as the medians go over the jobs twice
    jobs = storage.copied(spark, b.part_jobs(spark, sf).select("skills", "salary_min", "salary_max"), "gap-jobs")
    return gaps.skill_gap_summary(jobs, b.part_courses(spark, sf), b.part_taxonomy())


def doubled(df):
    """Nullable counts as doubles, so both engines hand them over alike."""
    return df.withColumn("bls_wage_year", F.col("bls_wage_year").cast("double"))


@query("skill_gap_summary", f"WITH {b.PART_GAPS_SQL} SELECT {GAP_LIST} FROM gaps ORDER BY opportunity_index DESC, gap_score DESC, job_demand DESC, skill")
def skill_gap_summary(spark, sf):
    return doubled(part_gaps(spark, sf)).select(*gaps.GAP_COLUMNS)


@query("salary_baseline", f"WITH {b.PART_JOBS_SQL} SELECT round(median((salary_min + salary_max) / 2), 4) AS baseline FROM pjobs")
def salary_baseline(spark, sf):
    return gaps.salary_baseline(b.part_jobs(spark, sf)).select(F.round("baseline", 4).alias("baseline"))


@query("salary_premium", f"WITH {b.PART_GAPS_SQL} SELECT skill, round(med, 4) AS median_salary, salary_premium_score FROM tot JOIN gaps USING (skill) WHERE tot.job_demand > 0")
def salary_premium(spark, sf):
    return gaps.salary_premium(b.part_jobs(spark, sf), b.part_taxonomy()).select(
        "skill", F.round("median_salary", 4).alias("median_salary"), "salary_premium_score")


@query("occupation_profile", f"""
WITH {b.EVIDENCE_SQL}, used AS (SELECT DISTINCT p_brand AS skill FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT skill, salary_evidence, growth_evidence, socs AS onet_soc_codes, titles AS onet_occupations, wage::DOUBLE AS onet_wage_median_annual, outlook AS onet_growth_outlook,
  round_even(growth, 1) AS bls_growth_percent, openings::DOUBLE AS onet_projected_openings, urls AS onet_reference_url
FROM evidence JOIN used USING (skill)""")
def occupation_profile(spark, sf):
    part = b.table(spark, sf, "part")
    used = part.select(F.col("p_brand").alias("skill")).union(part.select("p_type")).distinct()
    evidence = enrich.skill_evidence(spark, b.part_taxonomy())
    return used.join(evidence, "skill").select(
        "skill", "salary_evidence", "growth_evidence", "onet_soc_codes", "onet_occupations", "onet_wage_median_annual", "onet_growth_outlook",
        "bls_growth_percent", "onet_projected_openings", "onet_reference_url")


@query("score_functions", """
SELECT p_partkey, CASE WHEN p_size >= 75 THEN 'High-value' WHEN p_size >= 60 THEN 'Good bet' WHEN p_size >= 45 THEN 'Balanced' ELSE 'Lower priority' END AS label,
  CASE WHEN p_size - 25 >= 2 THEN 'High opportunity' WHEN p_size - 25 = 1 THEN 'Emerging opportunity' WHEN p_size - 25 = 0 THEN 'Balanced' ELSE 'Course-heavy' END AS status,
  CAST(round_even(p_size / 50.0::DOUBLE * 100.0, 0) AS INTEGER) AS share, CAST(greatest(40, least(90, round_even(40.0 + p_size::DOUBLE / 35.0 * 50.0, 0))) AS INTEGER) AS growth
FROM part""")
def score_functions(spark, sf):
    scoring.register_sql_functions(spark)
    return b.table(spark, sf, "part").select(
        "p_partkey", F.expr("opportunity_label(p_size)").alias("label"), F.expr("gap_status(p_size - 25)").alias("status"),
        scoring.normalize_count(F.col("p_size"), F.lit(50)).alias("share"), scoring.growth_score(F.col("p_size").cast("double")).cast("int").alias("growth"))


@query("source_confidence", f"""
SELECT c_custkey, {b.sql_case(b.SEGMENT_LABELS, 'c_mktsegment', 'test_source')} AS source_confidence FROM customer""")
def source_confidence(spark, sf):
    named = b.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("source_name"))
    return enrich.add_source_confidence(named, b.SEGMENT_LABELS).drop("source_name")


@query("skill_lookups", f"""
WITH x(skill, category, g, s, t, d, roles, families) AS (VALUES {b.TAX_ROWS}), p AS (SELECT p_partkey, p_brand AS skill FROM part)
SELECT p.p_partkey, p.skill, coalesce(x.roles, 'Technology professional') AS target_job_roles, coalesce(x.families, 'Other Technology') AS role_families,
  CASE WHEN x.skill IN ('Brand#3','Brand#6','Brand#9','Brand#12','Brand#15','Brand#18') THEN 'Data & Analytics|Database' ELSE 'Other Technology' END AS cert_families
FROM p LEFT JOIN x ON p.skill = x.skill""")
def skill_lookups(spark, sf):
    tax = b.part_taxonomy()
    parts = b.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("skill"))
    return parts.join(tax.attributes(spark).select("skill", "target_job_roles", "role_families").hint("broadcast"), "skill", "left").select(
        "p_partkey", "skill", F.coalesce("target_job_roles", F.lit("Technology professional")).alias("target_job_roles"),
        F.coalesce("role_families", F.lit("Other Technology")).alias("role_families"),
        enrich.certification_families(F.col("skill"), tax).alias("cert_families"))


@query("to_records", """
SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","label":null,"extra":0}' AS record FROM supplier""")
def to_records(spark, sf):
    rows = b.table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit(None).cast("string").alias("label"))
    return enrich.to_records(enrich.ensure_columns(rows, {"extra": 0, "label": "x"}))


# --- filters ------------------------------------------------------------------------------------

JOB_COLUMNS = ["source_name", "external_id", "company", "remote_type", "role_family", "location"]


@query("filter_jobs", f"""
WITH {b.PART_JOBS_SQL} SELECT {', '.join(JOB_COLUMNS)} FROM pjobs
WHERE list_contains(skills, 'PROMO') AND contains(lower(company), 'supplier 1') AND remote_type = 'Remote' AND role_family = 'Database'
ORDER BY source_name, external_id LIMIT 100""")
def filter_jobs(spark, sf):
    return filters.filter_jobs(b.part_jobs(spark, sf), "promo", "SUPPLIER 1", "remote", "database").select(*JOB_COLUMNS)


@query("filter_courses", f"""
WITH {b.PART_JOBS_SQL} SELECT source_name, external_id, platform, level FROM pcourses
WHERE list_contains(skills, 'Brand#7') AND contains(lower(platform), 'o') AND level = 'Advanced' AND list_contains(role_families, 'Database')
ORDER BY source_name, external_id LIMIT 100""")
def filter_courses(spark, sf):
    return filters.filter_courses(b.part_courses(spark, sf), "brand#7", "O", "advanced", "database").select("source_name", "external_id", "platform", "level")


@query("filter_gaps", f"""
WITH {b.PART_GAPS_SQL} SELECT skill, category, gap_score, opportunity_index, opportunity_label, status FROM gaps
WHERE contains(lower(status), 'opportunity') AND category = 'Brand' AND gap_score >= 10 AND opportunity_index >= 50 AND role_families LIKE '%Other Technology%'""")
def filter_gaps(spark, sf):
    return filters.filter_skill_gaps(part_gaps(spark, sf), "OPPORTUNITY", "brand", 10, 50, role_family="other technology").select(
        "skill", "category", "gap_score", "opportunity_index", "opportunity_label", "status")


@query("filter_trends", f"""
WITH {b.TRENDS_SQL} SELECT run_id, run_timestamp, source_name, skill, location, role_category, job_count, course_count FROM trends
WHERE contains(skill, 'i') AND contains(source_name, 'src') AND location = 'loc1' AND contains(lower(role_category), 'data') AND role_family = 'Data & Analytics'
ORDER BY run_timestamp, skill, source_name, location, role_category, role_family LIMIT 1000""")
def filter_trends(spark, sf):
    return filters.filter_skill_trends(b.trends(spark, sf), "I", "src", "LOC1", "data", "data & analytics").select(
        "run_id", "run_timestamp", "source_name", "skill", "location", "role_category", "job_count", "course_count")


@query("filter_sources", f"""
WITH {b.TRENDS_SQL} SELECT source_name, skill, sum(job_count)::BIGINT AS jobs FROM trends WHERE source_name IN ('src1', 'src3') AND skill IN ('click', 'error') GROUP BY 1, 2""")
def filter_sources(spark, sf):
    kept = filters.filter_trends(b.trends(spark, sf), ("src1", "src3"), ["click", "error"])
    return kept.groupBy("source_name", "skill").agg(F.sum("job_count").alias("jobs"))


@query("filter_gap_ui", f"""
WITH {b.PART_GAPS_SQL}, kept AS (SELECT skill FROM gaps WHERE category = 'Type' AND opportunity_label IN ('High-value', 'Good bet') AND opportunity_index >= 61),
m AS (SELECT run_id, unnest(skills) AS skill FROM pjobs)
SELECT run_id, skill, count(*) AS jobs FROM m WHERE skill IN (SELECT skill FROM kept) GROUP BY 1, 2""")
def filter_gap_ui(spark, sf):
    # written once, with the columns that are read: the mentions and both passes of the medians start from them
    jobs = storage.copied(spark, b.part_jobs(spark, sf).select("run_id", "skills", "salary_min", "salary_max"), "gap-jobs")
    mentions = gaps.explode_skills(jobs, "run_id").groupBy("run_id", "skill").agg(F.count(F.lit(1)).alias("jobs"))
    scored = gaps.skill_gap_summary(jobs, b.part_courses(spark, sf), b.part_taxonomy())
    _, kept = filters.filter_gap_ui(scored, mentions, ["Type"], ["High-value", "Good bet"], 61)
    return kept.select("run_id", "skill", "jobs")


@query("search_skills", f"""
WITH {b.PART_GAPS_SQL} SELECT skill, category, target_job_roles, opportunity_index FROM gaps
WHERE (contains(lower(skill), '#1') OR contains(lower(target_job_roles), 'maker')) AND category = 'Brand' AND opportunity_index >= 30""")
def search_skills(spark, sf):
    return filters.search_skills(part_gaps(spark, sf), "#1", "Brand", 30).unionByName(
        filters.search_skills(part_gaps(spark, sf), "MAKER", "Brand", 30)).select("skill", "category", "target_job_roles", "opportunity_index").distinct()


@query("any_of", f"""
WITH {b.PART_JOBS_SQL} SELECT source_name, external_id, array_to_string(skills, '|') AS skills FROM pcourses
WHERE regexp_matches(array_to_string(skills, '|'), '(?i)brand#2|promo') ORDER BY source_name, external_id LIMIT 50""")
def any_of(spark, sf):
    found = filters.courses_for_any(b.part_courses(spark, sf), ["brand#2", "promo"])
    return found.select("source_name", "external_id", F.concat_ws("|", "skills").alias("skills"))


def scoped(spark, sf, family="Database"):
    outputs = {"jobs": b.part_jobs(spark, sf), "courses": b.part_courses(spark, sf), "trend_history": b.trends(spark, sf), "skill_gaps": part_gaps(spark, sf)}
    return scope(outputs, "live", family, b.part_taxonomy(), b.VIEWS, b.certifications(spark, sf))


_SCOPE_SQL = f"""{b.PART_JOBS_SQL},
sjobs AS (SELECT * FROM pjobs WHERE source_name IN ('AUTOMOBILE', 'MACHINERY') AND role_family = 'Database'),
scourses AS (SELECT * FROM pcourses WHERE source_name IN ('cat_economy', 'cat_promo') AND list_contains(role_families, 'Database')),
{b.EVIDENCE_SQL}, {b.gap_sql('sjobs', 'scourses')}"""


@query("scope_view", f"WITH {_SCOPE_SQL} SELECT skill, job_demand, course_supply, gap_score, demand_score, salary_premium_score, course_supply_score, opportunity_index, status FROM gaps")
def scope_view(spark, sf):
    return scoped(spark, sf)["skill_gaps"].select(
        "skill", "job_demand", "course_supply", "gap_score", "demand_score", "salary_premium_score", "course_supply_score", "opportunity_index", "status")


@query("scope_certifications", f"WITH {_SCOPE_SQL}, {b.CERTS_SQL} SELECT skill, certification_name, provider, recommendation_score, market_priority FROM recs")
def scope_certifications(spark, sf):
    return scoped(spark, sf)["certifications"].select("skill", "certification_name", "provider", "recommendation_score", "market_priority")


# --- certifications -----------------------------------------------------------------------------

def recommendations(spark, sf):
    return ce.certification_recommendations(b.certifications(spark, sf), part_gaps(spark, sf), b.part_taxonomy(), ordinal="ordinal")


CERT_COLUMNS = "skill, certification_name, provider, level, free_or_paid, priority_score, url, market_priority, recommendation_score, opportunity_label, source_name, source_confidence"


@query("cert_recommend", f"""
WITH {b.PART_GAPS_SQL}, {b.CERTS_SQL}
SELECT {CERT_COLUMNS.replace(', source_name, source_confidence', '')}, 'curated_certification_catalog' AS source_name, 'curated_demo' AS source_confidence FROM recs""")
def cert_recommend(spark, sf):
    return recommendations(spark, sf).select(*CERT_COLUMNS.split(", "))


@query("cert_summary", f"""
WITH {b.PART_GAPS_SQL}, {b.CERTS_SQL}
SELECT count(*) AS recommendations, count(*) FILTER (WHERE free_or_paid = 'Free') AS free, count(DISTINCT provider) AS providers,
  CAST(floor(avg(recommendation_score) + 0.5) AS BIGINT) AS mean_score FROM recs""")
def cert_summary(spark, sf):
    return ce.certification_summary(recommendations(spark, sf))


@query("filter_certs", f"""
WITH {b.PART_GAPS_SQL}, {b.CERTS_SQL} SELECT skill, certification_name, free_or_paid, recommendation_score FROM recs
WHERE contains(lower(skill), 'brand#1') AND free_or_paid = 'Paid' ORDER BY recommendation_score DESC, skill, certification_name LIMIT 100""")
def filter_certs(spark, sf):
    return filters.filter_certifications(recommendations(spark, sf), "BRAND#1", "paid").select("skill", "certification_name", "free_or_paid", "recommendation_score")


@query("search_certs", f"""
WITH {b.PART_GAPS_SQL}, {b.CERTS_SQL} SELECT skill, certification_name, provider, free_or_paid FROM recs
WHERE contains(lower(concat_ws(' ', skill, certification_name, provider, target_roles)), 'ring promo') AND free_or_paid = 'Free'""")
def search_certs(spark, sf):
    return filters.search_certifications(recommendations(spark, sf), "Ring PROMO", "Free").select("skill", "certification_name", "provider", "free_or_paid")


# --- key figures --------------------------------------------------------------------------------

def quality(spark, sf):
    jobs, courses = b.part_jobs(spark, sf), b.part_courses(spark, sf)
    return run_quality(jobs, courses, gaps.skill_support(jobs, courses), AS_OF)


#: The sixteen checks of the parts; the domains of the jobs are no trusted ones, and the courses have no dates.
QUALITY_SQL = """
qj AS (SELECT count(*) AS n, count(*) - count(DISTINCT (source_name, external_id)) AS dup, count(*) FILTER (WHERE salary_min < 20000 OR salary_max > 500000 OR salary_min > salary_max) AS bad,
  count(*) FILTER (WHERE NOT regexp_matches(source_confidence, '^(live_verified|live_broad|curated_demo|fallback_learning|test_source)$')) AS labels,
  count(*) FILTER (WHERE date_diff('day', CAST(posted_at AS DATE), DATE '2001-12-31') > 365) AS stale, count(*) FILTER (WHERE CAST(posted_at AS DATE) > DATE '2001-12-31') AS ahead FROM pjobs),
qc AS (SELECT count(*) AS n, count(*) - count(DISTINCT (source_name, external_id)) AS dup, count(*) - count(DISTINCT url) AS urls FROM pcourses),
qs AS (SELECT skill, sum(n) AS n FROM (SELECT unnest(skills) AS skill, 1 AS n FROM pjobs UNION ALL SELECT unnest(skills), 1 FROM pcourses) GROUP BY 1),
quality AS (
  SELECT 'jobs' AS dataset, 'required_fields_present' AS check_name, 'pass' AS status, 'high' AS severity, 0::BIGINT AS failed_count
  UNION ALL SELECT 'courses', 'required_fields_present', 'pass', 'high', 0
  UNION ALL SELECT 'jobs', 'duplicate_records', if(dup = 0, 'pass', 'fail'), 'medium', dup FROM qj
  UNION ALL SELECT 'courses', 'duplicate_records', if(dup = 0, 'pass', 'fail'), 'medium', dup FROM qc
  UNION ALL SELECT 'courses', 'duplicate_urls', if(urls = 0, 'pass', 'fail'), 'medium', urls FROM qc
  UNION ALL SELECT 'jobs', 'salary_range_valid', if(bad = 0, 'pass', 'fail'), if(bad = 0, 'medium', 'high'), bad FROM qj
  UNION ALL SELECT 'jobs', 'skills_extracted', 'pass', 'medium', 0 UNION ALL SELECT 'courses', 'skills_extracted', 'pass', 'medium', 0
  UNION ALL SELECT 'jobs', 'trusted_source_domains', if(n = 0, 'pass', 'warning'), 'medium', n FROM qj UNION ALL SELECT 'courses', 'trusted_source_domains', 'pass', 'medium', 0
  UNION ALL SELECT 'jobs', 'source_confidence_labels', if(labels = 0, 'pass', 'warning'), 'medium', labels FROM qj UNION ALL SELECT 'courses', 'source_confidence_labels', 'pass', 'medium', 0
  UNION ALL SELECT 'jobs', 'posting_date_freshness', if(stale + ahead = 0, 'pass', 'warning'), 'low', stale + ahead FROM qj UNION ALL SELECT 'courses', 'course_freshness', 'warning', 'low', 0
  UNION ALL SELECT 'pipeline', 'sample_size_ready', if(qj.n >= 30 AND qc.n >= 30, 'pass', 'warning'), 'high', if(qj.n >= 30 AND qc.n >= 30, 0, 1) FROM qj, qc
  UNION ALL SELECT 'skill_gaps', 'skill_gap_support', if(count(*) FILTER (WHERE n >= 3) >= 3, 'pass', 'warning'), 'high', count(*) FILTER (WHERE n < 3) FROM qs)"""


@query("kpis", f"""
WITH {b.PART_GAPS_SQL}, {b.TRENDS_SQL}, {QUALITY_SQL}
SELECT (SELECT count(*) FROM pjobs) AS job_postings, (SELECT count(*) FROM pcourses) AS course_listings, (SELECT count(DISTINCT skill) FROM gaps) AS unique_skills,
  (SELECT count(*) FROM gaps WHERE status = 'High opportunity') AS high_opportunity_skills, (SELECT count(*) FROM gaps WHERE opportunity_label = 'High-value') AS high_value_skills,
  (SELECT count(*) FROM trends) AS trend_snapshot_rows, (SELECT count(DISTINCT run_id) FROM trends) AS historical_runs_available, 1.0::DOUBLE AS job_skill_coverage, 1.0::DOUBLE AS course_skill_coverage,
  (SELECT skill FROM gaps ORDER BY opportunity_index DESC, skill LIMIT 1) AS top_opportunity_skill, (SELECT skill FROM gaps ORDER BY gap_score DESC, skill LIMIT 1) AS top_gap_skill,
  (SELECT skill FROM gaps ORDER BY gap_score, skill LIMIT 1) AS top_course_heavy_skill, (SELECT count(*) FROM quality WHERE status <> 'pass') AS quality_warnings""")
def kpi_row(spark, sf):
    return kpis.kpis(b.part_jobs(spark, sf), b.part_courses(spark, sf), part_gaps(spark, sf), b.trends(spark, sf), quality(spark, sf)).drop("run_id")


@query("coverage", f"""
WITH {b.TEXT_JOBS_SQL} SELECT round_even(avg(CASE WHEN l.external_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE), 4) AS coverage FROM job_src LEFT JOIN job_lists l USING (external_id)""")
def coverage(spark, sf):
    return kpis.skill_coverage(b.text_jobs(spark, sf))


@query("source_summary", f"""
WITH {b.PART_JOBS_SQL} SELECT 'jobs' AS dataset, source_name, source_confidence, count(*) AS record_count FROM pjobs GROUP BY 2, 3
UNION ALL SELECT 'courses', source_name, source_confidence, count(*) FROM pcourses GROUP BY 2, 3""")
def source_summary(spark, sf):
    return kpis.source_summary(b.part_jobs(spark, sf), b.part_courses(spark, sf))


@query("source_totals", f"""
WITH {b.PART_JOBS_SQL} SELECT (SELECT count(*) FROM pjobs) AS job_records, (SELECT count(*) FROM pcourses) AS course_records,
  (SELECT count(DISTINCT source_name) FROM pjobs WHERE source_confidence = 'live_verified') AS live_verified,
  (SELECT count(DISTINCT source_name) FROM pjobs) + (SELECT count(DISTINCT source_name) FROM pcourses) AS sources""")
def source_totals(spark, sf):
    return kpis.source_totals(kpis.source_summary(b.part_jobs(spark, sf), b.part_courses(spark, sf)))


@query("role_family_counts", f"""
WITH {b.PART_JOBS_SQL}, f(role_family) AS (VALUES {b.sql_values([(r,) for r in roles.ROLE_FAMILIES])}), c AS (SELECT role_family, count(*) AS n FROM pjobs GROUP BY 1)
SELECT role_family, coalesce(n, 0) AS job_count FROM f LEFT JOIN c USING (role_family)""")
def role_family_counts(spark, sf):
    return kpis.role_family_counts(b.part_jobs(spark, sf))


@query("run_log", f"""
WITH {b.PART_GAPS_SQL}, {b.TRENDS_SQL}
SELECT 'r1' AS run_id, (SELECT count(*) FROM pjobs) AS job_records, (SELECT count(*) FROM pcourses) AS course_records, (SELECT count(DISTINCT skill) FROM gaps) AS unique_skills,
  (SELECT count(*) FROM trends) AS trend_rows, (SELECT skill FROM gaps ORDER BY opportunity_index DESC, gap_score DESC, job_demand DESC, skill LIMIT 1) AS top_opportunity_skill, 'skipped' AS warehouse""")
def run_log(spark, sf):
    return kpis.run_summary(b.part_jobs(spark, sf), b.part_courses(spark, sf), part_gaps(spark, sf), b.trends(spark, sf), "r1", "2026-07-01", "skipped").drop("run_timestamp")


@query("skill_profile", f"""
WITH {b.PART_GAPS_SQL}
SELECT 'gap' AS part, skill AS key, opportunity_index::BIGINT AS n FROM gaps WHERE skill = 'PROMO'
UNION ALL SELECT 'jobs', 'count', (SELECT count(*) FROM pjobs WHERE list_contains(skills, 'PROMO'))
UNION ALL SELECT 'courses', 'count', (SELECT count(*) FROM pcourses WHERE list_contains(skills, 'PROMO'))
UNION ALL SELECT 'sample_jobs', external_id, 0 FROM (SELECT * FROM pjobs WHERE list_contains(skills, 'PROMO') ORDER BY source_name, external_id LIMIT 10)
UNION ALL SELECT 'sample_courses', external_id, 0 FROM (SELECT * FROM pcourses WHERE list_contains(skills, 'PROMO') ORDER BY source_name, external_id LIMIT 10)""")
def skill_profile(spark, sf):
    p = kpis.skill_profile("promo", b.part_jobs(spark, sf), b.part_courses(spark, sf), part_gaps(spark, sf))
    zero = F.lit(0).cast("long")
    return (
        p["gap"].select(F.lit("gap").alias("part"), F.col("skill").alias("key"), F.col("opportunity_index").cast("long").alias("n"))
        .union(p["counts"].select(F.lit("jobs"), F.lit("count"), "job_count"))
        .union(p["counts"].select(F.lit("courses"), F.lit("count"), "course_count"))
        .union(p["sample_jobs"].select(F.lit("sample_jobs"), "external_id", zero))
        .union(p["sample_courses"].select(F.lit("sample_courses"), "external_id", zero)))


@query("skill_samples", f"""
WITH {b.PART_JOBS_SQL}, m AS (SELECT unnest(skills) AS skill, source_name, external_id FROM pjobs)
SELECT skill, source_name, external_id FROM m QUALIFY row_number() OVER (PARTITION BY skill ORDER BY source_name, external_id) <= 10""")
def skill_samples(spark, sf):
    return kpis.samples_per_skill(b.part_jobs(spark, sf)).select("skill", "source_name", "external_id")
