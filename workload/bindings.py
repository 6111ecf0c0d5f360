"""The generated tables seen as jobs, courses, trends, certifications and logs.

Each binding exists twice: as a DataFrame for the operators and as a SQL common table expression
for the checks.  All of them cover the whole tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import schemas
from jobtide.operators.enrich import normalize_courses, normalize_jobs, source_confidence
from jobtide.taxonomy import Occupation, Skill, Taxonomy, lookup

COLLECTED = "2026-07-01 00:00:00"


# declared, so that no read opens files to infer a schema
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


# --- taxonomies ---------------------------------------------------------------------------------

# words that occur in the generated texts: skill, category, patterns, the terms they can match
WORDS = [
    ("That", "English", (r"\bthat\b",), ("that",)),
    ("With", "English", (r"\bwith\b", r"\bwith the\b"), ("with", "with the")),
    ("This", "English", (r"\bthis\b",), ("this",)),
    ("From", "English", (r"\bfrom\b",), ("from",)),
    ("Stems", "Stem", (r"\b(?:ther|thon)\b", r"\btion[s]?\b"), ("ther", "thon", "tion", "tions")),
    ("Dans", "French", (r"\bdans\b",), ("dans",)),
    ("Pour", "French", (r"\bpour\b", r"\bpour la\b"), ("pour", "pour la")),
    ("Avec", "French", (r"\bavec\b",), ("avec",)),
    ("Nicht", "German", (r"\bnicht\b",), ("nicht",)),
    ("Und", "German", (r"\bund\b", r"\bund der\b"), ("und", "und der")),
    ("Los", "Spanish", (r"\blos\b",), ("los",)),
    ("Para", "Spanish", (r"\bpara\b",), ("para",)),
]
TEXT_FAMILIES = {
    "English": ("Data & Analytics", "Database"), "Stem": ("Software Engineering",), "French": ("Cloud & Platform",),
    "German": ("IT & Security", "Data & Analytics"), "Spanish": ("Technology Consulting",),
}
TEXT_SOURCES = {f"src{n}": label for n, label in enumerate(["live_verified", "live_broad", "curated_demo", "fallback_learning"] * 4)}


@cache
def text_taxonomy() -> Taxonomy:
    skills = tuple(
        Skill(name, category, patterns, (), (), 40 + 5 * n, 45 + 3 * n, 70 - 4 * n, "Growing" if n % 2 else "Stable")
        for n, (name, category, patterns, _) in enumerate(WORDS)
    )
    return Taxonomy(skills=skills, category_families=TEXT_FAMILIES)


# one skill per part brand and type; the last brands are left unknown to exercise the defaults
OCCUPATIONS = (
    Occupation("11-1", "Fitters", 90_000, "Average", 1_000, 5.0, "https://b.example.org/1", "https://o.example.org/1"),
    Occupation("11-2", "Turners", 120_500, "Faster than average", 2_500, 17.5, "https://b.example.org/2", "https://o.example.org/2"),
    Occupation("11-3", "Welders", 99_000, "Declining", 300, 41.0, "https://b.example.org/1", "https://o.example.org/3"),
)
PROFILES = {"Brand#1": ("11-1", "11-2"), "Brand#2": ("11-3",), "Brand#3": ("11-2", "11-3"), "Brand#11": ("11-1",), "PROMO": ("11-1", "11-2", "11-3")}
EXAMPLES = {"Brand#1": ("Lathe", "Vise"), "PROMO": ("Banner",)}
PART_TYPES = ("ECONOMY", "PROMO", "MEDIUM", "LARGE", "STANDARD", "SMALL")


@cache
def part_taxonomy() -> Taxonomy:
    brands = [
        Skill(f"Brand#{n}", "Brand", (), ("Data & Analytics", "Database") if n % 3 == 0 else (), ("Maker",) if n % 4 == 0 else (),
              30 + n, 80 - 2 * n, 20 + 2 * n, "Growing" if n % 2 else "Stable")
        for n in range(1, 21)
    ]
    types = [Skill(t, "Type", (), (), (), 55 + n, 50 + n, 40 + n, "Stable") for n, t in enumerate(PART_TYPES)]
    return Taxonomy(
        skills=tuple(brands + types),
        category_families={"Type": ("Cloud & Platform",)},
        job_roles={"Brand#1": ("Fitter", "Turner")},
        occupations=OCCUPATIONS,
        skill_occupations=PROFILES,
        examples=EXAMPLES,
    )


SEGMENT_LABELS = {"AUTOMOBILE": "live_verified", "BUILDING": "live_broad", "FURNITURE": "curated_demo", "MACHINERY": "live_verified"}
VIEWS = {"all": (None, None), "live": (("AUTOMOBILE", "MACHINERY"), ("cat_economy", "cat_promo")), "none": (("NOBODY",), ("NOTHING",))}


def sql_values(rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def sql_case(mapping: dict, col: str, default: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE {'NULL' if default is None else repr(default)} END"


# --- documents as raw job postings, conversation turns as raw courses ---------------------------

def raw_jobs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    items = d.select(
        F.col("doc_id").cast("string").alias("external_id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.concat(F.lit("Company "), F.col("source")).alias("company"),
        F.col("lang").alias("location"),
        F.when(F.col("n_chars") > 2000, "Remote").when(F.col("n_chars") > 500, "Hybrid").otherwise("On-site").alias("remote_type"),
        (F.col("n_chars") + 20000).alias("salary_min"),
        F.expr("((n_chars + 20000) * 5) div 4").alias("salary_max"),
        F.col("text").alias("description"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.expr("cast(doc_id % 1000 as int)")), "yyyy-MM-dd").alias("posted_at"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id")).alias("url"),
        F.col("source"),
    )
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.JOB_PAYLOAD.fields]
    return items.select(
        F.col("source").alias("source_name"), F.lit("job_posting").alias("source_type"), F.col("url").alias("source_url"),
        F.lit(COLLECTED).cast("timestamp").alias("collected_at"), F.struct(*fields).alias("payload"),
    )


def text_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_jobs(raw_jobs(spark, sf), text_taxonomy(), labels=TEXT_SOURCES)


def raw_courses(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    payload = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("external_id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("role").alias("platform"),
        F.when(F.col("turn") < 2, "Beginner").otherwise("Advanced").alias("level"),
        (F.col("turn") / 2).alias("rating"),
        F.length("text").cast("double").alias("duration_minutes"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("subjects"),
        F.lit(None).cast("string").alias("roles"),
        F.lit(None).cast("string").alias("products"),
        F.date_format(F.date_add(F.lit("2023-06-01").cast("date"), F.expr("cast(conv_id % 1200 as int)")), "yyyy-MM-dd").alias("last_modified"),
        F.concat(F.lit("https://chat.example.org/"), F.col("conv_id")).alias("url"),
    )
    return c.select(
        F.concat(F.lit("chat_"), F.col("role")).alias("source_name"), F.lit("course_listing").alias("source_type"),
        payload["url"].alias("source_url"), F.lit(COLLECTED).cast("timestamp").alias("collected_at"), payload.alias("payload"),
    )


def text_courses(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_courses(raw_courses(spark, sf), text_taxonomy(), labels=TEXT_SOURCES)


_NW = r"[^\p{L}\p{N}_]"
_SP = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_normalized(text: str) -> str:
    return (
        f"lower(trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace({text}, 'c\\+\\+', ' cpp ', 'gi'), "
        f"'c#', ' csharp ', 'gi'), '&', ' and '), '[/_+-]', ' ', 'g'), '{_SP}+', ' ', 'g'), ' '))"
    )


WORD_ROWS = sql_values([(s, c, t) for s, c, _, terms in WORDS for t in terms])

TEXT_JOBS_SQL = f"""
job_src AS (
  SELECT source AS source_name, CAST(doc_id AS VARCHAR) AS external_id, split_part(text, '.', 1) AS title,
    'Company ' || source AS company, lang AS location,
    CASE WHEN n_chars > 2000 THEN 'Remote' WHEN n_chars > 500 THEN 'Hybrid' ELSE 'On-site' END AS remote_type,
    n_chars + 20000 AS salary_min, ((n_chars + 20000) * 5) // 4 AS salary_max, text AS description,
    strftime(DATE '2024-01-01' + CAST(doc_id % 1000 AS INTEGER), '%Y-%m-%d') AS posted_at,
    'https://' || source || '.example.com/' || doc_id AS url
  FROM documents),
job_text AS (
  SELECT *, {sql_normalized("replace(concat_ws(' ', title, description, company, location, remote_type), '|', ' ')")} AS norm FROM job_src),
words(skill, category, term) AS (VALUES {WORD_ROWS}),
job_match AS (
  SELECT source_name, external_id, skill, any_value(category) AS category, list_sort(list(term)) AS terms,
    round_even(least(1.0, 0.65 + 0.1 * count(*))::DOUBLE, 2) AS confidence
  FROM job_text, words WHERE regexp_matches(norm, '(^|{_NW})' || term || '({_NW}|$)')
  GROUP BY source_name, external_id, skill),
job_lists AS (
  SELECT external_id, string_agg(skill, '|' ORDER BY lower(skill)) AS skills, array_to_string(list_sort(list_distinct(list(category))), '|') AS skill_categories,
    string_agg(skill || ':' || array_to_string(terms, ','), '|' ORDER BY lower(skill)) AS skill_match_terms,
    round_even(sum(CAST(confidence * 100 AS INTEGER)) / 100.0 / count(*), 2)::DOUBLE AS skill_confidence, CAST(count(*) AS INTEGER) AS skill_count
  FROM job_match GROUP BY external_id)"""

TEXT_COURSES_SQL = f"""
course_src AS (
  SELECT 'chat_' || role AS source_name, conv_id || '-' || turn AS external_id, split_part(text, '.', 1) AS title, role AS platform,
    CASE WHEN turn < 2 THEN 'Beginner' ELSE 'Advanced' END AS level, text AS description,
    strftime(DATE '2023-06-01' + CAST(conv_id % 1200 AS INTEGER), '%Y-%m-%d') AS last_modified,
    'https://chat.example.org/' || conv_id AS url
  FROM conversations),
course_text AS (
  SELECT *, {sql_normalized("replace(concat_ws(' ', title, description, platform), '|', ' ')")} AS norm FROM course_src),
course_match AS (
  SELECT external_id, skill, any_value(category) AS category, list_sort(list(term)) AS terms
  FROM course_text, words WHERE regexp_matches(norm, '(^|{_NW})' || term || '({_NW}|$)')
  GROUP BY external_id, skill)"""

# --- line items as jobs, parts as courses and certifications ------------------------------------

FAMILIES = {"F": "Data & Analytics", "O": "Database", "P": "Cloud & Platform"}
REMOTE = {"A": "Remote", "N": "Hybrid", "R": "On-site"}


def part_jobs(spark: SparkSession, sf: str) -> DataFrame:
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = (
        line.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.concat(F.date_format("l_shipdate", "yyyyMM"), F.lit("01_000000")).alias("run_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("external_id"),
        F.col("c_mktsegment").alias("source_name"),
        source_confidence(F.col("c_mktsegment"), SEGMENT_LABELS).alias("source_confidence"),
        F.col("p_name").alias("title"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey")).alias("company"),
        F.col("n_name").alias("location"),
        F.col("o_orderpriority").alias("role_category"),
        lookup(FAMILIES, F.col("o_orderstatus")).alias("role_family"),
        lookup(REMOTE, F.col("l_returnflag")).alias("remote_type"),
        # whole numbers, so that sums do not depend on the order of the rows
        F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("salary_min"),
        F.floor("l_extendedprice").cast("double").alias("salary_max"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted_at"),
        F.concat(F.lit("https://www."), F.lower("c_mktsegment"), F.lit(".example.net/"), F.col("l_orderkey")).alias("url"),
        F.array("p_brand", "p_type").alias("skills"),
        F.bround(F.lit(1.0) - F.col("l_tax"), 2).alias("skill_confidence"),
        F.lit(2).alias("skill_count"),
        F.col("l_shipdate").alias("collected_at"),
    )


def part_courses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.lit("20010801_000000").alias("run_id"),
        F.col("p_partkey").cast("string").alias("external_id"),
        F.concat(F.lit("cat_"), F.lower("p_type")).alias("source_name"),
        F.lit("curated_demo").alias("source_confidence"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("platform"),
        F.when(F.col("p_size") < 20, "Beginner").otherwise("Advanced").alias("level"),
        F.lit(None).cast("double").alias("rating"),
        F.col("p_retailprice").alias("duration_minutes"),
        F.concat(F.lit("https://learn.example.com/"), F.col("p_partkey")).alias("url"),
        F.when(F.col("p_size") > 25, F.array("p_brand", "p_type")).otherwise(F.array("p_brand")).alias("skills"),
        F.when(F.col("p_size") > 30, F.array(F.lit("Database"), F.lit("Data & Analytics"))).otherwise(F.array(F.lit("Cloud & Platform"))).alias("role_families"),
        F.lit(0.75).alias("skill_confidence"),
        F.when(F.col("p_size") > 25, 2).otherwise(1).alias("skill_count"),
        F.lit(COLLECTED).cast("timestamp").alias("collected_at"),
    )


PART_JOBS_SQL = f"""
pjobs AS (
  SELECT strftime(l_shipdate, '%Y%m') || '01_000000' AS run_id,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS external_id, c_mktsegment AS source_name,
    {sql_case(SEGMENT_LABELS, "c_mktsegment", "test_source")} AS source_confidence, p_name AS title, 'Supplier ' || l_suppkey AS company,
    n_name AS location, o_orderpriority AS role_category, {sql_case(FAMILIES, "o_orderstatus")} AS role_family,
    {sql_case(REMOTE, "l_returnflag")} AS remote_type, floor(l_extendedprice * (1 - l_discount)) AS salary_min, floor(l_extendedprice) AS salary_max,
    strftime(o_orderdate, '%Y-%m-%d') AS posted_at, 'https://www.' || lower(c_mktsegment) || '.example.net/' || l_orderkey AS url,
    [p_brand, p_type] AS skills, round_even(1.0 - l_tax, 2) AS skill_confidence, 2 AS skill_count, l_shipdate AS collected_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
pcourses AS (
  SELECT '20010801_000000' AS run_id, CAST(p_partkey AS VARCHAR) AS external_id, 'cat_' || lower(p_type) AS source_name,
    'curated_demo' AS source_confidence, p_name AS title, p_type AS platform, CASE WHEN p_size < 20 THEN 'Beginner' ELSE 'Advanced' END AS level,
    p_retailprice AS duration_minutes, 'https://learn.example.com/' || p_partkey AS url,
    CASE WHEN p_size > 25 THEN [p_brand, p_type] ELSE [p_brand] END AS skills,
    CASE WHEN p_size > 30 THEN ['Database', 'Data & Analytics'] ELSE ['Cloud & Platform'] END AS role_families,
    0.75 AS skill_confidence, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS skill_count
  FROM part)"""

_TAX = part_taxonomy()
TAX_ROWS = sql_values([
    (s.name, s.category, s.growth, s.salary, s.saturation, s.direction, _TAX.roles(s), "|".join(_TAX.families(s))) for s in _TAX.skills
])
EVIDENCE_SQL = f"""
occ(soc, title, wage, outlook, openings, growth, bls, onet) AS (VALUES {sql_values([tuple(vars(o).values()) for o in OCCUPATIONS])}),
prof(skill, pos, soc) AS (VALUES {sql_values([(s, n, c) for s, cs in PROFILES.items() for n, c in enumerate(cs)])}),
ex(skill, pos, example) AS (VALUES {sql_values([(s, n, c) for s, cs in EXAMPLES.items() for n, c in enumerate(cs)])}),
profile AS (
  SELECT skill, string_agg(soc, ' | ' ORDER BY pos) AS socs, string_agg(title, ' | ' ORDER BY pos) AS titles,
    CAST(round_even(avg(wage), 0) AS BIGINT) AS wage, array_to_string(list_sort(list_distinct(list(outlook))), ' | ') AS outlook,
    sum(openings) AS openings, avg(growth::DOUBLE) AS growth,
    array_to_string(list_sort(list_distinct(list_concat(list(onet), list(bls)))), ' | ') AS urls
  FROM prof JOIN occ USING (soc) GROUP BY skill),
examples AS (SELECT skill, string_agg(example, ' | ' ORDER BY pos) AS examples FROM ex GROUP BY skill),
evidence AS (
  SELECT p.*, examples, CAST(round_even(40 + (wage - lo)::DOUBLE / (hi - lo) * 45.0, 0) AS INTEGER) AS salary_evidence,
    CAST(greatest(40, least(90, round_even(40.0 + growth / 35.0 * 50.0, 0))) AS INTEGER) AS growth_evidence
  FROM profile p LEFT JOIN examples USING (skill), (SELECT min(wage) AS lo, max(wage) AS hi FROM profile))"""


def gap_sql(jobs: str, courses: str, prefix: str = "") -> str:
    """CTEs that score the skills of two tables with (skills, salary_min, salary_max) and (skills)."""
    p = prefix
    return f"""
{p}tax(skill, category, growth, salary, saturation, direction, roles, families) AS (VALUES {TAX_ROWS}),
{p}jm AS (SELECT unnest(skills) AS skill, (salary_min + salary_max) / 2 AS mid FROM {jobs}),
{p}jd AS (SELECT skill, count(*) AS job_demand, median(mid) AS med FROM {p}jm GROUP BY skill),
{p}cs AS (SELECT skill, count(*) AS course_supply FROM (SELECT unnest(skills) AS skill FROM {courses}) GROUP BY skill),
{p}base AS (SELECT median((salary_min + salary_max) / 2) AS b FROM {jobs}),
{p}tot AS (SELECT coalesce(jd.skill, cs.skill) AS skill, coalesce(job_demand, 0) AS job_demand, coalesce(course_supply, 0) AS course_supply, med
  FROM {p}jd jd FULL JOIN {p}cs cs ON jd.skill = cs.skill),
{p}mx AS (SELECT max(job_demand) AS mj, max(course_supply) AS mc FROM {p}tot),
{p}scored AS (
  SELECT t.skill, coalesce(x.category, 'Other') AS category, t.job_demand, t.course_supply, t.job_demand - t.course_supply AS gap_score,
    CASE WHEN t.course_supply <> 0 THEN round_even(t.job_demand::DOUBLE / t.course_supply, 2) END AS demand_supply_ratio,
    CAST(CASE WHEN mj > 0 THEN round_even(t.job_demand::DOUBLE / mj * 100.0, 0) ELSE 0 END AS INTEGER) AS demand_score,
    CAST(coalesce(e.growth_evidence, x.growth, 50) AS INTEGER) AS growth_score,
    CAST(coalesce(e.salary_evidence, CASE WHEN b > 0 THEN greatest(0, least(100, round_even(50.0 + (med - b) / b * 100.0, 0))) END, x.salary, 50) AS INTEGER) AS salary_premium_score,
    CAST(CASE WHEN mc > 0 THEN round_even(t.course_supply::DOUBLE / mc * 100.0, 0) ELSE 0 END AS INTEGER) AS course_supply_score,
    CAST(coalesce(x.saturation, 50) AS INTEGER) AS saturation_score, coalesce(x.direction, 'Stable') AS market_direction,
    coalesce(x.roles, 'Technology professional') AS target_job_roles, coalesce(x.families, 'Other Technology') AS role_families,
    CASE WHEN e.skill IS NULL THEN 'Project fallback taxonomy' WHEN e.examples IS NOT NULL THEN 'O*NET Software Skills 30.3 + BLS wage/projection references'
      ELSE 'Occupation mapping + O*NET-SOC + BLS wage/projection references' END AS taxonomy_source,
    CASE WHEN e.skill IS NULL THEN 'project_fallback' WHEN e.examples IS NOT NULL THEN 'software_skill_verified' ELSE 'occupation_mapping_only' END AS onet_evidence_status,
    coalesce(e.examples, '') AS onet_workplace_examples, coalesce(e.socs, '') AS onet_soc_codes, coalesce(e.titles, '') AS onet_occupations,
    e.wage::DOUBLE AS onet_wage_median_annual, coalesce(e.outlook, '') AS onet_growth_outlook, round_even(e.growth, 1) AS bls_growth_percent,
    CASE WHEN e.skill IS NOT NULL THEN 2024.0::DOUBLE END AS bls_wage_year, CASE WHEN e.skill IS NULL THEN '' ELSE '2024-2034' END AS bls_projection_period,
    e.openings::DOUBLE AS onet_projected_openings, coalesce(e.urls, '') AS onet_reference_url
  FROM {p}tot t LEFT JOIN {p}tax x ON t.skill = x.skill LEFT JOIN evidence e ON t.skill = e.skill, {p}mx, {p}base),
{p}indexed AS (
  SELECT *, CAST(greatest(0, least(100, round_even(50.0::DOUBLE + 0.35::DOUBLE * demand_score + 0.25::DOUBLE * growth_score + 0.25::DOUBLE * salary_premium_score
    - 0.20::DOUBLE * course_supply_score - 0.15::DOUBLE * saturation_score, 0))) AS INTEGER) AS opportunity_index FROM {p}scored),
{p}gaps AS (
  SELECT *, CASE WHEN opportunity_index >= 75 THEN 'High-value' WHEN opportunity_index >= 60 THEN 'Good bet' WHEN opportunity_index >= 45 THEN 'Balanced' ELSE 'Lower priority' END AS opportunity_label,
    CASE WHEN gap_score >= 2 THEN 'High opportunity' WHEN gap_score = 1 THEN 'Emerging opportunity' WHEN gap_score = 0 THEN 'Balanced' ELSE 'Course-heavy' END AS status
  FROM {p}indexed)"""


PART_GAPS_SQL = f"{PART_JOBS_SQL}, {EVIDENCE_SQL}, {gap_sql('pjobs', 'pcourses')}"


def certifications(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("skill"),
        F.col("p_name").alias("certification_name"),
        F.col("p_type").alias("provider"),
        F.when(F.col("p_size") < 20, "Beginner").otherwise("Intermediate").alias("level"),
        F.when(F.col("p_size") < 15, "Free").otherwise("Paid").alias("free_or_paid"),
        F.col("p_retailprice").alias("estimated_cost_usd"),
        F.concat(F.col("p_type"), F.lit(" maker | Fitter")).alias("target_roles"),
        F.concat(F.lit("https://cert.example.com/"), F.col("p_partkey")).alias("url"),
        (F.col("p_size") + 50).alias("priority_score"),
        F.col("p_partkey").alias("ordinal"),
    )


CERTS_SQL = """
certs AS (
  SELECT p_brand AS skill, p_name AS certification_name, p_type AS provider, CASE WHEN p_size < 20 THEN 'Beginner' ELSE 'Intermediate' END AS level,
    CASE WHEN p_size < 15 THEN 'Free' ELSE 'Paid' END AS free_or_paid, p_retailprice AS estimated_cost_usd, p_type || ' maker | Fitter' AS target_roles,
    'https://cert.example.com/' || p_partkey AS url, p_size + 50 AS priority_score
  FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey DESC) = 1),
recs AS (
  SELECT c.*, g.opportunity_index, g.opportunity_label, g.job_demand, g.target_job_roles, coalesce(g.opportunity_index, 0)::DOUBLE AS market_priority,
    CAST(round_even(c.priority_score * 0.55::DOUBLE + coalesce(g.opportunity_index, 0) * 0.45::DOUBLE, 0) AS INTEGER) AS recommendation_score
  FROM certs c LEFT JOIN gaps g ON c.skill = g.skill)"""

# --- events as trend history and logs -----------------------------------------------------------

ROLE_OF_USER = ("Data Engineering", "Data Science", "Data Analyst", "Other Data Role")


def trends(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    role = F.get(F.array(*[F.lit(r) for r in ROLE_OF_USER]), F.expr("cast(user_id % 4 as int)"))
    return e.select(
        F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_000000")).alias("run_id"),
        F.date_format("ts", "yyyy-MM-dd'T'00:00:00+00:00").alias("run_timestamp"),
        F.concat(F.lit("src"), F.expr("user_id % 5")).alias("source_name"),
        F.col("event_type").alias("skill"),
        F.concat(F.lit("loc"), F.expr("user_id % 3")).alias("location"),
        role.alias("role_category"),
        F.when(F.expr("user_id % 4 >= 2"), F.lit("Data & Analytics")).alias("role_family"),
        "value", "user_id",
    ).groupBy("run_id", "run_timestamp", "source_name", "skill", "location", "role_category", "role_family").agg(
        F.count(F.lit(1)).alias("job_count"), F.count_distinct("user_id").alias("course_count"),
        F.bround(F.avg("value"), 2).alias("salary_min_avg"), F.bround(F.avg(F.col("value") * 2), 2).alias("salary_max_avg"),
    )


TRENDS_SQL = f"""
trends AS (
  SELECT strftime(ts, '%Y%m%d') || '_000000' AS run_id, strftime(ts, '%Y-%m-%d') || 'T00:00:00+00:00' AS run_timestamp,
    'src' || (user_id % 5) AS source_name, event_type AS skill, 'loc' || (user_id % 3) AS location,
    {repr(list(ROLE_OF_USER))}[CAST(user_id % 4 AS INTEGER) + 1] AS role_category, CASE WHEN user_id % 4 >= 2 THEN 'Data & Analytics' END AS role_family,
    count(*) AS job_count, count(DISTINCT user_id) AS course_count, round_even(avg(value), 2) AS salary_min_avg, round_even(avg(value * 2), 2) AS salary_max_avg
  FROM events GROUP BY ALL)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_000000")).alias("run_id")).agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("run_timestamp"),
        F.count(F.lit(1)).alias("job_records"), F.count_distinct("user_id").alias("course_records"),
        F.count_distinct("event_type").alias("unique_skills"), F.max("event_type").alias("top_opportunity_skill"),
    )


RUNS_SQL = """
runs AS (
  SELECT strftime(ts, '%Y%m%d') || '_000000' AS run_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_timestamp, count(*) AS job_records,
    count(DISTINCT user_id) AS course_records, count(DISTINCT event_type) AS unique_skills, max(event_type) AS top_opportunity_skill
  FROM events GROUP BY 1)"""


def source_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(
        F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_000000")).alias("run_id"),
        F.concat(F.lit("src"), F.expr("user_id % 5")).alias("source_name"),
    ).agg(
        F.when(F.count_if(F.col("event_type") == "error") > F.count_if(F.col("event_type") == "signup"), F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.count(F.lit(1)).alias("record_count"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("completed_at"),
    )


SOURCE_RUNS_SQL = """
source_runs AS (
  SELECT strftime(ts, '%Y%m%d') || '_000000' AS run_id, 'src' || (user_id % 5) AS source_name,
    CASE WHEN count(*) FILTER (WHERE event_type = 'error') > count(*) FILTER (WHERE event_type = 'signup') THEN 'failed' ELSE 'success' END AS status,
    count(*) AS record_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS completed_at
  FROM events GROUP BY 1, 2)"""
