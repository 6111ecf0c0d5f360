"""Skill extraction, roles and text helpers over the documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide import storage
from jobtide.functions import roles as rl
from jobtide.functions import scalars as sc
from jobtide.functions import text as tx
from jobtide.operators import dedupe, enrich, gaps
from workload import bindings as b
from workload.registry import query


@query("skill_extract", f"""
WITH {b.TEXT_JOBS_SQL}
SELECT j.source_name, j.external_id, coalesce(l.skills, '') AS skills, coalesce(l.skill_categories, '') AS skill_categories,
  coalesce(l.skill_match_terms, '') AS skill_match_terms, coalesce(l.skill_confidence, 0.0)::DOUBLE AS skill_confidence, coalesce(l.skill_count, 0) AS skill_count
FROM job_src j LEFT JOIN job_lists l USING (external_id)""")
def skill_extract(spark, sf):
    jobs = b.text_jobs(spark, sf)
    return jobs.select(
        "source_name", "external_id", *[F.concat_ws("|", c).alias(c) for c in ("skills", "skill_categories", "skill_match_terms")],
        "skill_confidence", "skill_count",
    )


@query("skill_counts", f"WITH {b.TEXT_JOBS_SQL} SELECT skill, count(*) AS records FROM job_match GROUP BY skill")
def skill_counts(spark, sf):
    return gaps.skill_counts(b.text_jobs(spark, sf))


@query("skill_terms", f"""
WITH {b.TEXT_JOBS_SQL}
SELECT skill, category, term, count(*) AS records FROM (SELECT skill, category, unnest(terms) AS term FROM job_match) GROUP BY ALL""")
def skill_terms(spark, sf):
    text = tx.skill_text(*[F.col(f"payload.{c}") for c in enrich.JOB_TEXT])
    found = enrich.extract_skills(b.raw_jobs(spark, sf), text, b.text_taxonomy())
    # the outer forms: for the others the optimizer infers a filter on the list, with a copy of the matching
    each = found.select(F.explode_outer("matches").alias("m")).select("m.skill", "m.category", F.explode_outer("m.terms").alias("term"))
    per_match = each.where(F.col("term").isNotNull())
    return per_match.groupBy("skill", "category", "term").agg(F.count(F.lit(1)).alias("records"))


@query("normalize_jobs", f"""
WITH {b.TEXT_JOBS_SQL}
SELECT source_name, {b.sql_case(b.TEXT_SOURCES, 'source_name', 'test_source')} AS source_confidence, external_id, title, company, location, remote_type,
  salary_min, salary_max, posted_at, url, 'Other Technology' AS role_family
FROM job_src""")
def normalize_jobs(spark, sf):
    return b.text_jobs(spark, sf).select(
        "source_name", "source_confidence", "external_id", "title", "company", "location", "remote_type", "salary_min", "salary_max",
        "posted_at", "url", "role_family")


@query("normalize_courses", f"""
WITH {b.TEXT_JOBS_SQL}, {b.TEXT_COURSES_SQL},
fam(category, family) AS (VALUES {b.sql_values([(c, f) for c, fs in b.TEXT_FAMILIES.items() for f in fs])}),
per AS (SELECT external_id, string_agg(DISTINCT skill, '|') AS s, count(DISTINCT skill) AS n FROM course_match GROUP BY 1),
fams AS (SELECT external_id, array_to_string(list_sort(list_distinct(list(family))), '|') AS role_families FROM course_match JOIN fam USING (category) GROUP BY 1)
SELECT c.source_name, c.external_id, c.title, c.platform, c.level, c.last_modified, c.url, coalesce(f.role_families, '') AS role_families,
  CAST(coalesce(p.n, 0) AS INTEGER) AS skill_count
FROM course_src c LEFT JOIN per p USING (external_id) LEFT JOIN fams f USING (external_id)""")
def normalize_courses(spark, sf):
    return b.text_courses(spark, sf).select(
        "source_name", "external_id", "title", "platform", "level", "last_modified", "url",
        F.concat_ws("|", "role_families").alias("role_families"), "skill_count")


@query("text_skill_gaps", f"""
WITH {b.TEXT_JOBS_SQL}, {b.TEXT_COURSES_SQL},
d AS (SELECT skill, count(*) AS job_demand FROM job_match GROUP BY 1), s AS (SELECT skill, count(*) AS course_supply FROM course_match GROUP BY 1)
SELECT coalesce(d.skill, s.skill) AS skill, coalesce(job_demand, 0) AS job_demand, coalesce(course_supply, 0) AS course_supply,
  coalesce(job_demand, 0) - coalesce(course_supply, 0) AS gap_score,
  CAST(round_even(coalesce(job_demand, 0)::DOUBLE / (SELECT max(job_demand) FROM d) * 100.0, 0) AS INTEGER) AS demand_score,
  CAST(round_even(coalesce(course_supply, 0)::DOUBLE / (SELECT max(course_supply) FROM s) * 100.0, 0) AS INTEGER) AS course_supply_score
FROM d FULL JOIN s ON d.skill = s.skill""")
def text_skill_gaps(spark, sf):
    # written first, as a run of the pipeline does, since the medians read them twice
    jobs = storage.copied(spark, b.text_jobs(spark, sf).select("skills", "salary_min", "salary_max"), "text-jobs")
    courses = storage.copied(spark, b.text_courses(spark, sf).select("skills"), "text-courses")
    out = gaps.skill_gap_summary(jobs, courses, b.text_taxonomy())
    return out.select("skill", "job_demand", "course_supply", "gap_score", "demand_score", "course_supply_score")


# titles made of part names and types, with rules that use those words
ROLE_RULES = [
    ("Widget Maker", "Data & Analytics", (r"\bwidget\b",)),
    ("Ring Smith", "Software Engineering", (r"\b(small|large) ring\b", r"\bold ring economy\b")),
    ("Gear Cutter", "Cloud & Platform", (r"\bgear(?:\s+\w+){0,1}\s+promo\b",)),
    ("Bolt Turner", "Database", (r"\bbolt\b",)),
]


@query("classify_role", """
WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type || CASE WHEN p_size % 3 = 0 THEN ' engineer' WHEN p_size % 3 = 1 THEN ' systems' ELSE '' END) AS n FROM part),
r AS (SELECT p_partkey, n, CASE WHEN regexp_matches(n, '\\bwidget\\b') THEN 1 WHEN regexp_matches(n, '\\b(small|large) ring\\b|\\bold ring economy\\b') THEN 2
  WHEN regexp_matches(n, '\\bgear(?:\\s+\\w+){0,1}\\s+promo\\b') THEN 3 WHEN regexp_matches(n, '\\bbolt\\b') THEN 4
  WHEN contains(n, 'engineer') THEN 5 WHEN contains(n, 'systems') THEN 6 ELSE 7 END AS k FROM t)
SELECT p_partkey, ['Widget Maker', 'Ring Smith', 'Gear Cutter', 'Bolt Turner', 'Software Engineer', 'Other IT Role', 'Other Technology Role'][k] AS role_name,
  ['Data & Analytics', 'Software Engineering', 'Cloud & Platform', 'Database', 'Software Engineering', 'Other Technology', 'Other Technology'][k] AS role_family
FROM r""")
def classify_role(spark, sf):
    extra = F.when(F.expr("p_size % 3 = 0"), " engineer").when(F.expr("p_size % 3 = 1"), " systems").otherwise("")
    titles = b.table(spark, sf, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit("-"), "p_type", extra).alias("title"))
    return rl.with_role(titles, "title", ROLE_RULES, "role_name", "role_family").drop("title")


_MARKUP = "(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<template\\b[^>]*>.*?</template\\s*>|</?[a-z!?][^>]*>"
_DECODED = "replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_STRIP = f"regexp_replace({_DECODED}, '^{b._SP}+|{b._SP}+$', '', 'g')"


@query("html_to_text", f"""
SELECT page_id, array_to_string([y FOR y IN [{_STRIP} FOR x IN string_split_regex(html, '{_MARKUP}')] IF y <> ''], ' ') AS text FROM pages""")
def html_to_text(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("url_host", """
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, host, regexp_matches(host, '(^|\\.)(example\\.com|ththr\\.example\\.net)$') AS trusted FROM h""")
def url_host(spark, sf):
    host = tx.url_host(F.col("url"))
    return b.table(spark, sf, "pages").select("page_id", host.alias("host"), tx.trusted_host(host, ["example.com", "ththr.example.net"]).alias("trusted"))


@query("stable_id", "SELECT doc_id, substring(sha256(lower(source || '|' || text)), 1, 16) AS id FROM documents")
def stable_id(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", sc.stable_id(F.col("source"), F.col("text")).alias("id"))


@query("salary_parse", """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
  CASE WHEN l_quantity >= 10 THEN CAST(l_suppkey AS BIGINT) * CASE WHEN l_returnflag = 'A' THEN 1000 ELSE 1 END ELSE -1 END AS low,
  CASE WHEN l_quantity >= 10 THEN CAST(l_partkey AS BIGINT) * 1000 ELSE -1 END AS high
FROM lineitem""")
def salary_parse(spark, sf):
    line = b.table(spark, sf, "lineitem")
    text = F.when(
        F.col("l_quantity") >= 10,
        F.concat(F.lit("pay $"), "l_suppkey", F.when(F.col("l_returnflag") == "A", "k").otherwise(""), F.lit(" -  $"), "l_partkey", F.lit("K or more")),
    ).otherwise("pay by arrangement")
    pay = sc.salary_range(text)
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.coalesce(pay["low"], F.lit(-1)).alias("low"), F.coalesce(pay["high"], F.lit(-1)).alias("high"))


@query("remote_type", f"""
WITH t AS (SELECT doc_id, lower(lang || ' ' || replace(replace(text, 'the', 'remote'), 'The', 'hybrid')) AS x FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(x, '(^|{b._NW})remote({b._NW}|$)') THEN 'Remote' WHEN regexp_matches(x, '(^|{b._NW})hybrid({b._NW}|$)') THEN 'Hybrid'
  ELSE 'On-site' END AS remote_type FROM t""")
def remote_type(spark, sf):
    text = F.replace(F.replace("text", F.lit("the"), F.lit("remote")), F.lit("The"), F.lit("hybrid"))
    return b.table(spark, sf, "documents").select("doc_id", rl.remote_type(F.col("lang"), text).alias("remote_type"))


@query("dedupe_first", """
SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_first(spark, sf):
    return dedupe.dedupe_by_key(b.table(spark, sf, "documents"), F.asc("doc_id"), key=F.sha2("text", 256)).select("doc_id", "source")


@query("latest_matching", """
SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'that') ORDER BY n_chars DESC, doc_id LIMIT 1""")
def latest_matching(spark, sf):
    docs = b.table(spark, sf, "documents")
    return dedupe.latest_matching(docs, F.contains(F.lower("text"), F.lit("that")), F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "source", "n_chars")


KEYWORDS = [("French", ("dans les", "avec")), ("German", ("nicht",)), ("Spanish", ("para ", "los ")), ("English", ("that", "with"))]


@query("match_first_keyword", "SELECT doc_id, CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{label}'" for label, words in KEYWORDS
) + " END AS label FROM documents")
def match_first_keyword(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", rl.first_keyword(F.col("text"), KEYWORDS).alias("label"))


@query("safe_int", """
SELECT event_id, CAST(trunc(value) AS BIGINT) AS whole, CAST(trunc(-value) AS BIGINT) AS negative, 0::BIGINT AS invalid FROM events""")
def safe_int(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id", sc.safe_int(F.col("value").cast("string")).alias("whole"), sc.safe_int(-F.col("value")).alias("negative"),
        F.coalesce(sc.safe_int(F.col("event_type")), F.lit(0)).alias("invalid"))


@query("epoch_date", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS kept FROM events""")
def epoch_date(spark, sf):
    return b.table(spark, sf, "events").select(
        "event_id", sc.epoch_to_date(F.unix_timestamp("ts")).alias("day"), sc.epoch_to_date(F.col("event_type")).alias("kept"))


@query("hiring_fields", """
WITH t AS (SELECT p_partkey, p_name || ' GmbH | ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' (Hybrid)' ELSE '' END || ' | ' || p_type || CASE WHEN p_size % 3 = 0 THEN ' remote' ELSE '' END AS x, * FROM part)
SELECT p_partkey, p_name || ' GmbH' AS company, CASE WHEN p_size % 2 = 0 THEN p_brand || ' (Hybrid)' WHEN p_size % 3 = 0 THEN p_type || ' remote' ELSE p_brand END AS location,
  CASE WHEN p_size % 3 = 0 THEN 'Remote' WHEN p_size % 2 = 0 THEN 'Hybrid' ELSE 'On-site' END AS remote_type FROM t""")
def hiring_fields(spark, sf):
    text = F.concat(
        "p_name", F.lit(" GmbH | "), "p_brand", F.when(F.expr("p_size % 2 = 0"), " (Hybrid)").otherwise(""), F.lit(" | "), "p_type",
        F.when(F.expr("p_size % 3 = 0"), " remote").otherwise(""))
    posts = b.table(spark, sf, "part").select("p_partkey", text.alias("text"), F.concat(F.lit("<p>"), text, F.lit("</p><p>more</p>")).alias("html"))
    place = rl.hiring_location(F.col("text"))
    return posts.select(
        "p_partkey", rl.hiring_company(F.col("html"), F.lit("someone")).alias("company"), place.alias("location"),
        rl.remote_type(place, F.col("text")).alias("remote_type"))
