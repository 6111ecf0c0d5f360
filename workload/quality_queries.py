"""Quality checks and model tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.operators import filters, gaps, kpis, quality
from workload import bindings as b
from workload.registry import query

AS_OF = "2026-07-01 00:00:00"
JOB_DOMAINS = ["src1.example.com", "src2.example.com", "example.net"]
COURSE_DOMAINS = ["example.org"]
LABELS = "'live_verified', 'live_broad', 'curated_demo', 'fallback_learning', 'test_source'"


def checks(spark, sf):
    jobs, courses = b.text_jobs(spark, sf), b.text_courses(spark, sf)
    return quality.run_quality(jobs, courses, gaps.skill_support(jobs, courses), AS_OF, JOB_DOMAINS, COURSE_DOMAINS)


CHECKS_SQL = f"""{b.TEXT_JOBS_SQL}, {b.TEXT_COURSES_SQL},
cl AS (SELECT external_id, count(DISTINCT skill) AS n FROM course_match GROUP BY 1),
j AS (SELECT s.*, coalesce(l.skill_count, 0) AS n, regexp_replace(lower(regexp_extract(url, '//([^/?#]*)', 1)), '^www\\.', '') AS host, CAST(posted_at AS TIMESTAMP) AS seen
  FROM job_src s LEFT JOIN job_lists l USING (external_id)),
c AS (SELECT s.*, coalesce(cl.n, 0) AS n, lower(rtrim(trim(url), '/')) AS u, CAST(last_modified AS TIMESTAMP) AS seen FROM course_src s LEFT JOIN cl USING (external_id)),
nj AS (SELECT count(*) AS r, count(*) FILTER (WHERE n = 0) AS none, count(*) - count(DISTINCT (source_name, external_id)) AS dup,
  count(*) FILTER (WHERE salary_min < 20000 OR salary_max > 500000 OR salary_min > salary_max) AS bad,
  count(*) FILTER (WHERE NOT regexp_matches(host, '(^|\\.)(src1\\.example\\.com|src2\\.example\\.com|example\\.net)$')) AS unt,
  count(DISTINCT host) FILTER (WHERE NOT regexp_matches(host, '(^|\\.)(src1\\.example\\.com|src2\\.example\\.com|example\\.net)$')) AS hosts,
  count(*) FILTER (WHERE date_diff('day', seen, TIMESTAMP '{AS_OF}') > 365) AS stale, count(*) FILTER (WHERE seen > TIMESTAMP '{AS_OF}') AS fut FROM j),
nc AS (SELECT count(*) AS r, count(*) FILTER (WHERE n = 0) AS none, count(*) - count(DISTINCT (source_name, external_id)) AS dup, count(*) - count(DISTINCT u) AS udup,
  count(*) FILTER (WHERE date_diff('day', seen, TIMESTAMP '{AS_OF}') > 730) AS stale FROM c),
g AS (SELECT skill, sum(n) AS n FROM (SELECT skill, count(*) AS n FROM job_match GROUP BY 1 UNION ALL SELECT skill, count(*) FROM course_match GROUP BY 1) GROUP BY 1),
ng AS (SELECT count(*) AS r, count(*) FILTER (WHERE n >= 3) AS ok FROM g),
checks AS (
  SELECT 'jobs' AS dataset, 'required_fields_present' AS check_name, 'pass' AS status, 'high' AS severity, r AS records_checked, 0::BIGINT AS failed_count, '0 records have missing required fields.' AS message FROM nj
  UNION ALL SELECT 'courses', 'required_fields_present', 'pass', 'high', r, 0, '0 records have missing required fields.' FROM nc
  UNION ALL SELECT 'jobs', 'duplicate_records', if(dup = 0, 'pass', 'fail'), 'medium', r, dup, dup || ' duplicate records found.' FROM nj
  UNION ALL SELECT 'courses', 'duplicate_records', if(dup = 0, 'pass', 'fail'), 'medium', r, dup, dup || ' duplicate records found.' FROM nc
  UNION ALL SELECT 'courses', 'duplicate_urls', if(udup = 0, 'pass', 'fail'), 'medium', r, udup, udup || ' records reuse a URL already present in the dataset.' FROM nc
  UNION ALL SELECT 'jobs', 'salary_range_valid', if(bad = 0, 'pass', 'fail'), if(bad = 0, 'medium', 'high'), r, bad, bad || ' salary anomalies found across ' || r || ' records with salary data.' FROM nj
  UNION ALL SELECT 'jobs', 'skills_extracted', if(1 - none / r >= 0.75, 'pass', 'warning'), 'medium', r, none, none || ' records have no extracted skills; coverage is ' || printf('%.1f%%', round_even((1.0 - none / r) * 100, 1)) || '.' FROM nj
  UNION ALL SELECT 'courses', 'skills_extracted', if(1 - none / r >= 0.75, 'pass', 'warning'), 'medium', r, none, none || ' records have no extracted skills; coverage is ' || printf('%.1f%%', round_even((1.0 - none / r) * 100, 1)) || '.' FROM nc
  UNION ALL SELECT 'jobs', 'trusted_source_domains', if(unt = 0, 'pass', 'warning'), 'medium', r, unt, unt || ' records on ' || hosts || ' hosts use URLs outside trusted domains.' FROM nj
  UNION ALL SELECT 'courses', 'trusted_source_domains', 'pass', 'medium', r, 0, '0 records on 0 hosts use URLs outside trusted domains.' FROM nc
  UNION ALL SELECT 'jobs', 'source_confidence_labels', 'pass', 'medium', r, 0, '0 records have source confidence labels outside: live_verified, live_broad, curated_demo, fallback_learning, test_source.' FROM nj
  UNION ALL SELECT 'courses', 'source_confidence_labels', 'pass', 'medium', r, 0, '0 records have source confidence labels outside: live_verified, live_broad, curated_demo, fallback_learning, test_source.' FROM nc
  UNION ALL SELECT 'jobs', 'posting_date_freshness', if(stale + fut = 0, 'pass', 'warning'), 'low', r, stale + fut, stale || ' postings are older than 365 days and ' || fut || ' are future-dated.' FROM nj
  UNION ALL SELECT 'courses', 'course_freshness', if(stale = 0, 'pass', 'warning'), 'low', r, stale, stale || ' courses have not been modified in more than 730 days.' FROM nc
  UNION ALL SELECT 'pipeline', 'sample_size_ready', if(nj.r >= 30 AND nc.r >= 30, 'pass', 'warning'), 'high', nj.r + nc.r, if(nj.r >= 30 AND nc.r >= 30, 0, 1),
    'Trend views work best with at least 30 jobs and 30 courses; current sample is ' || nj.r || ' jobs and ' || nc.r || ' courses.' FROM nj, nc
  UNION ALL SELECT 'skill_gaps', 'skill_gap_support', if(ok >= 3, 'pass', 'warning'), 'high', r, r - ok, ok || ' skill-gap rows have at least 3 supporting records across demand and supply.' FROM ng)"""


@query("dq_all", f"WITH {CHECKS_SQL} SELECT * FROM checks")
def dq_all(spark, sf):
    return checks(spark, sf)


@query("dq_alerts", f"WITH {CHECKS_SQL} SELECT dataset, check_name, status FROM checks WHERE status IN ('warning', 'fail')")
def dq_alerts(spark, sf):
    return filters.alerts(checks(spark, sf)).select("dataset", "check_name", "status")


@query("filter_quality", f"WITH {CHECKS_SQL} SELECT dataset, check_name, status, severity FROM checks WHERE status = 'pass' AND severity = 'medium'")
def filter_quality(spark, sf):
    return filters.filter_quality(checks(spark, sf), "PASS", "medium").select("dataset", "check_name", "status", "severity")


@query("quality_score", f"""
WITH {CHECKS_SQL} SELECT count(*) FILTER (WHERE status = 'pass') AS passed, count(*) AS checks, CAST(sum(failed_count) AS BIGINT) AS failed_records, count(DISTINCT dataset) AS datasets,
  CAST(floor(count(*) FILTER (WHERE status = 'pass') * 100 / count(*) + 0.5) AS BIGINT) AS score FROM checks""")
def quality_score(spark, sf):
    return kpis.quality_score(checks(spark, sf))


@query("dq_required", """
SELECT 'd' AS side, count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) AS missing, count(*) AS rows FROM documents LEFT JOIN labels USING (doc_id)""")
def dq_required(spark, sf):
    labelled = b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id", "left")
    return quality.dataset_counters(labelled, "d", ["quality", "toxic"]).select(F.lit("d").alias("side"), F.col("d_missing").alias("missing"), F.col("d_rows").alias("rows"))


@query("dq_duplicates", """
SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def dq_duplicates(spark, sf):
    return quality.duplicates(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "duplicates")


@query("dq_urls", """
WITH u AS (SELECT regexp_replace(lower(trim(regexp_replace(url, '[?#].*$', ''))), '/+$', '') AS u FROM pages)
SELECT count(*) AS p_urls, count(*) - count(DISTINCT u) AS p_url_duplicates FROM u WHERE u <> ''""")
def dq_urls(spark, sf):
    pages = b.table(spark, sf, "pages").withColumn("url", F.concat(F.upper(F.regexp_replace("url", "[?#].*$", "")), F.lit("// ")))
    return quality.duplicate_urls(pages, "p")


@query("dq_salary", """
SELECT count(*) AS salaries, count(*) FILTER (WHERE o_totalprice / 2 < 20000 OR o_totalprice > 500000) AS bad_salaries FROM orders""")
def dq_salary(spark, sf):
    priced = b.table(spark, sf, "orders").select(
        (F.col("o_totalprice") / 2).alias("salary_min"), F.col("o_totalprice").alias("salary_max"), F.col("o_orderkey").alias("external_id"))
    return quality.dataset_counters(priced, "x", ["external_id"]).select(F.col("x_salaries").alias("salaries"), F.col("x_bad_salaries").alias("bad_salaries"))


@query("dq_domains", """
WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT host, count(*) AS records FROM h WHERE NOT regexp_matches(host, '(^|\\.)(example\\.com)$') GROUP BY host""")
def dq_domains(spark, sf):
    return quality.untrusted_hosts(b.table(spark, sf, "pages"), ["example.com"])


@query("dq_freshness", """
SELECT count(*) AS o_dated, count(*) FILTER (WHERE floor(epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 86400) > 730) AS o_stale, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2000-01-01') AS o_future FROM orders""")
def dq_freshness(spark, sf):
    return quality.freshness_counters(b.table(spark, sf, "orders"), "o_orderdate", "o", F.lit("2000-01-01").cast("timestamp"), 730)


@query("dbt_not_null", "SELECT count(*) FILTER (WHERE quality IS NULL) AS failures FROM documents LEFT JOIN labels USING (doc_id)")
def dbt_not_null(spark, sf):
    return quality.not_null(b.table(spark, sf, "documents").join(b.table(spark, sf, "labels"), "doc_id", "left"), "quality")


@query("dbt_unique", "SELECT count(*) AS failures FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dbt_unique(spark, sf):
    return quality.unique(b.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("dbt_accepted", "SELECT count(DISTINCT o_orderpriority) AS failures FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def dbt_accepted(spark, sf):
    return quality.accepted_values(b.table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("dbt_relationships", """
SELECT 'documents to labels' AS test, count(*) AS failures FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'line items to orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders to customers', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def dbt_relationships(spark, sf):
    def test(name, fact, key, dim, dim_key):
        return quality.relationships(b.table(spark, sf, fact), key, b.table(spark, sf, dim), dim_key).select(F.lit(name).alias("test"), "failures")

    return (
        test("documents to labels", "documents", "doc_id", "labels", "doc_id")
        .union(test("line items to orders", "lineitem", "l_orderkey", "orders", "o_orderkey"))
        .union(test("orders to customers", "orders", "o_custkey", "customer", "c_custkey")))
