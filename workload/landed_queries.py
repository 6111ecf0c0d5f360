"""Connector normalisation over payloads shaped from the generated tables, storage and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide import schemas, storage
from jobtide.functions import roles as rl
from jobtide.operators import certifications as ce
from jobtide.operators import enrich, practice
from jobtide.sources import payloads, tables
from jobtide.streaming import jobs as streams
from workload import bindings as b
from workload.registry import query


def _struct(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


@query("normalize_adzuna", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT source AS external_id, split_part(text, '.', 1) AS title_raw, 'Co ' || lang AS company, CASE WHEN n_chars % 2 = 0 THEN 'Unknown' ELSE lang END AS location,
  n_chars AS salary_min, 'https://a.example.com/' || doc_id AS url FROM r WHERE k = 1""")
def normalize_adzuna(spark, sf):
    d = b.table(spark, sf, "documents")
    landed = d.select(
        F.col("source").alias("id"), F.substring_index("text", ".", 1).alias("title"), _struct(display_name=F.concat(F.lit("Co "), "lang")).alias("company"),
        _struct(display_name=F.when(F.expr("n_chars % 2 = 1"), F.col("lang"))).alias("location"), (F.col("n_chars") + F.lit(0.75)).alias("salary_min"),
        F.lit(None).cast("double").alias("salary_max"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"), F.lit("2024-01-01").alias("created"),
        F.concat(F.lit("https://a.example.com/"), "doc_id").alias("redirect_url"), F.col("doc_id").alias("ordinal"))
    return payloads.normalize_adzuna(landed).select("external_id", F.col("title").alias("title_raw"), "company", "location", "salary_min", "url")


@query("normalize_arbeitnow", f"""
WITH t AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'Data Engineer ' || p_name ELSE p_name END AS title, CASE WHEN p_size % 7 = 0 THEN 'knows kafka & co' ELSE p_brand END AS x FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS external_id, title, p_brand AS company, p_type AS location, CASE WHEN p_size > 40 THEN 'Remote' ELSE 'On-site' END AS remote_type, x AS description,
  strftime(TIMESTAMP '1970-01-01' + to_seconds(p_partkey * 100000), '%Y-%m-%d') AS posted_at
FROM t WHERE p_size % 5 = 0 OR p_size % 7 = 0""")
def normalize_arbeitnow(spark, sf):
    p = b.table(spark, sf, "part")
    landed = p.select(
        F.col("p_partkey").cast("string").alias("slug"), F.when(F.expr("p_size % 5 = 0"), F.concat(F.lit("Data Engineer "), "p_name")).otherwise(F.col("p_name")).alias("title"),
        F.col("p_brand").alias("company_name"), F.col("p_type").alias("location"), (F.col("p_size") > 40).alias("remote"),
        F.concat(F.lit("<div>"), F.when(F.expr("p_size % 7 = 0"), "knows <b>kafka</b> &amp; co").otherwise(F.col("p_brand")), F.lit("</div>")).alias("description"),
        (F.col("p_partkey") * 100000).alias("created_at"), F.concat(F.lit("https://n.example.com/"), "p_partkey").alias("url"), F.col("p_partkey").alias("ordinal"))
    return payloads.normalize_arbeitnow(landed).select("external_id", "title", "company", "location", "remote_type", "description", "posted_at")


@query("normalize_remotive", """
SELECT CASE WHEN p_size % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE substring(sha256(lower(p_name || '|' || 'https://r.example.com/' || p_partkey)), 1, 16) END AS external_id,
  p_name AS title, 'Unknown' AS company, 'Remote' AS location, 'Remote' AS remote_type FROM part""")
def normalize_remotive(spark, sf):
    p = b.table(spark, sf, "part")
    landed = p.select(
        F.when(F.expr("p_size % 2 = 0"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.lit("").alias("company_name"),
        F.lit(None).cast("string").alias("candidate_required_location"), F.col("p_type").alias("description"), F.lit("2024-01-01").alias("publication_date"),
        F.concat(F.lit("https://r.example.com/"), "p_partkey").alias("url"), F.col("p_partkey").alias("ordinal"))
    return payloads.normalize_remotive(landed).select("external_id", "title", "company", "location", "remote_type")


@query("normalize_hiring_thread", """
WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1)
SELECT l_partkey || '-' || l_suppkey AS external_id, 'Data Engineer' AS title, 'Supplier ' || l_suppkey AS company, 'Remote' AS remote_type,
  CAST(l_quantity AS BIGINT) * 1000 AS salary_min, CAST(l_quantity AS BIGINT) * 2000 AS salary_max
FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM s)""")
def normalize_hiring_thread(spark, sf):
    stories = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("objectID"), F.when(F.col("o_orderpriority") == "1-URGENT", "Ask: Who is hiring?").otherwise("Who wants to be hired").alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    q = F.col("l_quantity").cast("long")
    text = F.concat(F.lit("<p>Supplier "), "l_suppkey", F.lit(" | Remote | data engineer | $"), q, F.lit("K - $"), q * 2, F.lit("k</p>"))
    comments = b.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("objectID"), F.col("l_orderkey").cast("string").alias("parent_id"), F.lit("someone").alias("author"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("created_at"), text.alias("comment_text"))
    return payloads.normalize_hiring_thread(stories, comments).select("external_id", "title", "company", "remote_type", "salary_min", "salary_max")


@query("normalize_video_search", """
SELECT 'youtube-v' || event_id AS external_id, event_type AS title, event_type || '. ' || props AS description, 'a|b' AS subjects, 'https://www.youtube.com/watch?v=v' || event_id AS url
FROM events WHERE event_type <> 'error'""")
def normalize_video_search(spark, sf):
    landed = b.table(spark, sf, "events").select(
        F.lit("a b").alias("query"), _struct(videoId=F.when(F.col("event_type") != "error", F.concat(F.lit("v"), "event_id"))).alias("id"),
        _struct(title=F.col("event_type"), description=F.col("props"), publishedAt=F.col("ts").cast("string")).alias("snippet"))
    out = payloads.normalize_video_search(landed, tables.reference_table(spark, "youtube_learning"))
    return out.select("external_id", "title", "description", "subjects", "url")


@query("normalize_modules", """
WITH m AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'devops' ELSE 'crafts' END AS subject, CASE WHEN p_size % 9 = 0 THEN 'power-bi' ELSE lower(p_type) END AS product,
  p_name || CASE WHEN p_size % 11 = 0 THEN ' with Kubernetes' ELSE '' END AS title FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS external_id, title, 'beginner, ' || lower(p_brand) AS level, subject || '|x' AS subjects, product AS products, p_size AS duration_minutes
FROM m WHERE p_size % 4 = 0 OR p_size % 9 = 0 OR p_size % 11 = 0""")
def normalize_modules(spark, sf):
    landed = b.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("uid"), F.concat("p_name", F.when(F.expr("p_size % 11 = 0"), " with Kubernetes").otherwise("")).alias("title"), F.col("p_brand").alias("summary"),
        F.lit("u").alias("url"), F.lit("2024-01-01").alias("last_modified"), F.array(F.lit("beginner"), F.lower("p_brand")).alias("levels"),
        F.array(F.when(F.expr("p_size % 4 = 0"), "devops").otherwise("crafts"), F.lit("x")).alias("subjects"), F.array(F.lit("data-engineer")).alias("roles"),
        F.array(F.when(F.expr("p_size % 9 = 0"), F.lit("power-bi")).otherwise(F.lower("p_type"))).alias("products"), F.col("p_size").alias("duration_in_minutes"), F.col("p_partkey").alias("ordinal"))
    return payloads.normalize_modules(landed).select("external_id", "title", "level", "subjects", "products", "duration_minutes")


def _tracks(spark, sf):
    """Tracks named after the parts' types, with a skill each."""
    return b.table(spark, sf, "part").select("p_type", "p_brand").groupBy("p_type").agg(F.min("p_brand").alias("skill")).select(
        F.concat(F.lower("p_type"), F.lit(".yml")).alias("filename"), F.lower("p_type").alias("slug"), F.concat("p_type", F.lit(" Certification")).alias("title"), "skill",
        F.lit("a|b").alias("subjects"), F.lit("maker").alias("roles"), F.lit("p").alias("products"))


@query("normalize_curriculum", """
WITH t AS (SELECT p_type, min(p_brand) AS skill FROM part GROUP BY 1), f AS (SELECT DISTINCT p_type FROM part WHERE p_size > 10 AND p_type <> 'LARGE')
SELECT 'freecodecamp-' || lower(p_type) AS external_id, p_type || ' Certification' AS title, 'Project-based freeCodeCamp curriculum for ' || skill || '.' AS description,
  'https://www.freecodecamp.org/learn/' || lower(p_type) || '/' AS url FROM t JOIN f USING (p_type)""")
def normalize_curriculum(spark, sf):
    index = b.table(spark, sf, "part").select(
        F.concat(F.lower("p_type"), F.lit(".yml")).alias("name"), F.when((F.col("p_size") > 10) & (F.col("p_type") != "LARGE"), "file").otherwise("dir").alias("type"),
        F.lit("h").alias("html_url"), F.lit("p").alias("path"))
    return payloads.normalize_curriculum(index, _tracks(spark, sf)).select("external_id", "title", "description", "url")


@query("build_cert_catalog", """
WITH t AS (SELECT p_type, min(p_brand) AS skill FROM part GROUP BY 1)
SELECT p_brand AS skill, p_name AS certification_name, p_type AS provider, 'curated' AS source_name, p_size + 50 AS priority_score FROM part
UNION ALL SELECT skill, 'freeCodeCamp ' || p_type || ' Certification', 'freeCodeCamp', 'freecodecamp_curriculum', 76 FROM t""")
def build_cert_catalog(spark, sf):
    cloud = b.certifications(spark, sf).drop("ordinal").withColumn("source_name", F.lit("curated"))
    none = tables.reference_table(spark, "curriculum_tracks")
    return ce.build_cert_catalog("all", cloud, none, live_tracks=_tracks(spark, sf)).select("skill", "certification_name", "provider", "source_name", "priority_score")


@query("normalize_learning_repos", """
WITH r AS (SELECT p_partkey, p_type AS topic, p_size, 'org/' || CASE WHEN p_size % 3 = 0 THEN 'awesome' ELSE 'notes' END || '-' || p_partkey AS full_name FROM part),
t AS (SELECT p_type, min(p_brand) AS skill FROM part GROUP BY 1)
SELECT 'github-learning-' || p_partkey AS external_id, skill || ' learning path: ' || full_name AS title, topic AS products FROM r JOIN t ON topic = p_type
WHERE p_size % 3 = 0 AND p_size <> 48 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY p_size DESC, full_name) = 1""")
def normalize_learning_repos(spark, sf):
    name = F.concat(F.when(F.expr("p_size % 3 = 0"), "awesome").otherwise("notes"), F.lit("-"), "p_partkey")
    repos = b.table(spark, sf, "part").select(
        F.col("p_type").alias("topic"), F.col("p_partkey").alias("id"), F.concat(F.lit("org/"), name).alias("full_name"), name.alias("name"),
        F.concat(F.lit("https://github.com/org/"), name).alias("html_url"), (F.col("p_size") == 48).alias("archived"), F.lit("2024-01-01").alias("pushed_at"), F.col("p_size").alias("stargazers_count"))
    topics = _tracks(spark, sf).select("skill", F.upper("slug").alias("topic"), "subjects", "roles")
    return payloads.normalize_learning_repos(repos, topics).select("external_id", "title", "products")


@query("normalize_credentials", """
SELECT CASE WHEN contains(p_name, 'ring') THEN 'Rings' ELSE 'Bolts' END AS skill, p_name || ' expert' AS certification_name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'Credential Engine publisher' END AS provider,
  CASE WHEN p_size % 3 = 0 THEN 'https://c.example.org/' || p_partkey ELSE 'urn:' || p_partkey END AS url
FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'bolt')""")
def normalize_credentials(spark, sf):
    # names lie 1, 4 or 50 levels deep, in lists within maps
    name = F.to_json(F.struct(F.lit("").alias("de"), F.concat("p_name", F.lit(" expert ")).alias("en")))
    levels = F.when(F.expr("p_partkey % 3 = 0"), 0).when(F.expr("p_partkey % 3 = 1"), 3).otherwise(49)
    name = F.concat(F.repeat(F.lit('[null, 7, {"x": '), levels), name, F.repeat(F.lit("}]"), levels))
    owner = F.when(F.expr("p_size % 2 = 0"), F.to_json(F.array(F.struct(F.struct(F.array("p_type").alias("@value")).alias("ceterms:name")))))
    owner = F.concat(F.repeat(F.lit('["a bare text names none", '), levels), owner, F.repeat(F.lit("]"), levels))
    page = F.when(F.expr("p_size % 3 = 0"), F.concat(F.lit('["", "https://c.example.org/'), "p_partkey", F.lit('"]'))).otherwise(F.lit("[]"))
    resource = F.concat(
        F.lit('{"@id":"urn:'), "p_partkey", F.lit('","ceterms:name":'), name, F.lit(',"ceterms:ownedBy":'), F.coalesce(owner, F.lit("null")), F.lit(',"ceterms:subjectWebpage":'), page, F.lit("}"))
    response = b.table(spark, sf, "part").select(F.concat(F.lit('{"Results":[7,{"Resource":'), resource, F.lit("}]}")).alias("value"))
    rules = [("Rings", ("ring",)), ("Bolts", ("bolt",))]
    return payloads.normalize_credentials(payloads.unwrap_results(response), "2026-07-01", rules).select("skill", "certification_name", "provider", "url")


@query("practice_rank", """
WITH repo AS (SELECT p_type AS skill, 'org/r' || p_partkey AS repository, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, 'org/r' || p_partkey) AS rr FROM part WHERE p_size <> 7 QUALIFY rr <= 5),
iss AS (SELECT 'org/r' || l_partkey AS repository, 'https://g.example.com/' || l_partkey || '/' || (l_orderkey // 4) AS u, strftime(l_shipdate, '%Y-%m-%d') AS upd, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS lab, l_returnflag = 'R' AS pr,
  l_suppkey, l_orderkey FROM lineitem),
pg AS (SELECT *, row_number() OVER (PARTITION BY repository, lab ORDER BY upd DESC, u) AS k FROM iss QUALIFY k <= 8),
j AS (SELECT skill, rr, lab, k, u, repository FROM repo JOIN pg USING (repository) WHERE NOT pr QUALIFY row_number() OVER (PARTITION BY skill, u ORDER BY lab, rr, k) = 1)
SELECT skill, CAST(row_number() OVER (PARTITION BY skill ORDER BY lab, rr, k) AS INTEGER) AS rank, repository, u AS issue_url, ['good first issue', 'help wanted'][lab + 1] AS practice_label FROM j QUALIFY rank <= 8""")
def practice_rank(spark, sf):
    repos = b.table(spark, sf, "part").select(
        F.col("p_type").alias("skill"), F.concat(F.lit("org/r"), "p_partkey").alias("full_name"), F.lit("h").alias("html_url"), (F.col("p_size") == 7).alias("archived"), F.lit("d").alias("description"),
        F.array(F.lit("t")).alias("topics"), F.lit("Python").alias("language"), F.col("p_size").alias("stargazers_count"), F.lit("2024").alias("updated_at"))
    label = F.when(F.expr("l_linenumber % 2 = 0"), "good first issue").otherwise("help wanted")
    issues = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("org/r"), "l_partkey").alias("repository"), F.col("l_linenumber").alias("number"), F.col("l_linestatus").alias("title"),
        F.concat(F.lit("https://g.example.com/"), "l_partkey", F.lit("/"), F.expr("l_orderkey div 4")).alias("html_url"), F.array(_struct(name=label)).alias("labels"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("updated_at"), F.when(F.col("l_returnflag") == "R", _struct(url=F.lit("x"))).alias("pull_request"))
    return practice.rank_practice_issues(repos, issues).select("skill", "rank", "repository", "issue_url", "practice_label")


@query("practice_topics", """
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS topic FROM part""")
def practice_topics(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", practice.topic_for_skill(F.concat_ws(" ", "p_name", "p_brand")).alias("topic"))


@query("onet_evidence", f"""
WITH {b.EVIDENCE_SQL}, w AS (SELECT DISTINCT CASE WHEN p_size < 20 THEN 'Lathe' WHEN p_size < 40 THEN 'Banner' ELSE 'Vise' END AS e, '11-' || (p_size % 4) AS soc, p_type AS t, p_size > 30 AS hot FROM part)
SELECT x.skill, w.e AS workplace_example, w.soc AS soc_code, w.t AS occupation, w.hot AS hot_technology FROM w JOIN ex x ON x.example = w.e JOIN prof p ON p.skill = x.skill AND p.soc = w.soc""")
def onet_evidence(spark, sf):
    tax = b.part_taxonomy()
    rows = b.table(spark, sf, "part").select(
        F.when(F.col("p_size") < 20, "Lathe").when(F.col("p_size") < 40, "Banner").otherwise("Vise").alias("workplace_example"), F.concat(F.lit("11-"), F.expr("p_size % 4")).alias("onetsoc_code"),
        F.col("p_type").alias("title"), F.when(F.col("p_size") > 30, "Y").otherwise("N").alias("hot_technology"), F.lit("N").alias("in_demand")).distinct()
    return enrich.build_evidence(rows, tax.profile_frame(spark), tax.example_frame(spark)).drop("in_demand")


@query("technology_posts", """
SELECT p_partkey FROM part WHERE p_size % 2 = 0""")
def technology_posts(spark, sf):
    text = F.concat("p_name", F.when(F.expr("p_size % 2 = 0"), " Site Reliability Engineer").otherwise(" reliability"))
    return b.table(spark, sf, "part").where(rl.mentions_technology(text)).select("p_partkey")


# --- sources and storage ------------------------------------------------------------------------

@query("union_sources", """
SELECT 'curated_data_jobs' AS source_name, count(*) AS n FROM documents WHERE lang = 'en' UNION ALL SELECT 'curated_technology_jobs', count(*) FROM documents WHERE lang <> 'en'""")
def union_sources(spark, sf):
    d = b.table(spark, sf, "documents")
    english = d.where(F.col("lang") == "en").select(F.lit("curated_data_jobs").alias("source_name"), "doc_id")
    other = d.where(F.col("lang") != "en").select(F.lit("curated_technology_jobs").alias("source_name"), "lang", "doc_id")
    both = tables.union_sources("portfolio", "jobs", {"curated_technology_jobs": other, "curated_data_jobs": english, "seed_job_postings": english})
    return both.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


@query("source_status", """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e(source) AS (VALUES ('src0'), ('src1'), ('nowhere'), ('broken'))
SELECT source AS source_name, CASE WHEN source = 'broken' THEN 'failed' WHEN n > 0 THEN 'success' ELSE 'empty' END AS status, coalesce(n, 0) AS record_count FROM e LEFT JOIN c USING (source)""")
def source_status(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("source").alias("source_name"))
    expected = [(s, "job_posting") for s in ("src0", "src1", "nowhere", "broken")]
    failures = spark.createDataFrame([("broken", "ValueError", "x" * 600)], "source_name string, error_type string, error_message string")
    return tables.source_status(d, expected, "2026-07-01 00:00:00", "2026-07-01 00:00:05", failures).select("source_name", "status", "record_count")


@query("roundtrip_raw", """
SELECT source AS source_name, count(*) AS records, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(n_chars + 20000) AS BIGINT) AS salaries FROM documents GROUP BY 1""")
def roundtrip_raw(spark, sf):
    path = tables.write_raw(b.raw_jobs(spark, sf), storage.scratch(spark, "raw"), "job_postings_raw", "20260701_000000")
    back = tables.read_raw(spark, path, schemas.JOB_PAYLOAD)
    return back.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("payload.description")).alias("chars"), F.sum("payload.salary_min").alias("salaries"))


@query("snapshots", """
SELECT 'latest' AS which, count(*) AS records FROM documents WHERE lang = 'en' UNION ALL SELECT 'history', count(*) + (SELECT count(*) FROM documents WHERE lang = 'en') FROM documents""")
def snapshots(spark, sf):
    root = storage.scratch(spark, "snapshots")
    d = b.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("external_id"), "source", "lang").withColumnRenamed("source", "source_name")
    tables.write_snapshot(d, root, "job_postings_clean", "20260701_000000")
    tables.write_snapshot(d.where(F.col("lang") == "en"), root, "job_postings_clean", "20260702_000000")
    schema = d.schema
    latest = tables.read_latest(spark, root, "job_postings_clean", schema).agg(F.count(F.lit(1)).alias("records"))
    history = tables.read_history(spark, root, "job_postings_clean", schema).agg(F.count(F.lit(1)).alias("records"))
    return latest.select(F.lit("latest").alias("which"), "records").union(history.select(F.lit("history"), "records"))


@query("append_idempotent", """
SELECT count(*) AS records, count(DISTINCT l_orderkey) AS orders FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def append_idempotent(spark, sf):
    path = storage.scratch(spark, "appended")
    rows = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    keys = ["l_orderkey", "l_linenumber"]
    tables.append_idempotent(spark, rows.where(F.col("l_quantity") < 30), path, keys)
    tables.append_idempotent(spark, rows, path, keys)
    tables.append_idempotent(spark, rows, path, keys)
    return spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("l_orderkey").alias("orders"))


@query("export_typed", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def export_typed(spark, sf):
    suppliers = b.table(spark, sf, "supplier")
    written = tables.export_star(spark, {"supplier": suppliers}, storage.scratch(spark, "export"))
    return tables.read_typed_csv(spark, written["supplier"], suppliers.schema)


# --- streams ------------------------------------------------------------------------------------

def _events(spark, sf):
    return spark.readStream.schema(b.TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(stream):
    stream.awaitTermination()
    return stream


@query("stream_ingest", """
SELECT source AS source_name, count(*) AS records, CAST(sum(n_chars + 20000) AS BIGINT) AS salaries FROM documents GROUP BY 1""")
def stream_ingest(spark, sf):
    root = storage.scratch(spark, "ingest")
    path = tables.write_raw(b.raw_jobs(spark, sf), root, "landed", "20260701_000000")
    from jobtide.operators.enrich import normalize_jobs

    def clean(raw):
        return normalize_jobs(raw, b.text_taxonomy(), labels=b.TEXT_SOURCES)

    # the second run starts from an empty checkpoint, so it sees every file again and must add nothing
    for attempt in ("a", "b"):
        _finished(streams.incremental_ingest(spark, path, schemas.JOB_PAYLOAD, clean, f"{root}/clean", f"{root}/checkpoint-{attempt}"))
    return spark.read.schema(schemas.JOBS).parquet(f"{root}/clean").groupBy("source_name").agg(F.count(F.lit(1)).alias("records"), F.sum("salary_min").alias("salaries"))


@query("stream_dedup", "SELECT event_type, CAST(floor(value) AS BIGINT) AS whole, user_id FROM events GROUP BY 1, 2, 3")
def stream_dedup(spark, sf):
    root = storage.scratch(spark, "dedup")
    keyed = _events(spark, sf).select("ts", "event_type", F.floor("value").alias("whole"), "user_id")
    distinct = streams.distinct_stream(keyed, ["event_type", "whole", "user_id"], "ts", "60 days")
    _finished(streams.append_rows(distinct, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").select("event_type", "whole", "user_id")


@query("stream_weekly", """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type AS skill, count(*) AS job_count FROM events GROUP BY 1, 2""")
def stream_weekly(spark, sf):
    root = storage.scratch(spark, "weekly")
    counts = streams.windowed_skill_counts(_events(spark, sf), "ts", "event_type", "1 week", "7 days")
    _finished(streams.write_updates(counts, f"{root}/out", f"{root}/checkpoint", ["window_start", "skill"]))
    return streams.read_updates(spark, f"{root}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "skill", "job_count")


@query("stream_daily", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS skill, count(*) AS job_count FROM events GROUP BY 1, 2")
def stream_daily(spark, sf):
    root = storage.scratch(spark, "daily")
    counts = streams.windowed_skill_counts(_events(spark, sf), "ts", "event_type", "1 day", "1 day")
    _finished(streams.write_updates(counts, f"{root}/out", f"{root}/checkpoint", ["window_start", "skill"]))
    return streams.read_updates(spark, f"{root}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "skill", "job_count")


LATEST_RUN_SQL = """
WITH r AS (SELECT date_trunc('week', ts) AS w, strftime(ts, '%Y%m%d') || '_' || event_id AS run_id, ts FROM events)
SELECT strftime(w, '%Y-%m-%d') AS week, run_id FROM r QUALIFY row_number() OVER (PARTITION BY w ORDER BY ts DESC, run_id DESC) = 1"""


@query("stream_latest_run", LATEST_RUN_SQL)
def stream_latest_run(spark, sf):
    root = storage.scratch(spark, "latest")
    runs = _events(spark, sf).select("ts", F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_"), "event_id").alias("run_id"))
    _finished(streams.write_updates(streams.latest_run_per_week(runs, "run_id", "ts"), f"{root}/out", f"{root}/checkpoint", ["window_start"]))
    return streams.read_updates(spark, f"{root}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "run_id")


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query("stream_latest_run_state", LATEST_RUN_SQL)
def stream_latest_run_state(spark, sf):
    # files in no order of time, a batch each: later batches bring older runs of weeks that are known
    root = storage.scratch(spark, "latest-state")
    b.table(spark, sf, "events").select("ts", "event_id").repartition(4, "event_id").write.parquet(f"{root}/landed")
    landed = streams.read_stream(spark, f"{root}/landed", "ts timestamp_ntz, event_id long", "parquet", files_per_batch=1)
    runs = landed.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_"), "event_id").alias("run_id"))
    setting, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(setting, _ROCKS)
    try:
        newest = streams.latest_run_state(runs, "run_id", "ts", "60 days")
        _finished(streams.write_updates(newest, f"{root}/out", f"{root}/checkpoint", ["window_start"]))
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    return streams.read_updates(spark, f"{root}/out").select(F.date_format("window_start", "yyyy-MM-dd").alias("week"), "run_id")
