"""Skills and roles of the built-in taxonomy, plans, catalogs, batches, runs and scopes on small rows."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobtide import schemas, storage
from jobtide.functions import json_walk, sql_functions
from jobtide.functions import text as tx
from jobtide.operators import enrich, gaps, quality
from jobtide.plans import measures, star
from jobtide.plans.pipeline import run_pipeline
from jobtide.plans.scope import scope
from jobtide.sources import payloads, tables
from jobtide.streaming import jobs as streams
from jobtide.taxonomy import Skill, Taxonomy, builtin
from jobtide.functions import roles as rl

SF = "/root/testdata/sf0.001"
POSTINGS = [
    "Build Python and SQL pipelines with Airflow, dbt, PostgreSQL, and AWS.",
    "C++ and C# services; CI/CD with GitHub Actions, R programming, t-sql & T SQL",
    "Node.js, Next.js, React.js and .NET / ASP.NET on Azure Data Factory (ADF); TCP/IP",
    "Extract, transform, load jobs; scikit-learn, pyspark & Apache Spark; Power BI dashboards|DAX",
    "nothing of the kind", "", None,
]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def plain_matches(text):
    """Each pattern on each text, one after another."""
    text = re.sub(r"c\+\+", " cpp ", (text or "").replace("|", " "), flags=re.I)
    text = re.sub("c#", " csharp ", text, flags=re.I).replace("&", " and ")
    text = re.sub(r"\s+", " ", re.sub("[/_+-]", " ", text)).strip().lower()
    out = []
    for skill in builtin().skills:
        terms = sorted({m.group().strip() for p in skill.patterns for m in re.finditer(p, text)})
        if terms:
            out.append((skill.name, skill.category, terms, round(min(1.0, 0.65 + 0.1 * len(terms)), 2)))
    return sorted(out, key=lambda m: m[0].lower())


def test_builtin_skills_are_those_of_each_pattern_alone(spark):
    rows = spark.createDataFrame(list(enumerate(POSTINGS)), "i int, text string")
    found = enrich.extract_skills(rows, tx.skill_text(F.col("text")), builtin()).collect()
    matcher = sql_functions.SkillMatcher(builtin())
    for row in found:
        want = plain_matches(row.text)
        assert [(m.skill, m.category, m.terms, m.confidence) for m in row.matches] == want
        assert list(matcher.matches(row.text)) == want
    assert sum(len(r.matches) for r in found) >= 25


def test_texts_are_matched_once(spark):
    matched = plan(entry.queries()["skill_counts"](spark, SF))
    assert all(matched.count(f"(?U){p},") == 1 for p in (r"\bthat\b", r"\bdans\b", r"\bpara\b"))


def test_quality_reads_each_table_once(spark):
    df = entry.queries()["dq_all"](spark, SF)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert plan(df).count("Relation [") <= 4 and len(re.findall(r"\bExchange\b", physical)) <= 5


def test_gap_summary_compares_with_one_row(spark):
    assert plan(entry.queries()["skill_gap_summary"](spark, SF)).count("scalar-subquery") <= 3


@pytest.mark.parametrize("title, role", [
    ("Senior Data Engineer", "Data Engineer"), ("ML Engineer", "Machine Learning Engineer"), ("Frontend  Developer (React)", "Frontend Engineer"), ("Site_Reliability-Engineer", "Site Reliability Engineer"),
    ("Analytics Consultant", "Data Consultant"), ("Sales Engineer", "Software Engineer"), ("IT Generalist", "Other IT Role"), ("Gardener", "Other Technology Role"), (None, "Other Technology Role"),
])
def test_roles_of_real_titles(spark, title, role):
    row = spark.createDataFrame([(title,)], "title string")
    assert rl.with_role(row, "title").first().role_category == role


# --- credentials and catalogs -------------------------------------------------------------------

def nested(value, levels):
    for _ in range(levels):
        value = [None, {"x": [7, value]}]
    return value


def test_texts_are_found_at_any_depth(spark):
    assert json_walk.first_text(nested({"zz": "last", "en": " found "}, 400)) == "found"
    assert json_walk.first_text({"name": {"name": [""]}, "de": ["", "Deutsch"]}) == "Deutsch"
    assert json_walk.first_text([5, True, None, "  "]) == ""
    resources = [
        {"@id": "u1", "ceterms:name": nested({"en": "SQL expert"}, depth), "ceterms:ownedBy": [["text"], {"ceterms:name": nested("Owner", depth)}], "ceterms:description": 5}
        for depth in (0, 3, 49, 200)
    ]
    frame = spark.createDataFrame([(json.dumps(r),) for r in resources] + [("{broken",), ("[1]",), (None,), ("{}",)], "resource string")
    got = payloads.normalize_credentials(frame, "2026-07-01").select("skill", "certification_name", "provider", "url").collect()
    assert [tuple(r) for r in got] == [("SQL", "SQL expert", "Owner", "u1")] * 4


def certification(n):
    return {"skill": "SQL", "certification_name": f'name {n} "quoted" {{ [ \\ }}', "priority_score": n, "level": "ünï"}


def test_certifications_of_a_long_array(spark, tmp_path):
    entries = [certification(n) for n in range(100_000)]
    entries[500:500] = [7, None, "}{", [certification(-1)], [[]], True]
    text = json.dumps(entries, indent=1, ensure_ascii=False).replace('"priority_score": 77,', '"priority_score": bad,')
    (tmp_path / "all.json").write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = tables.read_certifications_json(spark, str(tmp_path / "all.json"))
        assert got.schema.fieldNames() == schemas.CERTIFICATION.fieldNames()
        rows = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("priority_score").alias("d"), F.min("priority_score").alias("low"), F.max("certification_name").alias("name")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # the entry that does not parse goes, or keeps what it had before the fault
    assert rows.d == 99_999 and rows.n in (99_999, 100_000) and rows.low == 0 and rows.name == certification(99_999)["certification_name"]


def test_certifications_of_lines_and_of_other_files(spark, tmp_path):
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(certification(n)) for n in range(30)))
    assert tables.read_certifications_json(spark, str(lines)).select("priority_score").distinct().count() == 30
    for name, text, n in (("empty", "", 0), ("none", " [ ]\n", 0), ("one", "﻿[" + json.dumps(certification(3)) + "]", 1), ("cut", '[{"skill": "a"}, {"skill": "b"', 2)):
        (tmp_path / name).write_text(text, encoding="utf-8")
        assert tables.read_certifications_json(spark, str(tmp_path / name)).count() == n
    (tmp_path / "text").write_text('"a text" {"skill": "x"}')
    with pytest.raises(Exception, match="must be a JSON array"):
        tables.read_certifications_json(spark, str(tmp_path / "text")).count()


def test_reference_tables_and_modes(spark):
    for name in tables.CATALOGS:
        assert tables.reference_table(spark, name).count() > 0
    with pytest.raises(ValueError, match="unknown catalog"):
        tables.reference_table(spark, "x")
    for kind in ("jobs", "courses"):
        from jobtide.values import sources

        for aliases, names in {"jobs": sources.JOB_MODES, "courses": sources.COURSE_MODES}[kind].items():
            assert all(tables.sources_of(f" {a.upper()} ", kind) == names for a in aliases)
        with pytest.raises(ValueError, match="unsupported"):
            tables.sources_of("no such mode", kind)


# --- batches and streams ------------------------------------------------------------------------

KEYS = ["source_name", "external_id"]
ROWS = "source_name string, external_id string, title string"


def batch(spark, *values):
    return spark.createDataFrame(list(values), ROWS).coalesce(1)


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "jobs")
    first = batch(spark, ("a", "1", "first"), ("a", "1", "second"), ("a", None, "no key"), ("c", "3", "x"))
    for _ in range(3):
        tables.append_batch(spark, first, path, KEYS, 0)
    later = batch(spark, ("a", "1", "later"), ("b", "2", "new"), (None, "9", "no key"))
    for _ in range(2):
        tables.append_batch(spark, later, path, KEYS, 1)
    schema = first.schema
    assert {tuple(r) for r in tables.read_batches(spark, path, schema).collect()} == {("a", "1", "first"), ("c", "3", "x"), ("b", "2", "new")}
    assert spark.read.parquet(f"{path}_rejects").count() == 2
    # cut off after its rows: the keys are read from these
    storage.delete(spark, f"{path}_keys/batch=1")
    tables.append_batch(spark, later, path, KEYS, 2)
    assert tables.read_batches(spark, path, schema).count() == 3
    tables.compact_keys(spark, path, KEYS, schema)
    tables.append_batch(spark, first.union(later), path, KEYS, 3)
    assert tables.read_batches(spark, path, schema).count() == 3
    assert sorted(n.split("-")[0] for n in storage.children(spark, f"{path}_keys")) == ["batch=3", "batch=merged", "done=0", "done=2"]


def test_a_batch_opens_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "jobs")
    every = spark.range(20_000).select(F.lit("a").alias("source_name"), F.col("id").cast("string").alias("external_id"), F.repeat(F.lit("text "), 50).alias("title"))
    tables.append_batch(spark, every, path, KEYS, 0)
    few = [r[0] for r in every.where("external_id IN ('5', '17', '99')").select(tables._bucket(KEYS)).distinct().collect()]
    held = tables.stored_keys(spark, path, KEYS, every.schema, 1, few)
    assert 0 < len(few) < tables.KEY_BUCKETS
    files = {f.rsplit("/", 2)[1] for f in held.inputFiles()}
    assert held.columns == KEYS and held.count() < 20_000 and "title" not in plan(held)
    assert "PartitionFilters: [bucket" in held._jdf.queryExecution().executedPlan().toString() and files
    tables.append_batch(spark, every.limit(0), path, KEYS, 1)
    assert tables.read_batches(spark, path, every.schema).count() == 20_000


def test_of_a_batch_without_new_keys_the_rejects_alone_are_computed(spark, tmp_path):
    path, seen = str(tmp_path / "jobs"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    first = batch(spark, ("a", "1", "x"), ("a", "1", "y"), ("b", "2", "z"), ("a", None, "no key")).withColumn("title", counted("title"))
    tables.append_batch(spark, first, path, KEYS, "one")
    assert seen.value == 4
    tables.append_batch(spark, first, path, KEYS, "two")
    assert seen.value == 5
    tables.append_batch(spark, first.union(batch(spark, ("c", "3", "new"), ("c", "3", "second"))), path, KEYS, "three")
    rows = tables.read_batches(spark, path, batch(spark, ("a", "1", "x")).schema)
    assert {tuple(r) for r in rows.collect()} == {("a", "1", "x"), ("b", "2", "z"), ("c", "3", "new")} and rows.count() == 3
    assert spark.read.parquet(f"{path}_rejects").count() == 3


def test_a_stream_that_starts_over_adds_nothing(spark, tmp_path):
    root = str(tmp_path)
    payload = {f.name: None for f in schemas.JOB_PAYLOAD.fields}

    def land(name, *ids):
        rows = [json.dumps({"source_name": "s", "source_type": "t", "source_url": "u", "collected_at": "2026-07-01T00:00:00Z", "payload": {**payload, "external_id": i, "title": "Data Engineer"}}) for i in ids]
        (tmp_path / "raw").mkdir(exist_ok=True)
        (tmp_path / "raw" / f"{name}.json").write_text("\n".join(rows))

    def ingest(checkpoint):
        streams.incremental_ingest(spark, f"{root}/raw", schemas.JOB_PAYLOAD, enrich.normalize_jobs, f"{root}/clean", f"{root}/{checkpoint}").awaitTermination()

    land("one", "1", "2", None)
    ingest("a")
    land("two", "2", "3")
    ingest("a")
    ingest("a")
    ingest("b")
    rows = tables.read_batches(spark, f"{root}/clean", schemas.JOBS)
    assert sorted(r.external_id for r in rows.collect()) == ["1", "2", "3"]


def test_late_and_unordered_runs(spark, tmp_path):
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    monday = datetime.datetime(2026, 6, 1)

    def at(days, hours=0):
        return monday + datetime.timedelta(days=days, hours=hours)

    files = [
        [(at(1), "a"), (at(3), "c"), (at(8), "p")], [(at(2), "b"), (at(3), "d")], [(at(40), "z")], [(at(39), "w")], [(at(4), "too late"), (at(38), "y")], [(at(41), "zz")],
    ]
    try:
        (tmp_path / "in").mkdir()
        for n, rows in enumerate(files):
            spark.createDataFrame(rows, "at timestamp, run string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        stream = spark.readStream.schema("at timestamp, run string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        newest = streams.latest_run_state(stream, "run", "at", "7 days")
        streams.write_updates(newest, str(tmp_path / "out"), str(tmp_path / "check"), ["window_start"]).awaitTermination()
        got = streams.read_updates(spark, str(tmp_path / "out")).select(F.date_format("window_start", "MM-dd"), "run_id").collect()
    finally:
        spark.conf.unset(setting)
    assert sorted(map(tuple, got)) == [("06-01", "d"), ("06-08", "p"), ("07-06", "zz")]


# --- runs, scopes, stars ------------------------------------------------------------------------

def raw(spark, kind, *texts):
    payload = {"jobs": schemas.JOB_PAYLOAD, "courses": schemas.COURSE_PAYLOAD}[kind]
    items = spark.createDataFrame([(str(n), "Data Engineer", t, "u") for n, t in enumerate(texts)], "external_id string, title string, description string, url string")
    return tables.raw_records(items, "curated_data_jobs", "job_posting", "2026-07-01 00:00:00", payload)


CATALOG = "skill string, certification_name string, provider string, level string, free_or_paid string, estimated_cost_usd double, target_roles string, url string, priority_score int, ordinal int"


def test_a_run_is_seen_when_it_is_whole(spark, tmp_path):
    root = str(tmp_path)
    catalog = spark.createDataFrame([("SQL", "c", "p", "l", "Free", 0.0, "r", "u", 5, 1)], CATALOG)
    both = raw(spark, "jobs", "SQL and Python", "sql"), raw(spark, "courses", "Python")

    def seen():
        return {r.name: (r.latest_run_id, r.records) for r in tables.dataset_status(spark, f"{root}/processed").collect()}

    with pytest.raises(Exception, match="stop here"):
        run_pipeline(spark, *both, root, "r1", "2026-07-01", catalog.withColumn("level", F.raise_error(F.lit("stop here")).cast("string")))
    assert set(seen().values()) == {(None, 0)} and tables.health(spark, f"{root}/processed")["status"] == "missing_data"
    for run in ("r1", "r2", "r1"):
        run_pipeline(spark, *both, root, run, "2026-07-01", catalog)
    assert seen()["jobs"] == ("r2", 2) and seen()["quality"] == ("r2", 16) and seen()["certifications"] == ("r2", 1)
    assert tables.read_history(spark, f"{root}/processed", *schemas.DATASETS["jobs"]).count() == 4
    # a run that lacks a dataset is refused
    tables.withdraw_run(spark, f"{root}/processed", "r2")
    storage.delete(spark, f"{root}/processed/quality_summary/run_id=r2")
    with pytest.raises(ValueError, match="lacks quality"):
        tables.publish_run(spark, f"{root}/processed", "r2")
    assert seen()["jobs"] == ("r1", 2)


def test_certifications_are_scored_on_the_scope(spark):
    tax = Taxonomy(skills=(Skill("A", "x", (r"\ba\b",), ("Database",)), Skill("B", "x", (r"\bb\b",))))
    jobs = spark.createDataFrame([("live", "1", ["A"], "Database"), ("demo", "2", ["B", "A"], "Database"), ("demo", "3", ["B"], "Database")], "source_name string, external_id string, skills array<string>, role_family string")
    courses = spark.createDataFrame([("school", ["B"], ["Database"])], "source_name string, skills array<string>, role_families array<string>")
    certs = spark.createDataFrame([("A", "one", 50), ("B", "two", 50)], "skill string, certification_name string, priority_score int")
    from jobtide.operators.certifications import certification_recommendations

    outputs = {"jobs": jobs, "courses": courses, "certifications": certification_recommendations(certs, gaps.skill_gap_summary(jobs, courses, tax), tax)}
    views = {"live": (("live",), ("school",))}
    before = {r.skill: r.job_demand for r in outputs["certifications"].collect()}
    after = {r.skill: r.job_demand for r in scope(outputs, "live", taxonomy=tax, views=views)["certifications"].collect()}
    assert before == {"A": 2, "B": 2} and after == {"A": 1, "B": 0}


def test_the_better_label_of_a_source_holds(spark):
    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "source_name string, source_confidence string")

    trends = spark.createDataFrame([("t",)], "source_name string")
    got = star.dim_source(rows(("a", "test_source"), ("a", "live_verified"), ("b", "odd"), ("c", None)), rows(("a", "curated_demo"), ("b", "fallback_learning")), trends)
    assert {r.source_name: r.source_confidence for r in got.collect()} == {"a": "live_verified", "b": "fallback_learning", "c": "test_source", "t": "test_source"}


def test_relations_of_the_built_star(spark):
    from workload.star_queries import model

    built = model(spark, SF)
    for dim, key in (("dim_skill", "skill_key"), ("dim_role", "role_key"), ("dim_location", "location_key"), ("dim_source", "source_key"), ("dim_time", "time_key")):
        assert quality.unique(built[dim], key).first().failures == 0 and quality.not_null(built[dim], key).first().failures == 0
        for fact in ("fact_job_skill_mentions", "fact_course_skill_coverage", "fact_skill_trend_history"):
            if key in built[fact].columns and not (dim == "dim_time" and fact == "fact_course_skill_coverage"):
                assert quality.relationships(built[fact], key, built[dim]).first().failures == 0, (fact, key)


def test_sql_functions(spark):
    names = sql_functions.register(spark)
    assert set(names) >= {"classify_role", "extract_skills", "role_families", "gap_status"}
    got = spark.sql("SELECT classify_role('Data-Engineer II') AS r, gap_status(1) AS g, opportunity_label(60) AS o, s.skill FROM (SELECT 'SQL on AWS' AS t), LATERAL extract_skills(t) s").collect()
    assert [tuple(x) for x in got] == [("Data Engineer", "Emerging opportunity", "Good bet", s) for s in ("AWS", "SQL")]
    families = spark.sql("SELECT role_families(f) AS f FROM VALUES ('b | a'), (NULL), ('c|a'), ('') AS t(f)").first().f
    assert families == "a | b | c"


def test_a_measure_writes_the_tables_that_it_reads(spark, monkeypatch, tmp_path):
    from jobtide import storage
    from workload import star_queries

    monkeypatch.setattr(star_queries, "_models", {})
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    built = star_queries.model(spark, SF)

    def written():
        return {p.name for p in next(tmp_path.glob("star-*")).iterdir()} if list(tmp_path.glob("star-*")) else set()

    assert len(built) == 15 and written() == set()
    total = measures.total_jobs(built).collect()
    assert written() == {"jobs", "star-fact_jobs"}
    # read once more, nothing is written again
    assert measures.total_jobs(star_queries.model(spark, SF)).collect() == total and written() == {"jobs", "star-fact_jobs"}
