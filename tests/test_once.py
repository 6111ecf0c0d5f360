"""What is costly is computed once a record, and medians shuffle no record."""

from statistics import median

from pyspark.sql import functions as F

from jobtide import storage
from jobtide.functions import roles as rl
from jobtide.operators import gaps, trends
from jobtide.operators.medians import exact_median
from jobtide.plans import measures
from workload import builtin_queries, score_queries, star_queries, text_queries

JOBS = "run_id string, source_name string, location string, role_category string, role_family string, title string, salary_min double, salary_max double, skills array<string>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exact_medians_of_odd_keys(spark):
    values = {"a": [5.0, 1.0, 3.0, 3.001, float(10**9)], "b": [-2.0, -1.0, 0.0, 7.5], None: [4.0, 6.0], "c": []}
    rows = [(k, v, 1) for k, found in values.items() for v in [*found, None]]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    got = {r.k: (r.median, r.n) for r in exact_median(df, ["k"], "v", totals=["n"]).collect()}
    assert got == {k: (median(v) if v else None, len(v) + 1) for k, v in values.items()}


def test_salaries_that_are_numbers_do_not_become_text(spark):
    jobs = spark.createDataFrame([("r", "s", "l", "x", "y", "t", 1.0, float("nan"), ["a"]), ("r", "s", "l", "x", "y", "t", 1.0, 4.0, ["a"])], JOBS)
    assert "as string" not in plan(jobs.select(gaps.midpoint(jobs)))
    assert sorted((r[0] for r in jobs.select(gaps.midpoint(jobs)).collect()), key=str) == [2.5, None]
    text = jobs.withColumn("salary_min", F.lit("2.0")).withColumn("salary_max", F.lit("many"))
    assert [r[0] for r in text.select(gaps.midpoint(text)).collect()] == [None, None]


def test_titles_are_classified_only_where_a_role_is_missing(spark):
    jobs = spark.createDataFrame([("r", "s", "l", None, "", "Senior Data Engineer", 1.0, 2.0, ["a"]), ("r", "s", "l", "Own", "Family", "Data Engineer", 1.0, 2.0, ["a"])], JOBS)
    out = trends.skill_trend_history(jobs, jobs.select("skills"), "r")
    assert {(r.role_category, r.role_family) for r in out.collect()} == {("Data Engineer", "Data & Analytics"), ("Own", "Family")}
    # the rules stand in a function over an array, not in the code of the whole step
    assert "transform(array(title" in plan(out)
    assert [r[0] for r in jobs.select(rl.role_name(rl.role_number(F.col("title")))).collect()] == ["Data Engineer"] * 2


def test_terms_are_matched_once(spark):
    found = plan(text_queries.skill_terms(spark, "/root/testdata/sf0.001"))
    assert found.count("csharp") == 1 and found.count("\\bdans\\b") == 1


def test_the_gap_summary_goes_over_the_jobs_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    rows = [("r", "s", "l", "x", "y", "t", 1.0, 2.0 + n, skills) for n, skills in enumerate((["a", " "], ["a", "b", None], [], None))]
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), JOBS)
    courses = spark.createDataFrame([(["b", "c", ""],)], "skills array<string>")
    got = {r.skill: (r.job_demand, r.course_supply, r.median_salary, r.most_demand, r.most_supply, r.baseline) for r in gaps.skill_totals(jobs, courses).collect()}
    assert got == {"a": (2, 0, 1.75, 2, 1, 2.25), "b": (1, 1, 2.0, 2, 1, 2.25), "c": (0, 1, None, 2, 1, 2.25)}
    # once for the bands and once for their middle; the maxima share both passes
    assert seen.value == 2 * len(rows)


def test_facts_with_keys_alone_are_views(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(star_queries, "_models", {})
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    built = star_queries.model(spark, "/root/testdata/sf0.001")
    assert measures.high_confidence_demand_only(built, ["source_name"]).count() > 0
    assert measures.skill_supply_score(built).count() > 0 and measures.rising_skills_count(built).count() == 1
    folder = next(tmp_path.glob("star-*"))
    assert {p.name for p in folder.iterdir()} == {"jobs", "courses", "trends", "gaps", "star-dim_source", "star-dim_skill"}


def test_inputs_of_several_passes_are_written_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    score_queries.filter_gap_ui(spark, "/root/testdata/sf0.001").collect()
    assert [p.name[:8] for p in tmp_path.iterdir()] == ["gap-jobs"]
    loaded = builtin_queries.warehouse_load(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.run_id for r in loaded) == ["r1", "r2"] and len({(r.records, r.salaries) for r in loaded}) == 1
    assert len(list(tmp_path.glob("warehouse-jobs-*"))) == 1
