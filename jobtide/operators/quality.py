"""Data-quality checks.

Every dataset is read once. Each record gives a few small rows, one for each test that it meets and one for each of
its keys (identity, URL, host); they are counted together, first within each task, in one shuffle for all datasets. The
counts end in one row, and that row becomes the sixteen check rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import number, parse_time, percent_text
from jobtide.functions.text import normalized_url, trusted_host, url_host
from jobtide.values import sources

JOB_FIELDS = ("external_id", "title", "company", "url")
COURSE_FIELDS = ("external_id", "title", "platform", "url")


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def count_long(test: Column) -> Column:
    return F.count_if(test)


def duplicates(df: DataFrame, keys: Sequence[str | Column], out: str) -> DataFrame:
    """Rows beyond the first of each key, in one row.  Null keys equal each other."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(out))


def duplicate_urls(df: DataFrame, prefix: str) -> DataFrame:
    urls = df.select(normalized_url(F.col("url")).alias("u")).where(F.col("u") != "")
    return urls.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias(f"{prefix}_urls"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"{prefix}_url_duplicates"),
    )


def untrusted_hosts(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Every host outside the allowed domains with its number of records."""
    host = url_host(F.col("url"))
    return (
        df.select(host.alias("host"))
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("records"))
        .where(~trusted_host(F.col("host"), allowed))
        .select(F.when(F.col("host") == "", F.lit("(missing)")).otherwise(F.col("host")).alias("host"), "records")
    )


def record_tests(df: DataFrame, required: Sequence[str]) -> dict[str, Column]:
    """What is counted about the records of a dataset, as conditions; columns it lacks are not tested."""
    has = set(df.columns)
    tests = {"rows": F.lit(True), "missing": _any([F.col(c).isNull() for c in required])}
    if "skill_count" in has:
        tests["no_skills"] = F.coalesce(number(F.col("skill_count")), F.lit(0.0)) == 0
    if "source_confidence" in has:
        tests["bad_labels"] = ~F.coalesce(F.col("source_confidence"), F.lit("")).isin(*sources.CONFIDENCE_LABELS)
    if {"salary_min", "salary_max"} <= has:
        low, high = number(F.col("salary_min")), number(F.col("salary_max"))
        tests["salaries"] = low.isNotNull() | high.isNotNull()
        tests["bad_salaries"] = _any([F.coalesce(t, F.lit(False)) for t in (low < 20000, high > 500000, low > high)])
    return tests


def freshness_tests(column: str, as_of: Column, days: int) -> dict[str, Column]:
    """Records with a date, with one too far back, and with one in the future."""
    at = parse_time(F.col(column))
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400)
    return {"dated": at.isNotNull(), "stale": F.coalesce(age > days, F.lit(False)), "future": F.coalesce(at > as_of, F.lit(False))}


def _counted(df: DataFrame, tests: dict[str, Column], prefix: str) -> DataFrame:
    return df.agg(*[count_long(test).alias(f"{prefix}_{name}") for name, test in tests.items()])


def dataset_counters(df: DataFrame, prefix: str, required: Sequence[str]) -> DataFrame:
    """Counters of a dataset that need nothing but its own rows."""
    return _counted(df, record_tests(df, required), prefix)


def freshness_counters(df: DataFrame, column: str, prefix: str, as_of: Column, days: int) -> DataFrame:
    return _counted(df, freshness_tests(column, as_of, days), prefix)


def _observations(df: DataFrame, side: str, tests: dict[str, Column], keys: dict[str, tuple[Column, Column, Column | None]]) -> DataFrame:
    """``side, kind, a, b``: a row for each test that a record meets and for each of its keys.

    keys gives, for each kind, whether the record has such a key and its one or two parts.
    """
    none = F.lit(None).cast("string")

    def row(kind: str, a: Column, b: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), (none if b is None else b.cast("string")).alias("b"))

    met = [F.when(test, row("test", F.lit(name))) for name, test in tests.items()]
    met += [F.when(present, row(kind, a, b)) for kind, (present, a, b) in keys.items()]
    rows = df.select(F.explode_outer(F.array(*met)).alias("o")).where(F.col("o").isNotNull())
    return rows.select(F.lit(side).alias("side"), "o.*")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _check(dataset: str, name: str, severity: str | Column, checked: Column, failed: Column, passes: Column,
           otherwise: str, message: Column, empty: Column | None = None, empty_text: str = "") -> Column:
    """One check row; an empty dataset gives a warning about nothing checked."""
    nothing = F.lit(False) if empty is None else empty
    grade = F.lit(severity) if isinstance(severity, str) else severity
    base = F.lit("medium") if not isinstance(severity, str) else F.lit(severity)
    zero = F.lit(0).cast("long")
    return F.struct(
        F.lit(dataset).alias("dataset"),
        F.lit(name).alias("check_name"),
        F.when(nothing, F.lit("warning")).when(passes, F.lit("pass")).otherwise(F.lit(otherwise)).alias("status"),
        F.when(nothing, base).otherwise(grade).alias("severity"),
        F.when(nothing, zero).otherwise(checked.cast("long")).alias("records_checked"),
        F.when(nothing, zero).otherwise(failed.cast("long")).alias("failed_count"),
        F.when(nothing, F.lit(empty_text)).otherwise(message).alias("message"),
    )


def _missing(dataset: str, name: str, severity: str, text: str, rows: Column | None = None) -> Column:
    """Check row of a dataset that lacks the column altogether."""
    n = F.lit(0).cast("long") if rows is None else rows
    return F.struct(
        F.lit(dataset).alias("dataset"), F.lit(name).alias("check_name"), F.lit("warning").alias("status"),
        F.lit(severity).alias("severity"), n.alias("records_checked"), n.alias("failed_count"), F.lit(text).alias("message"),
    )


def run_quality(
    jobs: DataFrame,
    courses: DataFrame,
    gaps: DataFrame | None,
    as_of: str | Column,
    job_domains: list[str] = sources.TRUSTED_JOB_DOMAINS,
    course_domains: list[str] = sources.TRUSTED_COURSE_DOMAINS,
) -> DataFrame:
    """The sixteen checks in their fixed order, judged at the given time."""
    now = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    sides = (("jobs", jobs, JOB_FIELDS, job_domains, "posted_at", 365), ("courses", courses, COURSE_FIELDS, course_domains, "last_modified", 730))
    frames, counters = [], {}
    for side, df, required, domains, dated, days in sides:
        tests = record_tests(df, required)
        if dated in df.columns:
            tests |= freshness_tests(dated, now, days)
        keys = {"id": (F.lit(True), F.col("source_name"), F.col("external_id"))}
        if "url" in df.columns:
            host, url = url_host(F.col("url")), normalized_url(F.col("url"))
            keys["host"] = (~trusted_host(host, domains), host, None)
            if side == "courses":
                keys["url"] = (url != "", url, None)
        frames.append(_observations(df, side, tests, keys))
        here, n = F.col("side") == side, F.col("n")
        counters |= {f"{side}_{name}": F.when(here & (F.col("kind") == "test") & (F.col("a") == name), n) for name in tests}
        counters[f"{side}_duplicates"] = F.when(here & (F.col("kind") == "id"), n - 1)
        if "host" in keys:
            counters[f"{side}_untrusted"] = F.when(here & (F.col("kind") == "host"), n)
            counters[f"{side}_untrusted_hosts"] = F.when(here & (F.col("kind") == "host"), 1)
        if "url" in keys:
            counters[f"{side}_urls"] = F.when(here & (F.col("kind") == "url"), n)
            counters[f"{side}_url_duplicates"] = F.when(here & (F.col("kind") == "url"), n - 1)
    if gaps is not None:
        support = F.coalesce(number(F.col("job_demand")), F.lit(0.0)) + F.coalesce(number(F.col("course_supply")), F.lit(0.0))
        frames.append(_observations(gaps, "gap", {"rows": F.lit(True), "supported": support >= 3}, {}))
        counters |= {f"gap_{name}": F.when((F.col("side") == "gap") & (F.col("a") == name), F.col("n")) for name in ("rows", "supported")}
    counts = reduce(DataFrame.unionByName, frames).groupBy("side", "kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(*[F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name) for name, value in counters.items()])
    # one row becomes sixteen, in their order
    return row.select(F.explode(F.array(*_checks(row.columns))).alias("check")).select("check.*")


def _checks(has: list[str]) -> list[Column]:
    c = F.col
    no_rows = {name: c(f"{name}_rows") == 0 for name in ("jobs", "courses")}
    out: list[Column] = []
    for name in ("jobs", "courses"):
        bad = c(f"{name}_missing")
        out.append(_check(name, "required_fields_present", "high", c(f"{name}_rows"), bad, bad == 0, "fail",
                          _text(bad, " records have missing required fields."), no_rows[name], "Dataset is empty."))
    for name in ("jobs", "courses"):
        bad = c(f"{name}_duplicates")
        out.append(_check(name, "duplicate_records", "medium", c(f"{name}_rows"), bad, bad == 0, "fail",
                          _text(bad, " duplicate records found."), no_rows[name], "Dataset is empty."))
    if "courses_urls" in has:
        bad = c("courses_url_duplicates")
        out.append(_check("courses", "duplicate_urls", "medium", c("courses_urls"), bad, bad == 0, "fail",
                          _text(bad, " records reuse a URL already present in the dataset."),
                          no_rows["courses"], "No URL fields available."))
    else:
        out.append(_missing("courses", "duplicate_urls", "medium", "No URL fields available."))
    if "jobs_salaries" in has:
        bad = c("jobs_bad_salaries")
        out.append(_check("jobs", "salary_range_valid", F.when(bad > 0, F.lit("high")).otherwise(F.lit("medium")),
                          c("jobs_salaries"), bad, bad == 0, "fail",
                          _text(bad, " salary anomalies found across ", c("jobs_salaries"), " records with salary data."),
                          no_rows["jobs"], "No salary fields available."))
    else:
        out.append(_missing("jobs", "salary_range_valid", "medium", "No salary fields available."))
    for name in ("jobs", "courses"):
        if f"{name}_no_skills" in has:
            bad, rows = c(f"{name}_no_skills"), c(f"{name}_rows")
            share = F.lit(1.0) - bad / F.nullif(rows, F.lit(0))
            out.append(_check(name, "skills_extracted", "medium", rows, bad, share >= 0.75, "warning",
                              _text(bad, " records have no extracted skills; coverage is ", percent_text(share), "."),
                              no_rows[name], "No skill fields available."))
        else:
            out.append(_missing(name, "skills_extracted", "medium", "No skill fields available."))
    for name in ("jobs", "courses"):
        if f"{name}_untrusted" in has:
            bad, hosts = c(f"{name}_untrusted"), c(f"{name}_untrusted_hosts")
            out.append(_check(name, "trusted_source_domains", "medium", c(f"{name}_rows"), bad, bad == 0, "warning",
                              _text(bad, " records on ", hosts, " hosts use URLs outside trusted domains."),
                              no_rows[name], "No URL fields available."))
        else:
            out.append(_missing(name, "trusted_source_domains", "medium", "No URL fields available."))
    labels = ", ".join(sources.CONFIDENCE_LABELS)
    for name in ("jobs", "courses"):
        if f"{name}_bad_labels" in has:
            bad = c(f"{name}_bad_labels")
            out.append(_check(name, "source_confidence_labels", "medium", c(f"{name}_rows"), bad, bad == 0, "warning",
                              _text(bad, f" records have source confidence labels outside: {labels}."),
                              no_rows[name], "Dataset is empty."))
        else:
            out.append(_missing(name, "source_confidence_labels", "medium", "No source confidence labels found.", c(f"{name}_rows")))
    for name, check, few, stale_text, future in (
        ("jobs", "posting_date_freshness", ("No posting dates available.", "No parseable posting dates."),
         " postings are older than 365 days and ", True),
        ("courses", "course_freshness", ("No course freshness field available.", "No parseable course dates."),
         " courses have not been modified in more than 730 days.", False),
    ):
        if f"{name}_dated" not in has:
            out.append(_missing(name, check, "low", few[0]))
            continue
        dated, stale, rows = c(f"{name}_dated"), c(f"{name}_stale"), c(f"{name}_rows")
        ahead = c(f"{name}_future") if future else F.lit(0)
        bad = stale + ahead
        message = _text(stale, stale_text, ahead, " are future-dated.") if future else _text(stale, stale_text)
        none = dated == 0
        out.append(_check(name, check, "low", F.when(none, rows).otherwise(dated), F.when(none, rows).otherwise(bad),
                          ~none & (bad == 0), "warning", F.when(none, F.lit(few[1])).otherwise(message),
                          no_rows[name], few[0]))
    jobs, courses = c("jobs_rows"), c("courses_rows")
    ready = (jobs >= 30) & (courses >= 30)
    out.append(_check("pipeline", "sample_size_ready", "high", jobs + courses, F.when(ready, 0).otherwise(1), ready, "warning",
                      _text("Trend views work best with at least 30 jobs and 30 courses; current sample is ", jobs,
                            " jobs and ", courses, " courses.")))
    if "gap_rows" in has:
        supported, rows = c("gap_supported"), c("gap_rows")
        out.append(_check("skill_gaps", "skill_gap_support", "high", rows, rows - supported, supported >= 3, "warning",
                          _text(supported, " skill-gap rows have at least 3 supporting records across demand and supply."),
                          rows == 0, "No skill gap summary available."))
    else:
        out.append(_missing("skill_gaps", "skill_gap_support", "high", "No skill gap summary available."))
    return out


# --- model tests --------------------------------------------------------------------------------

def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.agg(count_long(F.col(column).isNull()).alias("failures"))


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Number of keys that occur more than once; null keys do not count."""
    present = df.where(_all_present(columns))
    return present.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(count_long(F.col("n") > 1).alias("failures"))


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Number of distinct values outside the list."""
    outside = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))
    return outside.select(column).distinct().agg(F.count(F.lit(1)).alias("failures"))


def orphans(fact: DataFrame, key: str, dim: DataFrame, dim_key: str | None = None) -> DataFrame:
    """Fact keys without a dimension row, with their number of facts.

    The fact side is counted per key before the join, so a key that holds a large share of the
    facts takes part as one row.
    """
    per_key = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("facts"))
    keys = dim.select(F.col(dim_key or key).alias(key))
    return per_key.join(keys, key, "left_anti")


def relationships(fact: DataFrame, key: str, dim: DataFrame, dim_key: str | None = None) -> DataFrame:
    """Number of facts whose key has no dimension row."""
    return orphans(fact, key, dim, dim_key).agg(F.coalesce(F.sum("facts"), F.lit(0)).cast("long").alias("failures"))


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in columns])
