"""Query filters.  A filter that is not given keeps every row; limits follow a total order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import number
from jobtide.functions.text import text_list


def _member(column: Column, kind: str, value: str) -> Column:
    """The list holds the value, case ignored."""
    values = text_list(column) if kind == "string" else column
    return F.coalesce(F.exists(values, lambda v: F.lower(v) == value.lower()), F.lit(False))


def _part(column: Column, kind: str, value: str) -> Column:
    """The text contains the value, case ignored."""
    return F.contains(F.lower(column.cast("string")), F.lit(value.lower()))


def _same(column: Column, kind: str, value: str) -> Column:
    """The text is the value, case ignored."""
    return F.lower(column.cast("string")) == value.lower()


def _least(column: Column, kind: str, value: float) -> Column:
    """The number, zero where there is none, is at least the value."""
    return F.coalesce(number(column), F.lit(0.0)) >= value


Rule = tuple[str, Callable[[Column, str, object], Column]]
#: What each dataset can be filtered by: the name of the wish, the column it looks at, and the test.
#: Wishes given by place stand in this order.
JOBS: dict[str, Rule] = {"skill": ("skills", _member), "company": ("company", _part), "remote_type": ("remote_type", _same), "role_family": ("role_family", _same)}
COURSES: dict[str, Rule] = {"skill": ("skills", _member), "platform": ("platform", _part), "level": ("level", _part), "role_family": ("role_families", _member)}
GAPS: dict[str, Rule] = {
    "status": ("status", _part), "category": ("category", _part), "min_gap": ("gap_score", _least), "min_opportunity": ("opportunity_index", _least),
    "label": ("opportunity_label", _part), "role_family": ("role_families", _member),
}
TRENDS: dict[str, Rule] = {
    **{c: (c, _part) for c in ("skill", "source_name", "location", "role_category")}, "role_family": ("role_family", _same),
}


def matching(df: DataFrame, rules: Mapping[str, Rule], wishes: Mapping[str, object], given: Sequence[object] = ()) -> DataFrame:
    """The rows that meet every wish, as one predicate.

    Wishes that are null or empty text, and those about columns that the table lacks, keep every row.
    """
    if len(given) > len(rules):
        raise TypeError(f"{len(rules)} filters at most")
    wishes = dict(zip(rules, given, strict=False)) | dict(wishes)
    if unknown := wishes.keys() - rules.keys():
        raise TypeError(f"no filter by {sorted(unknown)}")
    kinds = dict(df.dtypes)
    asked = [(*rules[name], value) for name, value in wishes.items() if value is not None and value != ""]
    tests = [test(F.col(column), kinds[column], value) for column, test, value in asked if column in kinds]
    return df.where(reduce(and_, tests)) if tests else df


def has_value(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return matching(df, {column: (column, _member)}, {column: value})


def contains_text(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return matching(df, {column: (column, _part)}, {column: value})


def equals_text(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return matching(df, {column: (column, _same)}, {column: value})


def min_value(df: DataFrame, column: str, least: float | None) -> DataFrame:
    return matching(df, {column: (column, _least)}, {column: least})


def head(df: DataFrame, limit: int | None, *order: str | Column) -> DataFrame:
    ordered = df.orderBy(*order) if order else df
    return ordered if limit is None else ordered.limit(limit)


RECORD_ORDER = ("source_name", "external_id")
GAP_ORDER = ("opportunity_index", "gap_score", "job_demand")


def _page(rows: DataFrame, limit: int | None, order: Sequence[str]) -> DataFrame:
    """All rows unordered, or the first ones in the given order."""
    return rows if limit is None else head(rows, limit, *order)


def filter_jobs(jobs: DataFrame, *given, limit: int | None = 100, order: Sequence[str] = RECORD_ORDER, **wishes) -> DataFrame:
    """Jobs by the wishes in ``JOBS``."""
    return _page(matching(jobs, JOBS, wishes, given), limit, order)


def filter_courses(courses: DataFrame, *given, limit: int | None = 100, order: Sequence[str] = RECORD_ORDER, **wishes) -> DataFrame:
    """Courses by the wishes in ``COURSES``."""
    return _page(matching(courses, COURSES, wishes, given), limit, order)


def filter_skill_gaps(gaps: DataFrame, *given, limit: int | None = 100, **wishes) -> DataFrame:
    """Skill gaps by the wishes in ``GAPS``, best opportunity first."""
    return head(matching(gaps, GAPS, wishes, given), limit, *map(F.desc, GAP_ORDER), F.asc("skill"))


def filter_skill_trends(trends: DataFrame, *given, limit: int | None = 1000, **wishes) -> DataFrame:
    """Trend rows by the wishes in ``TRENDS``, oldest run first."""
    order = [c for c in ("run_timestamp", "skill", "source_name", "location", "role_category", "role_family") if c in trends.columns]
    return head(matching(trends, TRENDS, wishes, given), limit, *order)


def filter_quality(checks: DataFrame, status: str | None = None, severity: str | None = None) -> DataFrame:
    return contains_text(contains_text(checks, "status", status), "severity", severity)


def filter_certifications(
    certifications: DataFrame, skill: str | None = None, free_or_paid: str | None = None, limit: int | None = 100
) -> DataFrame:
    out = contains_text(certifications, "skill", skill)
    out = equals_text(out, "free_or_paid", free_or_paid)
    order = [F.desc("recommendation_score")] if "recommendation_score" in out.columns else []
    return head(out, limit, *order, F.asc("skill"), F.asc("certification_name"))


def filter_sources(df: DataFrame, names: Iterable[str] | None, column: str = "source_name") -> DataFrame:
    """Rows of the named sources; None keeps every source."""
    if names is None or column not in df.columns:
        return df
    return df.where(F.col(column).isin(*names))


def filter_trends(trends: DataFrame, names: Iterable[str] | None, skills: DataFrame | Iterable[str] | None) -> DataFrame:
    """Trends of the named sources and of the given skills, each optional.

    Skills may be a DataFrame; the restriction is then a semi join.
    """
    out = filter_sources(trends, names)
    if skills is None:
        return out
    if isinstance(skills, DataFrame):
        return out.join(skills.select("skill"), "skill", "left_semi")
    wanted = list(skills)
    return out.where(F.col("skill").isin(*wanted)) if wanted else out


def filter_gap_ui(
    gaps: DataFrame,
    trends: DataFrame | None = None,
    categories: Sequence[str] = (),
    labels: Sequence[str] = (),
    min_index: float = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """Gaps of the chosen categories and labels, and the trends of the skills that remain."""
    out = gaps.where(F.col("category").isin(*categories)) if categories else gaps
    out = out.where(F.col("opportunity_label").isin(*labels)) if labels else out
    out = min_value(out, "opportunity_index", min_index)
    return out, None if trends is None else filter_trends(trends, None, out)


def search_skills(gaps: DataFrame, query: str = "", category: str | None = None, min_index: float = 0) -> DataFrame:
    text = query.lower()
    hit = F.contains(F.lower("skill"), F.lit(text)) | F.contains(F.lower("target_job_roles"), F.lit(text))
    out = gaps.where(hit & (F.col("opportunity_index") >= min_index))
    return out.where(F.col("category") == category) if category else out


def search_certifications(certifications: DataFrame, query: str = "", payment: str = "All") -> DataFrame:
    text = F.lower(F.concat_ws(" ", "skill", "certification_name", "provider", "target_roles"))
    out = certifications.where(F.contains(text, F.lit(query.lower())))
    return out if payment == "All" else out.where(F.col("free_or_paid") == payment)


def courses_for_any(
    courses: DataFrame,
    skills: Sequence[str],
    n: int | None = 50,
    order: Sequence[str] = ("source_name", "external_id"),
) -> DataFrame:
    """Courses whose skill text contains any of the names, as a substring and case ignored."""
    if skills:
        names = "|".join(re.escape(s) for s in skills)
        text = F.col("skills") if dict(courses.dtypes)["skills"] == "string" else F.concat_ws("|", "skills")
        courses = courses.where(F.coalesce(text, F.lit("")).rlike(f"(?i){names}"))
    return courses if n is None else head(courses, n, *order)


def filter_source_runs(source_runs: DataFrame, run_id: str | None = None, limit: int | None = 200) -> DataFrame:
    out = source_runs.where(F.col("run_id").cast("string") == run_id) if run_id else source_runs
    return head(out, limit, F.desc("completed_at"), F.asc("source_name"))


def alerts(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("status").isin("warning", "fail"))


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return head(runs, limit, F.desc("run_timestamp"), F.desc("run_id"))
