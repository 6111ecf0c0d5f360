"""Score formulas as column expressions.  Rounding is half-even, as in the original scores."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_even(value: Column) -> Column:
    return F.bround(value.cast("double"), 0).cast("int")


def normalize_count(value: Column, maximum: Column) -> Column:
    """Share of the maximum as 0-100; 0 when there is no positive maximum."""
    share = half_even(value.cast("double") / F.nullif(maximum.cast("double"), F.lit(0.0)) * F.lit(100.0))
    return F.when(maximum > 0, share).otherwise(F.lit(0))


def opportunity_index(
    demand: Column, growth: Column, salary: Column, supply: Column, saturation: Column
) -> Column:
    score = (
        F.lit(50.0)
        + F.lit(0.35) * demand
        + F.lit(0.25) * growth
        + F.lit(0.25) * salary
        - F.lit(0.20) * supply
        - F.lit(0.15) * saturation
    )
    return clamp(half_even(score))


#: The least index of a label, and the least gap of a status, the highest first; then what all others have.
OPPORTUNITY_LABELS = ((75, "High-value"), (60, "Good bet"), (45, "Balanced"))
LOWEST_LABEL = "Lower priority"
GAP_STATUSES = ((2, "High opportunity"), (1, "Emerging opportunity"), (0, "Balanced"))
LOWEST_STATUS = "Course-heavy"


def _steps(value: Column, steps: tuple[tuple[int, str], ...], lowest: str) -> Column:
    chain = F
    for least, label in steps:
        chain = chain.when(value >= least, F.lit(label))
    return chain.otherwise(F.lit(lowest))


def opportunity_label(index: Column) -> Column:
    return _steps(index, OPPORTUNITY_LABELS, LOWEST_LABEL)


def gap_status(gap: Column) -> Column:
    """Status of a gap, which is a whole number."""
    return _steps(gap, GAP_STATUSES, LOWEST_STATUS)


def demand_supply_ratio(demand: Column, supply: Column) -> Column:
    return F.when(supply != 0, F.bround(demand.cast("double") / supply.cast("double"), 2))


def growth_score(average_growth: Column) -> Column:
    """0-35 percent projected growth on a 40-90 scale."""
    return clamp(half_even(F.lit(40.0) + average_growth / F.lit(35.0) * F.lit(50.0)), 40, 90)


def wage_score(wage: Column, low: Column, high: Column) -> Column:
    """Wage on a 40-85 scale between the lowest and highest profile wage; 50 without a spread."""
    scaled = half_even(F.lit(40.0) + (wage - low) / F.nullif((high - low).cast("double"), F.lit(0.0)) * F.lit(45.0))
    return F.when(high <= low, F.lit(50)).otherwise(scaled)


def premium_score(median: Column, baseline: Column) -> Column:
    """Salary premium over the baseline; null without a positive baseline or a median."""
    ratio = (median - baseline) / F.nullif(baseline, F.lit(0.0))
    return F.when(baseline > 0, clamp(half_even(F.lit(50.0) + ratio * F.lit(100.0))))


def recommendation_score(priority: Column, index: Column) -> Column:
    def number(c: Column) -> Column:
        return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))

    return half_even(number(priority) * F.lit(0.55) + number(index) * F.lit(0.45))


def _steps_sql(name: str, kind: str, steps: tuple[tuple[int, str], ...], lowest: str) -> str:
    whens = " ".join(f"WHEN {name} >= {least} THEN '{label}'" for least, label in steps)
    return f"({name} {kind}) RETURNS STRING RETURN CASE {whens} ELSE '{lowest}' END"


# SQL functions for analysts, from the same values.  Spark inlines their bodies, so they cost what the expressions cost.
SQL_FUNCTIONS = {
    "opportunity_label": _steps_sql("idx", "DOUBLE", OPPORTUNITY_LABELS, LOWEST_LABEL),
    "gap_status": _steps_sql("gap", "BIGINT", GAP_STATUSES, LOWEST_STATUS),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Register the functions for SQL users; see :mod:`jobtide.functions.sql_functions`."""
    from jobtide.functions.sql_functions import register

    return register(spark)
