"""Conversions, keys and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_FORMAT = "yyyyMMdd_HHmmss"


def number(col: Column) -> Column:
    """Numeric value or null; text that is no number and NaN both give null."""
    value = col.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def numeric(df: DataFrame, name: str) -> Column:
    """:func:`number` of a column of a table; one that holds whole numbers or doubles is not turned into text and back."""
    if dict(df.dtypes)[name] not in ("double", "bigint", "int", "smallint", "tinyint"):
        return number(F.col(name))
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def safe_int(col: Column) -> Column:
    """Integer part of a number, truncated toward zero; null when it is none."""
    return number(col).try_cast("bigint")


def stable_id(*cols: Column) -> Column:
    text = F.lower(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return F.substring(F.sha2(text, 256), 1, 16)


def surrogate_key(*cols: Column) -> Column:
    """md5 of the values joined by ``|``; nulls are skipped."""
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def epoch_to_date(col: Column) -> Column:
    """Epoch seconds as an ISO date in UTC; anything else unchanged."""
    text = col.cast("string")
    seconds = text.try_cast("bigint")
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), text)


def parse_time(col: Column) -> Column:
    """Timestamp of an ISO date or date-time text in UTC, or null."""
    return col.cast("string").try_cast("timestamp")


def run_time(run_id: Column) -> Column:
    """Timestamp encoded in a run id, or null."""
    return F.try_to_timestamp(run_id, F.lit(RUN_FORMAT))


def run_timestamp(run_id: Column) -> Column:
    """ISO text of the time encoded in a run id; a run id of another form is returned unchanged."""
    return F.coalesce(F.date_format(run_time(run_id), "yyyy-MM-dd'T'HH:mm:ssxxx"), run_id)


def iso_offset(col: Column) -> Column:
    """ISO text with a numeric UTC offset."""
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ssxxx")


def salary_range(text: Column) -> Column:
    """First ``$low - $high`` of a text as ``struct<low, high>``; a K multiplies its own side."""
    pattern = r"(?i)\$(\d+)(K)?\s*-\s*\$(\d+)(K)?"

    def side(digits: int, unit: int) -> Column:
        amount = F.nullif(F.regexp_extract(text, pattern, digits), F.lit("")).try_cast("bigint")
        return amount * F.when(F.regexp_extract(text, pattern, unit) != "", F.lit(1000)).otherwise(F.lit(1))

    return F.struct(side(1, 2).alias("low"), side(3, 4).alias("high"))


def monday(col: Column) -> Column:
    """Start of the Monday week of a timestamp."""
    return F.to_date(F.date_trunc("week", col))


def percent_text(share: Column) -> Column:
    """Share as a percentage with one decimal, such as ``75.0%``."""
    return F.format_string("%.1f%%", F.bround(share * 100, 1))


def grouped_number(col: Column) -> Column:
    """Number with thousands separators."""
    return F.format_number(col, 0)
