"""Exact medians that do not gather a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A band spans about 0.4 percent of a value, so all doubles fall into at most half a million bands
# and usual salaries into some hundred. They are counted on the map side, so there should be few of them.
_BANDS_PER_E = 256
_OFFSET = 2_000_000


def _band(value: Column) -> Column:
    """Number of the band a value falls in; never decreases as the value grows."""
    size = F.floor(F.ln(F.abs(value)) * _BANDS_PER_E) + _OFFSET
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * size)


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", totals: Sequence[str] = ()
) -> DataFrame:
    """Exact median of ``value`` per key, with the sums of the ``totals`` columns.

    ``df`` is a table of occurrences: a row counts once where its value is known.  A key without any
    known value has a null median.

    A key that holds a third of all rows must not end up sorted by one task. The rows of each band are counted first, which
    the map side does, so that no row of the input is shuffled. The ranks of the two middle values are then located among the
    bands of the key, which are few. A second pass over ``df`` keeps the values of those one or two bands a key, which are
    sent to all tasks, and only they are shuffled, counted and put in order. A ``df`` that is costly to compute twice should
    be written first.
    """
    keys, totals = list(keys), list(totals)
    banded = df.select(*keys, F.col(value).alias("_value"), _band(F.col(value)).alias("_band"), *totals)
    per_band = banded.groupBy(*keys, "_band").agg(F.count("_value").alias("_n"), *[F.sum(t).alias(t) for t in totals])

    whole = W.partitionBy(*keys)
    upto = F.sum("_n").over(whole.orderBy("_band"))
    ranked = per_band.select(
        *keys, "_band", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), F.sum("_n").over(whole).alias("_all"),
        *[F.sum(t).over(whole).alias(t) for t in totals],
        F.row_number().over(whole.orderBy("_band")).alias("_first"),
    )
    low, high = F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1")
    # a key without known values keeps one row, so that its totals are not lost
    kept = F.when(F.col("_all") == 0, F.col("_first") == 1).otherwise((F.col("_before") < high) & (F.col("_upto") >= low))
    middle = ranked.where(kept).select(*keys, "_band", "_all", "_before", low.alias("_low"), high.alias("_high"), *totals)

    rest = ["_before", "_low", "_high", *totals]
    same = F.col("b._band") == F.col("m._band")
    for k in keys:
        same = same & F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}"))
    near = banded.where(F.col("_value").isNotNull()).select(*keys, "_band", "_value").alias("b").join(
        middle.where(F.col("_all") > 0).hint("broadcast").alias("m"), same)
    # both uses of the middle bands take all of its columns, so that they share its shuffles
    counts = near.groupBy(*[F.col(f"m.{k}").alias(k) for k in keys], F.col("m._band").alias("_band"), "_value").agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in rest])
    bare = middle.where(F.col("_all") == 0).select(
        *keys, "_band", F.lit(None).cast(df.schema[value].dataType).alias("_value"), F.lit(0).cast("long").alias("_n"), *rest)
    inside = counts.unionByName(bare)
    reached = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_band").orderBy("_value"))
    chosen = (reached - F.col("_n") < F.col("_high")) & (reached >= F.col("_low"))
    marked = inside.withColumn("_chosen", F.when(chosen, F.col("_value")))
    return marked.groupBy(*keys).agg(F.avg("_chosen").alias(out), *[F.max(t).alias(t) for t in totals])
