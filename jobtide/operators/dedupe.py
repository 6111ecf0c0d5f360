"""First-wins and last-wins duplicates over landed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import stable_id
from jobtide.functions.text import blank_to_null
from jobtide.operators.trends import latest_per_group


def payload_key(df: DataFrame, names: Sequence[str] = ("id", "slug", "url", "redirect_url")) -> Column:
    """Identity of a landed row: the first identifier it carries, else a hash of its content."""
    present = [blank_to_null(F.col(n).cast("string")) for n in names if n in df.columns]
    content = stable_id(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
    return F.coalesce(*present, content)


def dedupe_by_key(df: DataFrame, *order: Column, key: Column | None = None) -> DataFrame:
    """The first row per key in the given order."""
    keyed = df.withColumn("_key", payload_key(df) if key is None else key)
    return latest_per_group(keyed, ["_key"], *order).drop("_key")


def latest_matching(df: DataFrame, predicate: Column, *order: Column) -> DataFrame:
    """The first row in the given order that satisfies the predicate."""
    return df.where(predicate).orderBy(*order).limit(1)
