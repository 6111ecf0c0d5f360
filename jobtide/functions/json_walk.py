"""Texts inside JSON values of any nesting.

A value is walked with a list of what is still to visit, not by recursion, so nesting has no bound but that of the
JSON parsers (Spark's own ends at 1,000 levels). Values come in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of a language map that are tried before all others, in this order.
TEXT_KEYS = ("en", "en-US", "@value", "name", "ceterms:name")


def first_text(value: object) -> str:
    """The first text that is not blank: lists in order, maps by their well-known keys and then by any other."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            if value.strip():
                return value.strip()
        elif isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, dict):
            known = [value[k] for k in TEXT_KEYS if k in value]
            others = [v for k, v in value.items() if k not in TEXT_KEYS]
            todo.extend(reversed(known + others))
    return ""


def either(fields: dict, keys: Sequence[str]) -> object:
    """The value of the first of the keys that is neither missing nor empty, zero or false."""
    return next((fields[k] for k in keys if fields.get(k)), None)


def organization(value: object, keys: Sequence[str]) -> str:
    """The name of the first organization with one, of any lists of lists; a bare text names none."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo.extend(reversed(value))
        elif isinstance(value, dict):
            name = first_text(either(value, keys))
            if name:
                return name
    return ""


def _parsed(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else None
    except (ValueError, RecursionError):
        value = None
    return value if isinstance(value, dict) else {}


def texts(json_text: Column, **keys: Sequence[str]) -> Column:
    """A struct with, for each name, the first text below the first of its keys that has a value; "" without one."""

    @F.pandas_udf(", ".join(f"`{name}` string" for name in keys))
    def walk(values):
        import pandas as pd

        return pd.DataFrame([[first_text(either(fields, k)) for k in keys.values()] for fields in map(_parsed, values)], columns=list(keys), dtype=object)

    return walk(json_text)


def organizations(json_text: Column, owners: Sequence[str], names: Sequence[str]) -> Column:
    """The name of the first organization below the first of the owners' keys that has a value; "" without one."""

    @F.pandas_udf("string")
    def walk(values):
        return values.map(lambda text: organization(either(_parsed(text), owners), names))

    return walk(json_text)


def text_of(json_text: Column) -> Column:
    """The first text of a JSON value, null for text that is no JSON."""

    @F.pandas_udf("string")
    def walk(values):
        def one(text):
            try:
                return None if text is None else first_text(json.loads(text))
            except (ValueError, RecursionError):
                return None

        return values.map(one)

    return walk(json_text)
