"""Small helpers for nested documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_value(pairs: Column, name: str) -> Column:
    """Value of the last entry called `name` in an array of (name, value)."""
    hits = F.filter(pairs, lambda pair: pair["name"] == name)
    return F.try_element_at(hits, F.lit(-1))["value"]


def json_or_null(value: Column) -> Column:
    """JSON text of an array or map, NULL when it is empty or missing."""
    return F.when(F.size(value) > 0, F.to_json(value))
