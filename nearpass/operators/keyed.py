"""One row per key.

`row_number = 1` right above the window makes Spark cut every key to its best
row before the shuffle as well as after it, so a key that holds a large share
of the table sends one row per task, not all of its rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def first_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of each key in the given order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RANK, F.row_number().over(window)).filter(F.col(_RANK) <= n).drop(_RANK)


def latest_per_key(df: DataFrame, keys: Iterable[str], by: str, *ties: Column) -> DataFrame:
    """The newest row per key; rows without a time come last."""
    return first_per_key(df, keys, [F.col(by).desc_nulls_last(), *ties])


def dedupe_last(df: DataFrame, keys: Iterable[str], arrival: Iterable[str], *ties: Column) -> DataFrame:
    """The row of each key that arrived last."""
    return first_per_key(df, keys, [*[F.col(name).desc_nulls_last() for name in arrival], *ties])


def dedupe_approaches(df: DataFrame) -> DataFrame:
    """One approach per date and object: the nearest pass, then the earliest;
    rows that agree in both and the name go by their other columns, in the order of the names."""
    first = ["miss_distance_km", "epoch_date_close_approach", "name"]
    keys = ["close_approach_date", "asteroid_id"]
    others = sorted(set(df.columns) - {*first, *keys})
    return first_per_key(df, keys, [F.col(f"`{name}`").asc_nulls_last() for name in first + others])
