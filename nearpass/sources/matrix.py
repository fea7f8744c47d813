"""Matrix payloads: one header array and an array of rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.session import spread

MATRIX_SCHEMA = "count INT, fields ARRAY<STRING>, data ARRAY<ARRAY<STRING>>"


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Landed matrix documents, one per file."""
    return spark.read.schema(MATRIX_SCHEMA).option("multiLine", True).json(path)


def _entry(fields: Column, row: Column) -> Column:
    """Header and row as a map.  The longer of the two is cut, and of two equal
    names the last one counts."""
    width = F.least(F.size(fields), F.size(row))
    names, cells = F.slice(fields, F.lit(1), width), F.slice(row, F.lit(1), width)
    last_only = F.filter(
        F.transform(names, lambda name, i: F.struct(name.alias("name"), i.alias("i"))),
        lambda pair: ~F.array_contains(F.slice(names, pair["i"] + 2, width), pair["name"]),
    )
    return F.when(
        F.size(F.array_distinct(names)) == width, F.map_from_arrays(names, cells)
    ).otherwise(
        F.map_from_entries(F.transform(last_only, lambda pair: F.struct(pair["name"], F.get(cells, pair["i"]))))
    )


def zip_fields_rows(payloads: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """One row per matrix row with a map column `entry` (name -> cell).

    The rows of a payload are dealt out to all tasks before the maps are made,
    so a payload of very many rows keeps one task busy with taking it apart only.
    """
    rows = spread(payloads.select(*keep, "fields", F.posexplode("data").alias("row_no", "cells")))
    return rows.select(*keep, "row_no", _entry(F.col("fields"), F.col("cells")).alias("entry"))


def matrix_cells(payloads: DataFrame, names: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """One row per matrix row with a text column per wanted name.

    Positions are looked up once per payload; each row then costs one array
    access per column.  A name the header lacks gives NULL.  The rows of a
    payload are dealt out to all tasks before they are typed.
    """
    names = list(names)

    def places(name: str) -> Column:
        marked = F.transform("fields", lambda label, i: F.when(label == name, i))
        return F.filter(marked, lambda i: i.isNotNull()).alias(name)

    placed = payloads.select(*keep, F.struct(*[places(name) for name in names]).alias("places"), "data")
    rows = spread(placed.select(*keep, "places", F.posexplode("data").alias("row_no", "cells")))

    def value(name: str) -> Column:
        inside = F.filter(F.col("places").getField(name), lambda i: i < F.size("cells"))
        return F.get(F.col("cells"), F.array_max(inside)).alias(name)

    return rows.select(*keep, "row_no", *[value(name) for name in names])
