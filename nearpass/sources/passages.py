"""Close-approach records of the approach catalogue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.functions.dates import passage_date
from nearpass.functions.numbers import safe_double
from nearpass.functions.text import strip
from nearpass.schemas import PASSAGE
from nearpass.sources.matrix import matrix_cells

# --- fixed values: names in the payload and defaults -----------------------------
PASSAGE_COLUMNS = {
    "des": "designation",
    "orbit_id": "orbit_id",
    "jd": "jd",
    "cd": "approach_datetime",
    "dist": "distance_au",
    "dist_min": "distance_min_au",
    "dist_max": "distance_max_au",
    "v_rel": "v_rel_km_s",
    "v_inf": "v_inf_km_s",
    "t_sigma_f": "t_sigma_f",
    "h": "h_mag",
    "diameter": "diameter_km",
    "diameter_sigma": "diameter_sigma",
    "fullname": "fullname",
    "body": "body",
}
DEFAULT_BODY = "Earth"
DEFAULT_CUTOFF_AU = 0.5
# --- end of fixed values -------------------------------------------------------------


def parse_passages(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Matrix payloads to approach records with their `designation`; rows whose
    date cannot be read are dropped."""
    cells = matrix_cells(payloads, PASSAGE_COLUMNS, keep)
    named = cells.select(*keep, "row_no", *[F.col(f"`{name}`").alias(out) for name, out in PASSAGE_COLUMNS.items()])
    texts = {
        "approach_date": passage_date(F.col("approach_datetime")),
        "fullname": strip(F.coalesce(F.col("fullname"), F.lit(""))),
        "body": F.coalesce(F.col("body"), F.lit(DEFAULT_BODY)),
    }
    return named.select(
        *keep,
        "row_no",
        "designation",
        *[
            texts[column].alias(column)
            if column in texts
            else (safe_double(F.col(column)) if kind == "DOUBLE" else F.col(column)).alias(column)
            for column, kind in PASSAGE.columns.items()
            if column != "asteroid_id"
        ],
    ).filter(F.col("approach_date").isNotNull())


def in_range(
    passages: DataFrame,
    date_min: date | None = None,
    date_max: date | None = None,
    dist_max_au: float | None = None,
) -> DataFrame:
    """Records inside a date range and a distance limit; `None` means no limit,
    and a missing distance is dropped only by a distance limit."""
    if date_min is not None:
        passages = passages.filter(F.col("approach_date") >= F.lit(date_min))
    if date_max is not None:
        passages = passages.filter(F.col("approach_date") <= F.lit(date_max))
    if dist_max_au is not None:
        passages = passages.filter(F.col("distance_au") <= dist_max_au)
    return passages


def with_designation(passages: DataFrame) -> DataFrame:
    """Records that can be looked up by designation.

    The lookup joins these flat rows; no object's records are ever gathered
    into one value, however many it has.
    """
    return passages.filter(F.coalesce(F.col("designation"), F.lit("")) != "")


def designation_groups(passages: DataFrame) -> DataFrame:
    """One row per designation: how many records, from when to when, how near."""
    return with_designation(passages).groupBy("designation").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("approach_date").alias("first_date"),
        F.max("approach_date").alias("last_date"),
        F.min("distance_au").alias("nearest_au"),
    )
