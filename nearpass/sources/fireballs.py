"""Fireball events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.functions.dates import event_time
from nearpass.functions.numbers import safe_double
from nearpass.schemas import FIREBALL
from nearpass.sources.matrix import matrix_cells

# --- fixed values: names in the payload ------------------------------------------
# `energy` is in units of 10^10 J and is stored as sent; latitude and longitude
# are unsigned, their direction is a column of its own.
FIREBALL_COLUMNS = {
    "date": "event_date",
    "energy": "total_radiated_energy_j",
    "impact-e": "impact_energy_kt",
    "lat": "latitude",
    "lat-dir": "latitude_dir",
    "lon": "longitude",
    "lon-dir": "longitude_dir",
    "alt": "altitude_km",
    "vel": "velocity_km_s",
}
# --- end of fixed values -----------------------------------------------------------


def parse_fireballs(payloads: DataFrame) -> DataFrame:
    """Matrix payloads to events; rows without a readable date are dropped."""
    parse = {"TIMESTAMP": event_time, "DOUBLE": safe_double}
    return (
        matrix_cells(payloads, FIREBALL_COLUMNS)
        .select(
            *[
                parse.get(FIREBALL.columns[out], lambda text: text)(F.col(f"`{name}`")).alias(out)
                for name, out in FIREBALL_COLUMNS.items()
            ]
        )
        .filter(F.col("event_date").isNotNull())
    )
