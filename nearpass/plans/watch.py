"""Impact watchlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.functions.numbers import safe_double
from nearpass.functions.risk import torino_band
from nearpass.schemas import RISK

# --- fixed values: columns and length of the lists ---------------------------------
WATCHLIST_COLUMNS = (
    "asteroid_id",
    "fullname",
    "designation",
    "sentry_id",
    "impact_probability",
    "torino_scale",
    "palermo_scale_cum",
    "palermo_scale_max",
    "n_impacts",
    "impact_date_range",
    "energy_mt",
    "diameter_km",
    "v_impact_km_s",
    "h_mag",
    "last_obs",
    "cdate",
)
TOP_WATCHLIST = 100
# --- end of fixed values --------------------------------------------------------------


def watchlist(risks: DataFrame) -> DataFrame:
    """Active objects, highest cumulative Palermo value first."""
    return (
        RISK.conform(risks)
        .filter(F.col("status") == "active")
        .select(*WATCHLIST_COLUMNS)
        .orderBy(F.col("palermo_scale_cum").desc_nulls_last(), "asteroid_id")
    )


def best_per_designation(entries: DataFrame, arrival: str, probability: str = "impact_probability") -> DataFrame:
    """The entry of each designation with the highest probability, the earlier
    one on a tie, and `first_seen`, the place of the designation in the list.

    One aggregate: a designation repeated without end leaves one row per task.
    """
    score = F.coalesce(safe_double(F.col(probability)), F.lit(0.0))
    columns = [name for name in entries.columns if name != "designation"]
    picked = entries.groupBy("designation").agg(
        F.max_by(F.struct(*columns), F.struct(score.alias("p"), (-F.col(arrival)).alias("a"))).alias("e"),
        F.min(arrival).alias("first_seen"),
    )
    return picked.select("designation", "e.*", "first_seen")


def top_watchlist(entries: DataFrame, arrival: str, n: int = TOP_WATCHLIST, probability: str = "impact_probability") -> DataFrame:
    """The `n` designations most likely to hit, with the colour band of their Torino value."""
    score = F.coalesce(safe_double(F.col(probability)), F.lit(0.0))
    return (
        best_per_designation(entries, arrival, probability)
        .withColumn("torino_band", torino_band(F.col("torino_scale")))
        .orderBy(score.desc(), "first_seen")
        .limit(n)
    )
