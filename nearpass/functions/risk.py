"""Risk score, anomaly flag, class names and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: risk score ---------------------------------------------------
VELOCITY_SCALE, VELOCITY_WEIGHT = 40.0, 0.35
DIAMETER_SCALE, DIAMETER_WEIGHT = 5.0, 0.35
DISTANCE_SCALE, DISTANCE_WEIGHT = 1000000.0, 0.30
HAZARD_BONUS = 0.15
HIGH_RISK = 0.6
ANOMALY_Z = 2

# fixed values: orbit classes
ORBIT_CLASSES = {
    "APO": "Apollo",
    "AMO": "Amor",
    "ATE": "Aten",
    "IEO": "Atira",
    "MCA": "Mars-crossing Asteroid",
    "OMB": "Outer Main-belt Asteroid",
    "TJN": "Jupiter Trojan",
    "CEN": "Centaur",
    "TNO": "TransNeptunian Object",
    "JFC": "Jupiter-family Comet",
    "HTC": "Halley-type Comet",
    "ETc": "Encke-type Comet",
    "HYA": "Hyperbolic Asteroid",
    "HYC": "Hyperbolic Comet",
    "PAR": "Parabolic Asteroid",
    "PAC": "Parabolic Comet",
}

# fixed values: upper limits (exclusive, km) of the size classes
SIZE_CLASSES = ((0.01, "<10m"), (0.1, "10-100m"), (0.5, "100-500m"), (1.0, "500m-1km"))
LARGEST_SIZE = ">1km"

# fixed values: upper limits (inclusive) of the Torino bands
TORINO_BANDS = ((0, "0"), (1, "1"), (4, "2-4"), (7, "5-7"))
TOP_BAND = "8+"
# --- end of fixed values ----------------------------------------------------------


def representative_diameter(largest: Column, smallest: Column) -> Column:
    """The upper diameter estimate, or the lower one where only that is known."""
    return F.coalesce(largest, smallest)


def risk_score(velocity: Column, diameter: Column, miss_distance: Column, hazardous: Column) -> Column:
    """Score in [0, 1] from speed, size, nearness and the hazard flag; 0 when
    the miss distance is unknown."""
    known = lambda value: F.coalesce(value.cast("double"), F.lit(0.0))
    nearness = 1.0 / F.greatest(miss_distance.cast("double"), F.lit(1.0)) * DISTANCE_SCALE
    # The order of the operations decides ties at the high-risk limit.
    total = (
        known(velocity) / VELOCITY_SCALE * VELOCITY_WEIGHT
        + known(diameter) / DIAMETER_SCALE * DIAMETER_WEIGHT
        + nearness * DISTANCE_WEIGHT
        + F.when(hazardous, F.lit(HAZARD_BONUS)).otherwise(F.lit(0.0))
    )
    return F.when(miss_distance.isNull(), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    )


def is_anomaly(*zscores: Column) -> Column:
    """True when any |z| exceeds the limit; an unknown z counts as 0."""
    sizes = [F.abs(F.coalesce(z, F.lit(0.0))) for z in zscores]
    return (F.greatest(*sizes) if len(sizes) > 1 else sizes[0]) > ANOMALY_Z


def orbit_class_label(code: Column, given: Column) -> Column:
    """Known class name, else the given name if there is one, else the code."""
    pairs = [F.lit(text) for pair in ORBIT_CLASSES.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.nullif(given, F.lit("")), code)


def size_class(diameter_km: Column) -> Column:
    label = None
    for limit, name in SIZE_CLASSES:
        label = F.when(diameter_km < limit, name) if label is None else label.when(diameter_km < limit, name)
    return label.otherwise(LARGEST_SIZE)


def torino_band(scale: Column) -> Column:
    """Band of a Torino value; unknown counts as 0."""
    value = F.coalesce(scale, F.lit(0))
    label = None
    for limit, name in TORINO_BANDS:
        label = F.when(value <= limit, name) if label is None else label.when(value <= limit, name)
    return label.otherwise(TOP_BAND)


def velocity_bucket(velocity: Column, low: float = 0.0, high: float = 40.0, buckets: int = 8) -> Column:
    """Equal-width bucket number; 0 below the range, `buckets` + 1 above it."""
    return F.width_bucket(velocity.cast("double"), F.lit(low), F.lit(high), F.lit(buckets))
