"""Object profiles and enriched approach lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.operators.keyed import first_per_key, latest_per_key
from nearpass.operators.matching import risk_list_matches
from nearpass.schemas import ORBIT, PASSAGE, RISK, RISK_LIST

# --- fixed values: columns of the profile and of the approach list ---------------
PROFILE_ORBIT = {
    "designation": "sbdb_designation",
    "fullname": "sbdb_fullname",
    "spkid": "spkid",
    "orbit_class": "orbit_class",
    "orbit_class_name": "orbit_class_name",
    "eccentricity": "eccentricity",
    "semi_major_axis_au": "semi_major_axis_au",
    "perihelion_dist_au": "perihelion_dist_au",
    "aphelion_dist_au": "aphelion_dist_au",
    "inclination_deg": "inclination_deg",
    "moid_au": "moid_au",
    "t_jup": "t_jup",
    "condition_code": "condition_code",
    "absolute_magnitude_h": "sbdb_h",
    "diameter_km": "sbdb_diameter_km",
    "albedo": "albedo",
    "spectral_type": "spectral_type",
    "is_neo": "is_neo",
    "is_pha": "is_pha",
    "discovery_date": "discovery_date",
    "discovery_location": "discovery_location",
}
PROFILE_RISK = {
    "status": "sentry_status",
    "impact_probability": "impact_probability",
    "torino_scale": "torino_scale",
    "palermo_scale_cum": "palermo_scale_cum",
    "palermo_scale_max": "palermo_scale_max",
    "n_impacts": "n_impacts",
    "energy_mt": "energy_mt",
    "v_impact_km_s": "v_impact_km_s",
    "impact_date_range": "impact_date_range",
}
PROFILE_RISK_LIST = {
    "on_risk_list": "esa_on_risk_list",
    "ps_cum": "esa_ps_cum",
    "ts": "esa_torino_scale",
    "diameter_m": "esa_diameter_m",
}
PROFILE_APPROACH = ("name", "is_potentially_hazardous", "is_sentry_object")
PASSAGE_LIST = (
    "fullname",
    "approach_date",
    "approach_datetime",
    "distance_au",
    "distance_min_au",
    "v_rel_km_s",
    "h_mag",
    "diameter_km",
    "body",
)
FIRST_DAY = date(1899, 12, 30)
RECENT_PASSAGES = 50

# fixed values: sections of the nested document: key -> (title, column, units)
ORBITAL_ELEMENTS = {
    "epoch": ("Epoch", "epoch_tdb", "TDB"),
    "e": ("Eccentricity", "eccentricity", ""),
    "a": ("Semi-major Axis", "semi_major_axis_au", "AU"),
    "q": ("Perihelion Dist", "perihelion_dist_au", "AU"),
    "ad": ("Aphelion Dist", "aphelion_dist_au", "AU"),
    "i": ("Inclination", "inclination_deg", "deg"),
    "om": ("Long. Asc. Node", "long_asc_node_deg", "deg"),
    "w": ("Arg. Perihelion", "arg_perihelion_deg", "deg"),
    "ma": ("Mean Anomaly", "mean_anomaly_deg", "deg"),
    "per": ("Orbital Period", "orbital_period_days", "days"),
    "n": ("Mean Motion", "mean_motion_deg_d", "deg/d"),
    "moid": ("MOID", "moid_au", "AU"),
    "condition": ("Condition Code", "condition_code", ""),
    "arc": ("Data Arc", "data_arc_days", "days"),
    "n_obs": ("Observations Used", "n_obs_used", ""),
}
PHYSICAL_PARAMS = {
    "h": ("Absolute Mag (H)", "absolute_magnitude_h", "mag"),
    "diameter": ("Diameter", "diameter_km", "km"),
    "albedo": ("Albedo", "albedo", ""),
    "rot_per": ("Rotation Period", "rotation_period_h", "h"),
    "spec_type": ("Spectral Type", "spectral_type", ""),
}
DOCUMENT_RISK = (
    "status",
    "method",
    "impact_probability",
    "torino_scale",
    "palermo_scale_cum",
    "palermo_scale_max",
    "n_impacts",
    "v_infinity_km_s",
    "energy_mt",
    "diameter_km",
    "h_mag",
    "removed_date",
)
DOCUMENT_RISK_LIST = {
    "on_risk_list": "on_risk_list",
    "designation": "esa_designation",
    "name": "esa_name",
    "diameter_m": "diameter_m",
    "ip_max": "ip_max",
    "ip_cum": "ip_cum",
    "ps_max": "ps_max",
    "ps_cum": "ps_cum",
    "torino_scale": "ts",
    "vel_km_s": "vel_km_s",
    "years": "years",
}
DOCUMENT_PASSAGE = {
    "date": "approach_date",
    "datetime": "approach_datetime",
    "dist_au": "distance_au",
    "dist_min_au": "distance_min_au",
    "dist_max_au": "distance_max_au",
    "v_rel_km_s": "v_rel_km_s",
    "v_inf_km_s": "v_inf_km_s",
    "h_mag": "h_mag",
    "diameter_km": "diameter_km",
    "body": "body",
}
# --- end of fixed values ------------------------------------------------------------


def latest_approaches(approaches: DataFrame) -> DataFrame:
    """The last approach of each object; on a shared day the nearest one."""
    return latest_per_key(
        approaches, ["asteroid_id"], "close_approach_date",
        F.col("miss_distance_km").asc_nulls_last(), F.col("epoch_date_close_approach").asc_nulls_last(),
    )


def _renamed(df: DataFrame, names: dict[str, str], *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(name).alias(new) for name, new in names.items()])


def _tables(orbits: DataFrame, risks: DataFrame, risk_list: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return ORBIT.conform(orbits), RISK.conform(risks), RISK_LIST.conform(risk_list)


def object_profiles(approaches: DataFrame, orbits: DataFrame, risks: DataFrame, risk_list: DataFrame) -> DataFrame:
    """The last approach of each object with its orbit, impact risk and risk-list
    entries; an object with several entries has several rows."""
    orbits, risks, risk_list = _tables(orbits, risks, risk_list)
    objects = latest_approaches(approaches).select(
        "asteroid_id", *PROFILE_APPROACH, F.col("close_approach_date").alias("last_close_approach")
    )
    listed = _renamed(risk_list_matches(orbits, risk_list), PROFILE_RISK_LIST, "asteroid_id")
    return (
        objects.join(_renamed(orbits, PROFILE_ORBIT, "asteroid_id"), "asteroid_id", "left")
        .join(_renamed(risks, PROFILE_RISK, "asteroid_id"), "asteroid_id", "left")
        .join(listed, "asteroid_id", "left")
    )


def enriched_passages(
    passages: DataFrame, orbits: DataFrame, risks: DataFrame, risk_list: DataFrame, since: date = FIRST_DAY
) -> DataFrame:
    """Approach records since a date with risk scores and risk-list flag.

    What is known about an object is put together first, so the large table
    meets one table on one key.
    """
    orbits, risks, risk_list = _tables(orbits, risks, risk_list)
    risk = risks.select("asteroid_id", (F.col("status") == "active").alias("__active"), "palermo_scale_cum", "torino_scale")
    listed = risk_list_matches(orbits, risk_list).select("asteroid_id", F.col("on_risk_list").alias("esa_risk"))
    known = risk.join(listed, "asteroid_id", "full")
    recent = passages.filter(F.col("approach_date") >= F.lit(since))
    columns = [
        F.col(name) if name in passages.columns else F.lit(None).cast(PASSAGE.columns[name]).alias(name)
        for name in PASSAGE_LIST
    ]
    return (
        recent.select("asteroid_id", *columns)
        .join(known, "asteroid_id", "left")
        .select(
            "asteroid_id",
            *PASSAGE_LIST,
            F.coalesce("__active", F.lit(False)).alias("on_sentry_watchlist"),
            "palermo_scale_cum",
            "torino_scale",
            "esa_risk",
        )
        .orderBy(F.col("approach_date").asc_nulls_last())
    )


def recent_passages(passages: DataFrame, n: int = RECENT_PASSAGES) -> DataFrame:
    """The last `n` approach records of each object."""
    others = sorted(set(passages.columns) - {"asteroid_id", "approach_date", "distance_au"})
    ties = [F.col(f"`{name}`").asc_nulls_last() for name in ("distance_au", *others)]
    return first_per_key(passages, ["asteroid_id"], [F.col("approach_date").desc_nulls_last(), *ties], n)


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text."""
    def safe(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            return value.cast("double").alias(name)
        if kind == "date":
            return value.cast("string").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name)
        return value

    return df.select(*[safe(name, kind) for name, kind in df.dtypes])


def _section(parts: dict[str, tuple[str, str, str]]) -> Column:
    """A map key -> (title, value as text, units)."""
    entries = []
    for key, (title, column, units) in parts.items():
        entries += [
            F.lit(key),
            F.struct(
                F.lit(title).alias("title"), F.col(column).cast("string").alias("value"), F.lit(units).alias("units")
            ),
        ]
    return F.create_map(*entries)


def profile_documents(
    targets: DataFrame, orbits: DataFrame, risks: DataFrame, risk_list: DataFrame, passages: DataFrame
) -> DataFrame:
    """One nested document per target (`designation` asked for, `asteroid_id`).

    An agency without a record is left out.  A document holds the last 50
    approach records, so its size has a bound.
    """
    orbits, risks, risk_list = _tables(orbits, risks, risk_list)
    wanted = targets.select("asteroid_id").distinct()
    orbit_part = orbits.select(
        "asteroid_id",
        F.struct("is_neo", "is_pha", "fullname").alias("o"),
        F.struct(
            "designation", "fullname", "spkid", "orbit_class", "orbit_class_name",
            _section(ORBITAL_ELEMENTS).alias("orbital_elements"),
            _section(PHYSICAL_PARAMS).alias("physical_params"),
            F.struct(F.col("discovery_date").alias("date"), F.col("discovery_site").alias("site")).alias("discovery"),
        ).alias("jpl_sbdb"),
    )
    risk_part = risks.select("asteroid_id", F.struct(*DOCUMENT_RISK).alias("jpl_sentry"))
    list_part = risk_list.select(
        "asteroid_id", F.struct(*[F.col(c).alias(n) for n, c in DOCUMENT_RISK_LIST.items()]).alias("esa_neocc")
    )
    mine = recent_passages(PASSAGE.conform(passages).join(wanted, "asteroid_id", "left_semi"))
    entry = F.struct(
        *[F.col(c).cast("string" if c == "approach_date" else PASSAGE.columns[c]).alias(n) for n, c in DOCUMENT_PASSAGE.items()]
    )
    passage_part = mine.groupBy("asteroid_id").agg(
        F.struct(
            F.count(F.lit(1)).alias("count"),
            F.sort_array(F.collect_list(entry), asc=False).alias("approaches"),
        ).alias("jpl_cad")
    )
    joined = targets
    for part in (orbit_part, risk_part, passage_part, list_part):
        joined = joined.join(part, "asteroid_id", "left")
    return joined.select(
        "designation",
        "asteroid_id",
        F.coalesce(F.nullif(F.col("o.fullname"), F.lit("")), "designation").alias("name"),
        F.col("o.is_neo").alias("is_neo"),
        F.col("o.is_pha").alias("is_pha"),
        F.struct("jpl_sbdb", "jpl_sentry", "jpl_cad", "esa_neocc").alias("agencies"),
    )


def to_json_documents(documents: DataFrame) -> DataFrame:
    """(asteroid_id, document): NULL fields, and with them absent agencies, left out."""
    return documents.select("asteroid_id", F.to_json(F.struct(*documents.columns)).alias("document"))
