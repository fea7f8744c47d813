"""Orbit catalogue: bulk export and single-object documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.documents import json_or_null, named_value
from nearpass.functions.numbers import flag, safe_double, safe_int
from nearpass.functions.text import first_non_empty
from nearpass.schemas import ORBIT
from nearpass.sources.matrix import matrix_cells

# --- fixed values: names in the payloads ----------------------------------------
BULK_FIELDS = {
    "spkid": "spkid",
    "full_name": "fullname",
    "pdes": "designation",
    "name": "name",
    "kind": "object_kind",
    "neo": "is_neo",
    "pha": "is_pha",
    "orbit_id": "orbit_id",
    "class": "orbit_class",
    "epoch": "epoch_tdb",
    "e": "eccentricity",
    "a": "semi_major_axis_au",
    "q": "perihelion_dist_au",
    "ad": "aphelion_dist_au",
    "i": "inclination_deg",
    "om": "long_asc_node_deg",
    "w": "arg_perihelion_deg",
    "ma": "mean_anomaly_deg",
    "tp": "time_perihelion_tdb",
    "per": "orbital_period_days",
    "n": "mean_motion_deg_d",
    "moid": "moid_au",
    "moid_jup": "moid_jup",
    "t_jup": "t_jup",
    "condition_code": "condition_code",
    "data_arc": "data_arc_days",
    "n_obs_used": "n_obs_used",
    "n_del_obs_used": "n_del_obs_used",
    "n_dop_obs_used": "n_dop_obs_used",
    "rms": "rms",
    "first_obs": "first_obs_date",
    "last_obs": "last_obs_date",
    "H": "absolute_magnitude_h",
    "G": "magnitude_slope_g",
    "diameter": "diameter_km",
    "albedo": "albedo",
    "rot_per": "rotation_period_h",
}
BULK_EQUINOX = "J2000"

ELEMENT_COLUMNS = {
    "e": "eccentricity",
    "a": "semi_major_axis_au",
    "q": "perihelion_dist_au",
    "ad": "aphelion_dist_au",
    "i": "inclination_deg",
    "om": "long_asc_node_deg",
    "w": "arg_perihelion_deg",
    "ma": "mean_anomaly_deg",
    "tp": "time_perihelion_tdb",
    "per": "orbital_period_days",
    "n": "mean_motion_deg_d",
}
PHYSICAL_COLUMNS = {
    "H": "absolute_magnitude_h",
    "G": "magnitude_slope_g",
    "diameter": "diameter_km",
    "albedo": "albedo",
    "rot_per": "rotation_period_h",
    "I": "thermal_inertia",
}
OBJECT_COLUMNS = {
    "des": "designation",
    "fullname": "fullname",
    "shortname": "shortname",
    "spkid": "spkid",
    "kind": "object_kind",
    "prefix": "prefix",
}
ORBIT_COLUMNS = {
    "epoch": "epoch_tdb",
    "cov_epoch": "cov_epoch",
    "equinox": "equinox",
    "source": "orbit_source",
    "producer": "producer",
    "soln_date": "soln_date",
    "pe_used": "pe_used",
    "sb_used": "sb_used",
    "two_body": "two_body",
    "comment": "comment",
    "not_valid_before": "not_valid_before",
    "not_valid_after": "not_valid_after",
    "moid": "moid_au",
    "moid_jup": "moid_jup",
    "t_jup": "t_jup",
    "condition_code": "condition_code",
    "data_arc": "data_arc_days",
    "n_obs_used": "n_obs_used",
    "n_del_obs_used": "n_del_obs_used",
    "n_dop_obs_used": "n_dop_obs_used",
    "rms": "rms",
    "first_obs": "first_obs_date",
    "last_obs": "last_obs_date",
}
DISCOVERY_COLUMNS = {
    "date": "discovery_date",
    "site": "discovery_site",
    "location": "discovery_location",
    "who": "discovery_who",
    "name": "discovery_name",
    "ref": "discovery_ref",
    "cref": "discovery_cref",
    "discovery": "discovery_text",
    "citation": "discovery_citation",
}
_PAIRS = "ARRAY<STRUCT<name: STRING, value: STRING>>"
_TEXTS = "ARRAY<MAP<STRING, STRING>>"
DOCUMENT_SCHEMA = (
    "object STRUCT<des: STRING, fullname: STRING, shortname: STRING, spkid: STRING, kind: STRING, prefix: STRING,"
    " orbit_id: STRING, neo: BOOLEAN, pha: BOOLEAN, orbit_class: STRUCT<code: STRING, name: STRING>,"
    f" des_alt: {_TEXTS}>,"
    " orbit STRUCT<" + ", ".join(f"{name}: STRING" for name in ORBIT_COLUMNS) + ", orbit_id: STRING,"
    f" model_pars: {_TEXTS}, elements: {_PAIRS}>,"
    f" phys_par {_PAIRS},"
    " discovery STRUCT<" + ", ".join(f"{name}: STRING" for name in DISCOVERY_COLUMNS) + ">"
)
# --- end of fixed values ------------------------------------------------------------


def _typed(value: Column, column: str) -> Column:
    """A text cell as the type its column has in the orbit table."""
    kind = ORBIT.columns.get(column, "STRING")
    parse = {"DOUBLE": safe_double, "INT": safe_int, "BOOLEAN": flag}.get(kind, lambda text: text)
    return parse(value).alias(column)


def parse_bulk(payloads: DataFrame) -> DataFrame:
    """Bulk export to orbit records; rows without a primary designation are dropped.

    The result also has `name` and `row_no`, which the identifier index uses.
    """
    cells = matrix_cells(payloads, BULK_FIELDS).filter(F.coalesce(F.col("pdes"), F.lit("")) != "")
    known = cells.select("row_no", *[_typed(F.col(f"`{name}`"), column) for name, column in BULK_FIELDS.items()])
    return known.select(
        "row_no",
        "name",
        *[
            F.lit(BULK_EQUINOX).alias(column)
            if column == "equinox"
            else F.col(column)
            if column in known.columns
            else F.lit(None).cast(kind).alias(column)
            for column, kind in ORBIT.columns.items()
            if column != "asteroid_id"
        ],
    )


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Single-object documents, one JSON document per line."""
    return parse_objects(spark.read.schema(DOCUMENT_SCHEMA).json(path))


def parse_objects(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Single-object documents to orbit records; other documents are dropped."""
    elements, physical = F.col("orbit.elements"), F.col("phys_par")
    columns = {
        **{out: F.col(f"object.{name}") for name, out in OBJECT_COLUMNS.items()},
        "orbit_class": F.col("object.orbit_class.code"),
        "orbit_class_name": F.col("object.orbit_class.name"),
        "orbit_id": first_non_empty(F.col("object.orbit_id"), F.col("orbit.orbit_id")),
        "is_neo": F.coalesce(F.col("object.neo"), F.lit(False)),
        "is_pha": F.coalesce(F.col("object.pha"), F.lit(False)),
        "des_alt": json_or_null(F.col("object.des_alt")),
        **{out: F.col(f"orbit.{name}") for name, out in ORBIT_COLUMNS.items()},
        "model_pars": json_or_null(F.col("orbit.model_pars")),
        **{out: named_value(elements, name) for name, out in ELEMENT_COLUMNS.items()},
        **{out: named_value(physical, name) for name, out in PHYSICAL_COLUMNS.items()},
        "spectral_type": first_non_empty(named_value(physical, "spec_B"), named_value(physical, "spec_T")),
        **{out: F.col(f"discovery.{name}") for name, out in DISCOVERY_COLUMNS.items()},
    }
    ready = ("is_neo", "is_pha")
    return documents.filter(F.col("object").isNotNull()).select(
        *keep,
        *[
            columns[column].alias(column) if column in ready else _typed(columns[column], column)
            for column in ORBIT.columns
            if column != "asteroid_id"
        ],
    )
