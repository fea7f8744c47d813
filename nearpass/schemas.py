"""Entities: column names and types, keys and storage partitioning.

The column lists are fixed values: sources, sinks and queries all agree on
these names.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entity:
    """One keyed table.

    `year_of` is the date column whose year partitions the stored table.
    """

    name: str
    keys: tuple[str, ...]
    columns: dict[str, str]
    year_of: str | None = None
    defaults: dict[str, object] = field(default_factory=dict)

    @property
    def ddl(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self.columns.items())

    @property
    def struct(self) -> str:
        return "STRUCT<" + ", ".join(f"`{name}`: {kind}" for name, kind in self.columns.items()) + ">"

    def conform(self, df: DataFrame) -> DataFrame:
        """Project `df` to this entity: missing columns become their default."""
        return self.conform_keeping(df, ())

    def conform_keeping(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """The same with the columns in `keep` in front, as they are."""
        return df.select(*keep, *self.typed(df.columns))

    def typed(self, present: Iterable[str]) -> list[Column]:
        """The columns of this entity out of a frame that has those in `present`."""
        present = set(present)

        def column(name: str, kind: str) -> Column:
            if name not in present:
                return F.lit(self.defaults.get(name)).cast(kind).alias(name)
            value = F.col(name).try_cast(kind)
            if name in self.defaults:
                value = F.coalesce(value, F.lit(self.defaults[name]).cast(kind))
            return value.alias(name)

        return [column(name, kind) for name, kind in self.columns.items()]


def _columns(text: str) -> dict[str, str]:
    """'type: name name ...' lines to an ordered name -> type mapping."""
    out: dict[str, str] = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        kind, names = line.split(":")
        for name in names.split():
            out[name] = kind.strip()
    return out


# --- fixed values: entity columns -------------------------------------------

APPROACH = Entity(
    name="close_approaches",
    keys=("close_approach_date", "asteroid_id"),
    year_of="close_approach_date",
    columns=_columns(
        """
        DATE: close_approach_date
        STRING: asteroid_id neo_reference_id name
        DOUBLE: absolute_magnitude_h
        DOUBLE: estimated_diameter_km_min estimated_diameter_km_max
        DOUBLE: estimated_diameter_m_min estimated_diameter_m_max
        DOUBLE: estimated_diameter_miles_min estimated_diameter_miles_max
        DOUBLE: estimated_diameter_feet_min estimated_diameter_feet_max
        BOOLEAN: is_potentially_hazardous is_sentry_object
        STRING: close_approach_date_full
        BIGINT: epoch_date_close_approach
        STRING: orbiting_body
        DECIMAL(38,18): relative_velocity_km_s relative_velocity_km_h relative_velocity_mph
        DECIMAL(38,18): miss_distance_astronomical miss_distance_lunar miss_distance_km miss_distance_miles
        STRING: nasa_jpl_url
        """
    ),
)

ORBIT = Entity(
    name="sbdb",
    keys=("asteroid_id",),
    columns=_columns(
        """
        STRING: asteroid_id designation fullname shortname spkid object_kind prefix
        STRING: orbit_class orbit_class_name orbit_id
        BOOLEAN: is_neo is_pha
        STRING: des_alt epoch_tdb cov_epoch equinox orbit_source producer soln_date pe_used sb_used
        STRING: two_body comment not_valid_before not_valid_after
        DOUBLE: eccentricity semi_major_axis_au perihelion_dist_au aphelion_dist_au
        DOUBLE: inclination_deg long_asc_node_deg arg_perihelion_deg mean_anomaly_deg
        STRING: time_perihelion_tdb
        DOUBLE: orbital_period_days mean_motion_deg_d moid_au moid_jup t_jup
        STRING: condition_code
        INT: data_arc_days n_obs_used n_del_obs_used n_dop_obs_used
        DOUBLE: rms
        STRING: first_obs_date last_obs_date model_pars
        DOUBLE: absolute_magnitude_h magnitude_slope_g diameter_km albedo rotation_period_h
        STRING: thermal_inertia spectral_type
        STRING: discovery_date discovery_site discovery_location discovery_who discovery_name
        STRING: discovery_ref discovery_cref discovery_text discovery_citation
        """
    ),
)

RISK = Entity(
    name="sentry",
    keys=("asteroid_id",),
    columns=_columns(
        """
        STRING: asteroid_id status designation fullname sentry_id method
        DOUBLE: impact_probability
        INT: torino_scale
        DOUBLE: palermo_scale_cum palermo_scale_max
        INT: n_impacts
        STRING: impact_date_range
        DOUBLE: v_infinity_km_s v_impact_km_s energy_mt mass_kg diameter_km h_mag
        STRING: first_obs last_obs last_obs_jd arc_days
        INT: n_obs n_del n_dop
        STRING: n_sat pdate cdate removed_date
        """
    ),
    defaults={"status": "unknown"},
)

RISK_LIST = Entity(
    name="esa",
    keys=("asteroid_id",),
    columns=_columns(
        """
        STRING: asteroid_id
        BOOLEAN: on_risk_list
        STRING: esa_designation esa_name
        DOUBLE: diameter_m
        BOOLEAN: diameter_certain
        STRING: vi_date
        DOUBLE: ip_max ps_max
        INT: ts
        DOUBLE: vel_km_s
        STRING: years
        DOUBLE: ip_cum ps_cum
        """
    ),
    defaults={"on_risk_list": True},
)

PASSAGE = Entity(
    name="cad",
    keys=("asteroid_id", "approach_date"),
    year_of="approach_date",
    columns=_columns(
        """
        STRING: asteroid_id
        DATE: approach_date
        STRING: approach_datetime orbit_id
        DOUBLE: jd distance_au distance_min_au distance_max_au v_rel_km_s v_inf_km_s
        STRING: t_sigma_f
        DOUBLE: h_mag diameter_km diameter_sigma
        STRING: fullname body
        """
    ),
    defaults={"body": "Earth"},
)

FIREBALL = Entity(
    name="fireball",
    keys=("event_date",),
    year_of="event_date",
    columns=_columns(
        """
        TIMESTAMP: event_date
        DOUBLE: total_radiated_energy_j impact_energy_kt latitude
        STRING: latitude_dir
        DOUBLE: longitude
        STRING: longitude_dir
        DOUBLE: altitude_km velocity_km_s
        """
    ),
)

FETCH_STATUS = Entity(
    name="fetch_status",
    keys=("asteroid_id", "source"),
    columns=_columns(
        """
        STRING: asteroid_id source
        INT: status_code
        STRING: last_failure_type
        TIMESTAMP: last_checked_at not_found_until
        STRING: lookup_value
        """
    ),
)

WINDOW_LEDGER = Entity(
    name="window_ledger",
    keys=("window_start", "window_end"),
    columns=_columns(
        """
        DATE: window_start window_end
        STRING: status
        BIGINT: records
        STRING: error reason
        INT: attempt
        """
    ),
)

WINDOW_HOLD = Entity(
    name="window_hold",
    keys=("window_start", "window_end"),
    columns=_columns(
        """
        DATE: window_start window_end
        INT: last_status_code
        TIMESTAMP: last_checked_at not_found_until
        """
    ),
)

# Parts of an agency envelope and the entity each one feeds.
ENVELOPE_PARTS = {"sbdb": ORBIT, "sentry": RISK, "cad": PASSAGE, "esa": RISK_LIST, "fireball": FIREBALL}

# Names of the sources in the fetch-status ledger.
SOURCE_ORBIT = "JPL_SBDB"
SOURCE_RISK = "JPL_Sentry"
SOURCE_PASSAGE = "JPL_CAD"
SOURCE_RISK_LIST = "ESA_NEOCC"

# --- end of fixed values ------------------------------------------------------
