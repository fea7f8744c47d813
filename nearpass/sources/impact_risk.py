"""Impact-risk lists: active objects, removed objects, single-object documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.numbers import safe_double, safe_int
from nearpass.functions.text import normalise_designation
from nearpass.schemas import RISK
from nearpass.session import spread

# --- fixed values: names in the payloads ----------------------------------------
ACTIVE_COLUMNS = {
    "des": "designation",
    "fullname": "fullname",
    "id": "sentry_id",
    "ip": "impact_probability",
    "ts_max": "torino_scale",
    "ps_cum": "palermo_scale_cum",
    "ps_max": "palermo_scale_max",
    "n_imp": "n_impacts",
    "range": "impact_date_range",
    "v_inf": "v_infinity_km_s",
    "diameter": "diameter_km",
    "h": "h_mag",
    "last_obs": "last_obs",
    "last_obs_jd": "last_obs_jd",
}
SUMMARY_COLUMNS = {
    "des": "designation",
    "fullname": "fullname",
    "method": "method",
    "ip": "impact_probability",
    "ts_max": "torino_scale",
    "ps_cum": "palermo_scale_cum",
    "ps_max": "palermo_scale_max",
    "n_imp": "n_impacts",
    "v_inf": "v_infinity_km_s",
    "v_imp": "v_impact_km_s",
    "energy": "energy_mt",
    "mass": "mass_kg",
    "diameter": "diameter_km",
    "h": "h_mag",
    "first_obs": "first_obs",
    "last_obs": "last_obs",
    "darc": "arc_days",
    "nobs": "n_obs",
    "ndel": "n_del",
    "ndop": "n_dop",
    "nsat": "n_sat",
    "pdate": "pdate",
    "cdate": "cdate",
}
ACTIVE_SCHEMA = "data ARRAY<STRUCT<" + ", ".join(f"`{name}`: STRING" for name in ACTIVE_COLUMNS) + ">>"
REMOVED_SCHEMA = "data ARRAY<STRUCT<des: STRING, removed: STRING>>"
OBJECT_SCHEMA = (
    "error STRING, removed STRING, summary STRUCT<" + ", ".join(f"`{name}`: STRING" for name in SUMMARY_COLUMNS) + ">"
)
ACTIVE, REMOVED, NOT_LISTED = "active", "removed", "not_found"
# --- end of fixed values ------------------------------------------------------------


def _typed(value: Column, column: str) -> Column:
    parse = {"DOUBLE": safe_double, "INT": safe_int}.get(RISK.columns[column], lambda text: text)
    return parse(value).alias(column)


def _record(values: dict[str, Column]) -> list[Column]:
    """Every risk column but the id, NULL where the payload has nothing."""
    return [
        _typed(values[column], column) if column in values else F.lit(None).cast(kind).alias(column)
        for column, kind in RISK.columns.items()
        if column != "asteroid_id"
    ]


def read_active(spark: SparkSession, path: str) -> DataFrame:
    return parse_active(spark.read.schema(ACTIVE_SCHEMA).option("multiLine", True).json(path))


def parse_active(payloads: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Active list to risk records; `row_no` is the place in the list."""
    entries = spread(payloads.select(*keep, F.posexplode("data").alias("row_no", "e")))
    values = {out: F.col(f"e.`{name}`") for name, out in ACTIVE_COLUMNS.items()}
    return entries.select(*keep, "row_no", *_record({**values, "status": F.lit(ACTIVE)}))


def read_removed(spark: SparkSession, path: str) -> DataFrame:
    return parse_removed(spark.read.schema(REMOVED_SCHEMA).option("multiLine", True).json(path))


def parse_removed(payloads: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Removed list to (key, removed_date), the last entry of a key counting.

    `order` names the columns that order the payloads themselves.
    """
    entries = payloads.select(*order, F.posexplode("data").alias("row_no", "e"))
    return (
        entries.groupBy(normalise_designation(F.coalesce(F.col("e.des"), F.lit(""))).alias("key"))
        .agg(F.max_by(F.struct("e.removed"), F.struct(*order, "row_no")).alias("last"))
        .select("key", F.col("last.removed").alias("removed_date"))
    )


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Single-object documents, one per line, with the designation asked for."""
    return parse_objects(spark.read.schema(f"designation STRING, {OBJECT_SCHEMA}").json(path))


def parse_objects(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Single-object documents (with the `designation` asked for) to risk records.

    An error that mentions a removal gives a removed object; any other error,
    or no summary, an object that is not listed.
    """
    status = (
        F.when(F.col("error").ilike("%removed%"), F.lit(REMOVED))
        .when(F.col("error").isNotNull() | F.col("summary").isNull(), F.lit(NOT_LISTED))
        .otherwise(F.lit(ACTIVE))
    )
    active = F.col("status") == ACTIVE
    values = {out: F.when(active, F.col(f"summary.`{name}`")) for name, out in SUMMARY_COLUMNS.items()}
    values["status"] = F.col("status")
    values["designation"] = F.when(active, F.col("summary.des")).otherwise(F.col("asked"))
    values["removed_date"] = F.when(F.col("status") == REMOVED, F.col("removed"))
    judged = documents.select(
        *keep, F.col("designation").alias("asked"), "error", "removed", "summary", status.alias("status")
    )
    return judged.select(*keep, *_record(values))
