"""Entity-shaped tables out of the benchmark's Parquet tables.

Every bridge keeps all rows of the table it starts from.  Doubles stand where
the stored tables have decimals, as the queries cast to double anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.session import spread


# Known layouts; naming them saves the job that reads file footers for a schema.
LAYOUTS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{sf_dir}/{name}.parquet")


def provisional(number: Column) -> Column:
    """An invented provisional designation, e.g. `2003 AB13`."""
    return F.concat((number % 30 + 1990).cast("string"), F.lit(" AB"), number.cast("string"))


def approaches(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    item = spread(item) if heavy else item
    object_id = F.col("l_partkey").cast("string")
    return item.join(part, item.l_partkey == part.p_partkey).select(
        F.to_date("l_shipdate").alias("close_approach_date"),
        object_id.alias("asteroid_id"),
        F.concat(object_id, F.lit(" "), F.col("p_name"), F.lit(" ("), provisional(F.col("l_partkey")), F.lit(")")).alias("name"),
        (F.col("p_size") / 100.0).alias("estimated_diameter_km_min"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 40.0).alias("estimated_diameter_km_max"),
        (F.col("l_returnflag") == "R").alias("is_potentially_hazardous"),
        (F.col("l_linestatus") == "F").alias("is_sentry_object"),
        F.col("l_orderkey").alias("epoch_date_close_approach"),
        F.when(F.col("l_orderkey") % 50 == 0, F.col("l_quantity") * 3)
        .otherwise(F.col("l_quantity"))
        .alias("relative_velocity_km_s"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * 1000).alias("miss_distance_km"),
        (F.col("l_discount") + 15.0).alias("absolute_magnitude_h"),
        F.lit("Earth").alias("orbiting_body"),
        F.col("l_orderkey").alias("src_order"),
        F.col("l_linenumber").alias("src_line"),
    )


def orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts; a third of them is catalogued under an id and a designation of
    its own, so the objects of those ids in the approach table have no orbit
    (unless the catalogue's `name` is theirs)."""
    number, size = F.col("p_partkey"), F.col("p_size")
    text, apart = number.cast("string"), number % 3 == 0
    return table(spark, sf_dir, "part").select(
        number.alias("row_no"),
        F.when(apart, F.concat(F.lit("S"), text)).otherwise(text).alias("asteroid_id"),
        F.when(apart, F.concat(F.lit("P-"), text)).otherwise(provisional(number)).alias("designation"),
        F.when(size % 5 == 0, F.concat(text, F.lit(" "), F.col("p_name"))).alias("name"),
        F.col("p_name").alias("fullname"),
        (number + 20000000).cast("string").alias("spkid"),
        F.when(size % 6 == 0, "APO")
        .when(size % 6 == 1, "AMO")
        .when(size % 6 == 2, "ATE")
        .when(size % 6 == 3, "IEO")
        .when(size % 6 == 4, "XXX")
        .alias("orbit_class"),
        F.when(size % 4 == 0, "").otherwise(F.col("p_type")).alias("orbit_class_name"),
        (size > 40).alias("is_pha"),
        (size / 10.0).alias("diameter_km"),
        (F.col("p_retailprice") / 10000.0).alias("moid_au"),
        ((size % 10) / 10.0).alias("eccentricity"),
        (size % 5 + 3.0).alias("t_jup"),
        F.date_add(F.lit("2024-01-01").cast("date"), (number % 30).cast("int")).alias("ingestion_date"),
    )


def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, nation, balance = F.col("s_suppkey"), F.col("s_nationkey"), F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(
        number.cast("string").alias("asteroid_id"),
        F.when(nation % 3 == 0, "active").when(nation % 3 == 1, "removed").otherwise("not_found").alias("status"),
        provisional(number).alias("designation"),
        F.col("s_name").alias("fullname"),
        (F.abs(balance) / 1.0e7).alias("impact_probability"),
        (nation % 11).alias("torino_scale"),
        F.when(nation != 3, balance / -1000.0).alias("palermo_scale_cum"),
        (balance / -900.0).alias("palermo_scale_max"),
    )


def risk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, balance = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.when(number % 2 == 0, number.cast("string"))
        .otherwise(F.concat(F.lit("E"), number.cast("string")))
        .alias("asteroid_id"),
        F.lit(True).alias("on_risk_list"),
        F.lower(provisional(number + 1)).alias("esa_designation"),
        (balance / 10.0).alias("diameter_m"),
        (balance / -1000.0).alias("ps_cum"),
        (F.col("c_nationkey") % 3).alias("ts"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("asteroid_id"),
        F.to_date("o_orderdate").alias("approach_date"),
        (F.col("o_totalprice") / 1.0e6).alias("distance_au"),
        (F.col("o_orderkey") % 40).cast("double").alias("v_rel_km_s"),
        F.col("o_orderpriority").alias("body"),
        F.col("o_orderkey").alias("src_order"),
    )


def fireballs(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("event_date"),
        value.alias("impact_energy_kt"),
        (value / 10.0).alias("velocity_km_s"),
        F.when(F.col("event_type") != "view", value / 5.0).alias("altitude_km"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed responses, several per (object, source)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("asteroid_id"),
        F.when(F.col("event_id") % 4 == 0, "JPL_SBDB")
        .when(F.col("event_id") % 4 == 1, "JPL_Sentry")
        .when(F.col("event_id") % 4 == 2, "JPL_CAD")
        .otherwise("ESA_NEOCC")
        .alias("source"),
        F.when(kind == "error", 404)
        .when(kind == "click", 200)
        .when(kind == "view", 429)
        .when(kind == "signup", 400)
        .otherwise(503)
        .alias("http_status"),
        F.when((kind == "signup") & (F.col("value") > 10), F.lit('{"message": "no matching object"}'))
        .when((kind == "click") & (F.col("value") > 40), F.lit('{"error": "object was removed"}'))
        .when((kind == "click") & (F.col("value") > 30), F.lit('{"error": "Not Found"}'))
        .when((kind == "click") & (F.col("value") < 1), F.lit("cut off {"))
        .otherwise(F.col("props"))
        .alias("body"),
        F.col("ts").alias("checked_at"),
        "event_id",
    )


def window_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("window_start")).agg(
        F.min("o_orderkey").alias("any_key"), F.count(F.lit(1)).alias("records")
    )
    pick = F.col("any_key") % 4
    return by_day.select(
        "window_start",
        F.date_add("window_start", 6).alias("window_end"),
        F.when(pick == 0, "SUCCESS")
        .when(pick == 1, "FAILED")
        .when(pick == 2, "SKIPPED")
        .otherwise("PENDING")
        .alias("status"),
        "records",
        (F.col("any_key") % 3 + 1).alias("attempt"),
        "any_key",
    )
