"""Every registered query: (session, folder of Parquet tables) -> DataFrame.

All of them read whole tables.  Derived doubles are rounded, to nine digits
or, for kilometre distances, to four, so that engines that add in a different
order agree.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions import dates, numbers, risk, text
from nearpass.functions.fetches import classify_fetches, response_outcome
from nearpass.functions.hashing import record_hash, row_hash
from nearpass.operators import cascade, changes, keyed, lookup, matching, resolve
from nearpass.operators.zscore import zscore
from nearpass.plans import metrics, profiles, search, views, watch, windows, worklist
from nearpass.schemas import APPROACH, FETCH_STATUS, ORBIT, PASSAGE, RISK, RISK_LIST, WINDOW_LEDGER
from nearpass.session import configure, materialise, run_folder
from nearpass.sinks import envelopes
from nearpass.sinks.changelog import KeyedTable
from nearpass.sinks.chunks import write_chunked
from nearpass.sinks.publish import approach_key, publish, to_keyed_json
from nearpass.sources import approaches as feed
from nearpass.sources import agencies, bridge, impact_risk, orbits, passages, risk_list, tables
from nearpass.sources.fireballs import parse_fireballs
from nearpass.sources.matrix import MATRIX_SCHEMA, zip_fields_rows
from nearpass.streaming import agency_stream, approach_stream, progress
from nearpass.streaming.measures import IngestLog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed moments the time-dependent queries are asked about.
WINDOW_START = date(1998, 6, 1)
HOLDS_AS_OF = datetime(2024, 2, 15)
WORK_AS_OF = datetime(2024, 1, 25)
WORK_LIMIT = 1500
WINDOWS_AS_OF = datetime(1998, 6, 1)
DIST_MAX_AU = 0.3
DATE_MIN, DATE_MAX = date(1996, 1, 1), date(1998, 12, 31)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def tidy(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Round every double; columns in `special` to their own number of digits."""
    return df.select(
        *[
            F.round(name, special.get(name, digits)).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


# --- aggregates ---------------------------------------------------------------------

@query
def daily_metrics(spark, d):
    return tidy(metrics.daily_metrics(bridge.approaches(spark, d)), avg_miss_distance_km=4, min_miss_distance_km=4)


@query
def object_zscores(spark, d):
    """Z-scores of size classes and speeds per object, each against its own kind."""
    df = bridge.orbits(spark, d).select("asteroid_id", "orbit_class", "diameter_km", "t_jup")
    whole = zscore(df, {"diameter_km": "diameter_z"})
    return tidy(zscore(whole, {"t_jup": "t_jup_z"}, partition_by=["orbit_class"]), 6)


@query
def approach_stats(spark, d):
    return metrics.approach_stats(bridge.approaches(spark, d))


@query
def estimated_objects(spark, d):
    """Distinct objects per year and in all by sketches that were merged from two halves: within 5 % of the exact number?"""
    approaches = bridge.approaches(spark, d)
    half = F.col("src_order") % 2 == 0
    sketches = metrics.merge_sketches(metrics.object_sketches(approaches.filter(half)), metrics.object_sketches(approaches.filter(~half)))
    sketches = materialise(sketches)
    exact = approaches.groupBy(F.year("close_approach_date").alias("year")).agg(F.count_distinct("asteroid_id").alias("exact"))
    years = sketches.join(exact, "year").select("year", "n_records", F.hll_sketch_estimate("objects").alias("estimate"), "exact")
    whole = metrics.estimated_objects(sketches).crossJoin(approaches.agg(F.count_distinct("asteroid_id").alias("exact"))).select(
        F.lit(None).cast("int").alias("year"), F.col("total_records").alias("n_records"), F.col("unique_asteroids").alias("estimate"), "exact"
    )
    near = F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact") + 1
    return years.unionByName(whole).select("year", "n_records", near.alias("is_near"))


@query
def approach_summary(spark, d):
    return tidy(metrics.approach_summary(bridge.approaches(spark, d)), closest_approach_km=4)


@query
def velocity_histogram(spark, d):
    return metrics.velocity_histogram(bridge.approaches(spark, d))


@query
def size_classes(spark, d):
    return metrics.size_classes(bridge.approaches(spark, d))


@query
def approach_window(spark, d):
    return tidy(metrics.approach_window(bridge.approaches(spark, d), WINDOW_START), miss_distance_km=4)


@query
def approach_window_summary(spark, d):
    return metrics.approach_window_summary(bridge.approaches(spark, d), WINDOW_START, 30)


@query
def orbit_class_dist(spark, d):
    return tidy(metrics.orbit_class_distribution(bridge.orbits(spark, d)))


@query
def fireball_annual(spark, d):
    return tidy(metrics.fireball_summary(bridge.fireballs(spark, d)), 4)


@query
def fireball_daily(spark, d):
    return tidy(metrics.fireball_summary(bridge.fireballs(spark, d), "day"), 6)


@query
def fireball_latest(spark, d):
    return tidy(metrics.latest_fireballs(bridge.fireballs(spark, d), 20))


@query
def agency_table_counts(spark, d):
    return metrics.table_counts(
        {
            "sbdb": bridge.orbits(spark, d),
            "sentry": bridge.risks(spark, d),
            "cad": bridge.passages(spark, d),
            "esa": bridge.risk_list(spark, d),
        }
    )


@query
def text_profile(spark, d):
    return tables.text_profile(bridge.table(spark, d, "documents"), "text", "source")


# --- keyed picks and profiles --------------------------------------------------------

@query
def latest_approach(spark, d):
    latest = profiles.latest_approaches(bridge.approaches(spark, d))
    return tidy(latest.select("asteroid_id", "name", "close_approach_date", "miss_distance_km"), 4)


@query
def dedupe_approaches(spark, d):
    kept = keyed.dedupe_approaches(bridge.approaches(spark, d, heavy=True))
    return tidy(kept.select("close_approach_date", "asteroid_id", "epoch_date_close_approach", "miss_distance_km"), 4)


@query
def dedupe_passages(spark, d):
    kept = keyed.dedupe_last(bridge.passages(spark, d), ["asteroid_id", "approach_date"], ["src_order"])
    return tidy(kept)


@query
def object_profile(spark, d):
    wide = profiles.object_profiles(
        bridge.approaches(spark, d), bridge.orbits(spark, d), bridge.risks(spark, d), bridge.risk_list(spark, d)
    )
    return tidy(
        wide.select(
            "asteroid_id", "name", "is_potentially_hazardous", "last_close_approach", "sbdb_designation", "spkid",
            "orbit_class", "moid_au", "is_pha", "sentry_status", "impact_probability", "torino_scale",
            "palermo_scale_cum", "esa_on_risk_list", "esa_ps_cum", "esa_torino_scale", "esa_diameter_m",
        )
    )


@query
def cad_enriched(spark, d):
    rich = profiles.enriched_passages(
        bridge.passages(spark, d),
        bridge.orbits(spark, d), bridge.risks(spark, d), bridge.risk_list(spark, d),
    )
    return tidy(
        rich.select(
            "asteroid_id", "approach_date", "distance_au", "v_rel_km_s", "body", "on_sentry_watchlist",
            "palermo_scale_cum", "torino_scale", "esa_risk",
        )
    )


@query
def cad_range(spark, d):
    return tidy(passages.in_range(bridge.passages(spark, d), DATE_MIN, DATE_MAX, DIST_MAX_AU).drop("src_order"))


@query
def recent_passages(spark, d):
    return tidy(profiles.recent_passages(bridge.passages(spark, d)).select("asteroid_id", "approach_date", "distance_au"))


def _profile_documents(spark, d):
    objects = bridge.approaches(spark, d).select("asteroid_id").distinct()
    targets = objects.select("asteroid_id", F.col("asteroid_id").alias("designation"))
    return profiles.profile_documents(
        targets, bridge.orbits(spark, d), bridge.risks(spark, d), bridge.risk_list(spark, d), bridge.passages(spark, d)
    )


@query
def profile_document(spark, d):
    """Facts read back out of the nested documents' JSON text."""
    documents = profiles.to_json_documents(_profile_documents(spark, d)).withColumn("v", F.parse_json("document"))

    def at(path: str) -> Column:
        return F.try_variant_get("v", path, "string")

    return documents.select(
        "asteroid_id",
        at("$.name").alias("name"),
        at("$.is_pha").cast("boolean").alias("is_pha"),
        at("$.agencies.jpl_sbdb.designation").alias("designation"),
        F.round(at("$.agencies.jpl_sbdb.orbital_elements.moid.value").cast("double"), 9).alias("moid_au"),
        at("$.agencies.jpl_sbdb.orbital_elements.moid.units").alias("moid_units"),
        at("$.agencies.jpl_sentry.status").alias("sentry_status"),
        at("$.agencies.jpl_cad.count").cast("bigint").alias("n_passages"),
        at("$.agencies.jpl_cad.approaches[0].date").alias("last_passage"),
        at("$.agencies.esa_neocc.designation").alias("esa_designation"),
        F.try_variant_get("v", "$.agencies.esa_neocc", "variant").isNotNull().alias("has_esa"),
    )


@query
def json_safe_rows(spark, d):
    safe = profiles.json_safe(
        bridge.fireballs(spark, d).select(
            "event_date", F.col("impact_energy_kt").cast("decimal(38,18)").alias("impact_energy_kt"),
            F.to_date("event_date").alias("day"),
        )
    )
    return tidy(safe)


# --- watchlists ------------------------------------------------------------------------

@query
def sentry_watchlist(spark, d):
    return tidy(
        watch.watchlist(bridge.risks(spark, d)).select(
            "asteroid_id", "fullname", "designation", "impact_probability", "torino_scale", "palermo_scale_cum",
            "palermo_scale_max",
        )
    )


def _entries(spark, d):
    """A watchlist with several entries per designation."""
    return bridge.table(spark, d, "orders").select(
        bridge.provisional(F.col("o_custkey")).alias("designation"),
        F.round(F.col("o_totalprice") / 1.0e4, 0).alias("impact_probability"),
        (F.col("o_orderkey") % 11).cast("int").alias("torino_scale"),
        F.col("o_orderkey").alias("arrival"),
    )


@query
def best_per_designation(spark, d):
    return tidy(watch.best_per_designation(_entries(spark, d), "arrival"))


@query
def watchlist_top100(spark, d):
    return tidy(watch.top_watchlist(_entries(spark, d), "arrival"))


@query
def torino_bands(spark, d):
    band = risk.torino_band(F.col("torino_scale"))
    return bridge.risks(spark, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_objects"))


# --- expressions -------------------------------------------------------------------------

def _objects(spark, d):
    return resolve.object_names(bridge.approaches(spark, d))


@query
def object_names(spark, d):
    return _objects(spark, d)


@query
def candidates(spark, d):
    made = resolve.with_candidates(_objects(spark, d))
    return made.select("asteroid_id", F.array_join("candidates", "|").alias("candidates"))


@query
def normalised_names(spark, d):
    name = F.col("name")
    return _objects(spark, d).select(
        "asteroid_id",
        text.normalise_designation(F.upper(name)).alias("key"),
        text.without_blanks(text.normalise_designation(name, "()")).alias("bare"),
        text.leading_number(name).alias("number"),
    )


def _number_texts(spark, d):
    """Numbers spelled in several ways, some of them not numbers."""
    n, price = F.col("o_orderkey"), F.col("o_custkey")
    kind = n % 8
    spelled = (
        F.when(kind == 0, F.concat(F.lit(" "), price.cast("string"), F.lit(" ")))
        .when(kind == 1, F.concat(price.cast("string"), F.lit(".0")))
        .when(kind == 2, F.concat(price.cast("string"), F.lit("E-3")))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, F.concat(price.cast("string"), F.lit("d")))
        .when(kind == 5, F.concat(F.lit("-."), price.cast("string")))
        .when(kind == 6, F.concat(F.lit("n/a "), price.cast("string")))
    )
    return bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), spelled.alias("raw"))


@query
def safe_casts(spark, d):
    return tidy(
        _number_texts(spark, d).select(
            "n", numbers.safe_double(F.col("raw")).alias("as_double"), numbers.safe_int(F.col("raw")).alias("as_int")
        )
    )


def _date_texts(spark, d):
    n, day = F.col("o_orderkey"), F.col("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    return bridge.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("n"),
        F.when(n % 4 == 0, F.date_format(day, "yyyy-MMM-dd HH:mm"))
        .when(n % 4 == 1, F.concat(iso, F.lit(" 05:23")))
        .when(n % 4 == 2, F.concat(F.lit("on "), iso))
        .otherwise(iso)
        .alias("raw"),
    )


@query
def cad_dates(spark, d):
    return _date_texts(spark, d).select(
        "n", dates.passage_date(F.col("raw")).alias("passage_date"), dates.approach_date(F.col("raw")).alias("iso_date")
    )


@query
def row_hashes(spark, d):
    columns = ["close_approach_date", "asteroid_id", "orbiting_body", "epoch_date_close_approach", "maybe"]
    df = bridge.approaches(spark, d).select(
        "src_order", "src_line", *columns[:-1], F.when(F.col("src_line") != 3, F.col("name")).alias("maybe")
    )
    return df.select(
        "src_order", "src_line", row_hash(columns, null_token=None).alias("loose"), row_hash(columns, null_token="~").alias("strict")
    )


@query
def record_hashes(spark, d):
    """Hashes of nested records: maps in any order, nulls, texts that look like borders."""
    number, size = F.col("p_partkey"), F.col("p_size")
    pairs = [F.struct(F.lit("b").alias("k"), F.col("p_type").alias("v")), F.struct(F.lit("a||1:").alias("k"), F.col("p_brand").alias("v"))]
    records = bridge.table(spark, d, "part").select(
        number.alias("id"),
        F.when(number % 2 == 0, F.map_from_entries(F.array(*pairs))).otherwise(F.map_from_entries(F.array(*pairs[::-1]))).alias("attributes"),
        F.when(size % 5 != 0, F.array(F.col("p_name"), F.lit(None), F.lit("||"))).alias("parts"),
        F.struct(size.alias("size"), F.when(size % 3 == 0, F.lit("")).alias("mark")).alias("measured"),
    )
    return records.select("id", record_hash(records).alias("hash"))


# --- readers --------------------------------------------------------------------------------

def _parsed(texts: DataFrame, schema: str, *keep: str) -> DataFrame:
    return feed.parse_messages(texts, schema).select(*keep, "d.*")


def _approach_messages(spark, d):
    return feed.to_messages(bridge.approaches(spark, d, heavy=True))


@query
def flatten_messages(spark, d):
    """Approaches as keyed JSON text, parsed, flattened, typed and deduplicated."""
    raw = to_keyed_json(_approach_messages(spark, d), approach_key())
    good, _ = feed.split_malformed(feed.parse_messages(raw), "asteroid")
    flat = APPROACH.conform(feed.drop_incomplete(feed.flatten_messages(good.select("d.*"))))
    kept = keyed.dedupe_approaches(flat)
    return tidy(
        kept.select(
            "close_approach_date", "asteroid_id", "name", "is_potentially_hazardous", "estimated_diameter_km_max",
            F.col("relative_velocity_km_s").cast("double").alias("relative_velocity_km_s"),
            F.col("miss_distance_km").cast("double").alias("miss_distance_km"),
            "epoch_date_close_approach",
        ),
        miss_distance_km=4,
    )


@query
def feed_documents(spark, d):
    """Feed documents (map of day to objects) as JSON text, back to messages."""
    messages = _approach_messages(spark, d)
    documents = messages.select(
        F.to_json(F.struct(F.create_map("date", F.array("asteroid")).alias("near_earth_objects"))).alias("value")
    )
    back = feed.flatten_messages(feed.feed_to_messages(_parsed(documents, feed.FEED_SCHEMA)))
    return back.groupBy(F.col("close_approach_date").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_distinct("asteroid_id").alias("n_objects")
    )


@query
def feed_days(spark, d):
    """Feed documents of many days and many objects a day, as JSON text, back to messages."""
    order = F.col("epoch_date_close_approach").cast("double")
    rows = bridge.approaches(spark, d).withColumn("document", F.floor(order / ROWS_PER_DOCUMENT))
    # Flat rows are dealt out by document; lists by day and by document are then made where the rows are.
    messages = feed.to_messages(rows.repartition("document"), ("document",))
    by_day = messages.groupBy("document", "date").agg(F.collect_list("asteroid").alias("objects"))
    by_document = by_day.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("date", "objects"))).alias("near_earth_objects"))
    texts = by_document.select(F.to_json(F.struct("near_earth_objects")).alias("value"))
    back = feed.flatten_messages(feed.feed_to_messages(_parsed(texts, feed.FEED_SCHEMA)))
    return back.groupBy(F.col("close_approach_date").cast("date").alias("day"), "asteroid_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.round(F.sum(F.col("miss_distance_km").cast("double")), 2).alias("miss_km")
    )


@query
def row_rejects(spark, d):
    """Rows of good messages whose key cannot be stored, by what is wrong with each part of it."""
    source = F.col("src_order")
    broken = bridge.approaches(spark, d, heavy=True).withColumns(
        {
            "close_approach_date": F.when(source % 13 == 0, F.concat(F.col("close_approach_date").cast("string"), F.lit("T99")))
            .when(source % 17 == 0, F.lit("1998-02-30")).when(source % 19 != 0, F.col("close_approach_date").cast("string")),
            "asteroid_id": F.when(F.col("src_line") != 5, F.col("asteroid_id")),
        }
    )
    raw = to_keyed_json(feed.to_messages(broken), approach_key())
    arrived = raw.select("value", *[F.lit(0).alias(name) for name in feed.ARRIVAL])
    good, _ = feed.split_malformed(feed.parse_messages(arrived), "asteroid")
    checked = approach_stream.checked_rows(good)
    return checked.groupBy(
        F.try_element_at("faults", F.lit("close_approach_date")).alias("date_fault"),
        F.try_element_at("faults", F.lit("asteroid_id")).alias("id_fault"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def published_keys(spark, d):
    """Messages published with their keys, by date, and read back: what each key holds."""
    path = f"{run_folder(spark)}/messages"
    publish(to_keyed_json(_approach_messages(spark, d), approach_key(by_date=True)), "json", path=path)
    raw = spark.read.schema("key STRING, value STRING").json(path)
    parsed = feed.parse_messages(raw).select("key", "d.date", F.col("d.asteroid.id").alias("asteroid_id"))
    return parsed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_distinct("asteroid_id").alias("n_objects"),
        F.bool_and(F.col("key") == F.col("date")).alias("agrees"),
    )


@query
def malformed_messages(spark, d):
    """Messages cut in the middle or without an object go to quarantine."""
    raw = to_keyed_json(_approach_messages(spark, d), approach_key())
    number = F.col("key").cast("bigint")
    cut = raw.select(
        F.when(number % 5 == 0, F.substr("value", F.lit(1), F.floor(F.length("value") / 2).cast("int")))
        .when(number % 7 == 0, F.lit('{"date": "1998-01-01"}'))
        .otherwise(F.col("value"))
        .alias("value")
    )
    judged = feed.with_verdict(feed.parse_messages(cut), "asteroid")
    return judged.groupBy(F.coalesce("verdict", F.lit("good")).alias("verdict")).agg(F.count(F.lit(1)).alias("n_messages"))


ROWS_PER_DOCUMENT = 400


def _bulk_payloads(spark, d):
    """The orbit catalogue as matrix payloads, one row each, some rows short."""
    o = bridge.table(spark, d, "part")
    number, size = F.col("p_partkey"), F.col("p_size")
    names = ["spkid", "full_name", "pdes", "name", "neo", "pha", "class", "e", "moid", "n_obs_used", "H"]
    cells = F.array(
        (number + 20000000).cast("string"),
        F.col("p_name"),
        F.when(size == 13, F.lit("")).otherwise(bridge.provisional(number)),
        F.col("p_type"),
        F.when(size % 2 == 0, "Y").otherwise("N"),
        F.when(size > 40, "Y"),
        F.when(size % 6 == 0, "APO").otherwise("AMO"),
        ((size % 10) / 10.0).cast("string"),
        (F.col("p_retailprice") / 10000.0).cast("string"),
        F.when(size % 3 == 0, F.lit("12.0")).otherwise(size.cast("string")),
        F.lit("17.25"),
    )
    width = F.when(size % 4 == 0, F.lit(9)).otherwise(F.lit(11))
    return o.select(
        number.alias("payload"),
        F.array(*[F.lit(n) for n in names]).alias("fields"),
        F.array(F.slice(cells, F.lit(1), width)).alias("data"),
    )


@query
def sbdb_bulk(spark, d):
    return tidy(
        orbits.parse_bulk(_bulk_payloads(spark, d)).select(
            "designation", "spkid", "fullname", "is_neo", "is_pha", "orbit_class", "equinox", "eccentricity", "moid_au",
            "n_obs_used", "absolute_magnitude_h",
        )
    )


@query
def bulk_documents(spark, d):
    """The same catalogue in documents of many rows, whose header the rows share; every other header stands reversed."""
    apart = _bulk_payloads(spark, d).select(
        F.floor(F.col("payload") / ROWS_PER_DOCUMENT).alias("document"), "payload", "fields", F.col("data")[0].alias("cells")
    )
    # Short rows are filled up, as a cell's place decides what it is.
    turned = F.col("document") % 2 == 1
    full = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.size("fields") - F.size("cells")))
    rows = apart.select(
        "document", "payload", F.when(turned, F.reverse("fields")).otherwise(F.col("fields")).alias("fields"),
        F.when(turned, F.reverse(full)).otherwise(F.col("cells")).alias("cells"),
    )
    documents = rows.groupBy("document").agg(
        F.first("fields").alias("fields"), F.sort_array(F.collect_list(F.struct("payload", "cells"))).alias("rows")
    )
    texts = documents.select(F.to_json(F.struct("fields", F.col("rows.cells").alias("data"))).alias("value"))
    parsed = orbits.parse_bulk(_parsed(texts, MATRIX_SCHEMA))
    return tidy(
        parsed.select(
            "designation", "spkid", "fullname", "is_neo", "is_pha", "orbit_class", "eccentricity", "n_obs_used", "absolute_magnitude_h"
        )
    )


@query
def zip_fields(spark, d):
    """Matrix rows as maps; a header that names a column twice keeps the last cell."""
    payloads = _bulk_payloads(spark, d).withColumn(
        "fields",
        F.when(F.col("payload") % 2 == 0, F.transform("fields", lambda f: F.when(f == "name", F.lit("full_name")).otherwise(f)))
        .otherwise(F.col("fields")),
    )
    rows = zip_fields_rows(payloads, keep=["payload"])
    return rows.select(
        "payload",
        F.try_element_at("entry", F.lit("pdes")).alias("pdes"),
        F.try_element_at("entry", F.lit("full_name")).alias("full_name"),
        F.try_element_at("entry", F.lit("H")).alias("h"),
        F.size("entry").alias("n_cells"),
    )


@query
def sbdb_documents(spark, d):
    """Orbit documents as JSON text: name/value arrays, nested class, fallbacks."""
    number, size = F.col("p_partkey"), F.col("p_size")

    def pair(name: str | Column, value: Column) -> Column:
        label = F.lit(name) if isinstance(name, str) else name
        return F.struct(label.alias("name"), value.cast("string").alias("value"))

    document = F.struct(
        F.struct(
            bridge.provisional(number).alias("des"),
            F.col("p_name").alias("fullname"),
            (number + 20000000).cast("string").alias("spkid"),
            F.when(size % 2 == 0, F.lit("")).otherwise(F.lit("obj")).alias("orbit_id"),
            (size % 3 == 0).alias("neo"),
            F.when(size > 40, F.lit(True)).alias("pha"),
            F.struct(F.lit("APO").alias("code"), F.col("p_type").alias("name")).alias("orbit_class"),
            F.when(size % 5 == 0, F.array(F.create_map(F.lit("des"), F.col("p_brand")))).otherwise(F.array()).alias("des_alt"),
        ).alias("object"),
        F.struct(
            F.lit("orb").alias("orbit_id"),
            size.cast("string").alias("data_arc"),
            F.array(pair("e", size / 100.0), pair("e", size / 50.0), pair("", size), pair("a", number / 7.0)).alias("elements"),
        ).alias("orbit"),
        F.when(
            size % 7 != 0,
            F.array(
                pair("H", F.lit("17.5")),
                pair("spec_B", F.when(size % 2 == 0, F.lit("")).otherwise(F.lit("Sq"))),
                pair("spec_T", F.lit("S")),
            ),
        ).alias("phys_par"),
    )
    texts = bridge.table(spark, d, "part").select(F.to_json(document).alias("value"))
    parsed = orbits.parse_objects(_parsed(texts, orbits.DOCUMENT_SCHEMA))
    return tidy(
        parsed.select(
            "designation", "spkid", "orbit_id", "is_neo", "is_pha", "orbit_class", "orbit_class_name", "des_alt",
            "data_arc_days", "eccentricity", "semi_major_axis_au", "absolute_magnitude_h", "spectral_type",
        ),
        6,
    )


@query
def cad_payloads(spark, d):
    """Approach records out of matrix payloads; rows without a date are dropped."""
    o = bridge.table(spark, d, "orders")
    n, iso = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    cells = F.array(
        bridge.provisional(F.col("o_custkey")),
        F.when(n % 4 == 0, F.date_format("o_orderdate", "yyyy-MMM-dd HH:mm")).when(n % 4 == 1, iso).when(n % 4 == 2, F.lit("")),
        (F.col("o_totalprice") / 1.0e6).cast("string"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")),
    )
    payloads = o.select(
        F.array(F.lit("des"), F.lit("cd"), F.lit("dist"), F.lit("fullname")).alias("fields"), F.array(cells).alias("data")
    )
    parsed = passages.parse_passages(payloads)
    return tidy(parsed.select("designation", "approach_date", "distance_au", "fullname", "body"))


@query
def cad_designations(spark, d):
    named = bridge.passages(spark, d).withColumn(
        "designation", F.when(F.col("body") == "5-LOW", "").otherwise(bridge.provisional(F.col("asteroid_id").cast("bigint")))
    )
    return tidy(passages.designation_groups(named))


@query
def fireball_payloads(spark, d):
    e = bridge.table(spark, d, "events")
    cells = F.array(
        F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        F.col("value").cast("string"),
        F.lit("N"),
    )
    payloads = e.select(
        F.array(F.lit("date"), F.lit("impact-e"), F.lit("lat-dir")).alias("fields"), F.array(cells).alias("data")
    )
    events = parse_fireballs(payloads)
    return tidy(
        events.groupBy(F.to_date("event_date").alias("day"), "latitude_dir").agg(
            F.count(F.lit(1)).alias("n_events"), F.sum("impact_energy_kt").alias("energy_kt")
        ),
        6,
    )


def _risk_lines(spark, d):
    """The risk list as text lines, with headers and broken lines among them."""
    n, balance = F.col("c_custkey"), F.col("c_acctbal")
    designation = F.replace(bridge.provisional(n), F.lit(" "), F.lit(""))
    line = F.concat_ws(
        "|",
        F.when(n % 3 == 0, F.concat(designation, F.lit("   "), F.col("c_mktsegment"))).otherwise(F.concat(designation, F.lit("   "))),
        F.concat(F.lit(" "), (balance / 10.0).cast("string"), F.lit(" ")),
        F.when(n % 2 == 0, F.lit("  *  ")).otherwise(F.lit("     ")),
        F.lit(" 2044-11-08 17:08 "),
        F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit("E-3 ")),
        F.concat(F.lit(" "), (balance / -1000.0).cast("string"), F.lit(" ")),
        F.when(n % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), (F.col("c_nationkey") % 3).cast("string"))),
        F.lit(" 21.01 "),
        F.lit(" 2044-2049 "),
        F.lit(" 2.35E-3 "),
        F.lit(" -2.67 "),
        F.lit(""),
    )
    broken = (
        F.when(n % 50 == 1, F.lit("Last Update: 2026-01-01 00:00 UTC"))
        .when(n % 50 == 2, F.lit("Num/des  Name | m | *=Y | Date/Time | IP max | PS max"))
        .when(n % 50 == 3, F.lit("2031AB7 | 14 | * | 2044"))
        .when(n % 50 == 4, F.lit("   | 14 | * | 2044 | 1E-3 | -2 |"))
        .when(n % 50 == 5, F.lit("   "))
        .otherwise(line)
    )
    return bridge.table(spark, d, "customer").select(n.alias("line_no"), broken.alias("value"))


@query
def esa_parse(spark, d):
    return tidy(
        risk_list.parse_risk_list(_risk_lines(spark, d), keep=("line_no",)).select(
            "line_no", "key", "esa_designation", "esa_name", "diameter_m", "diameter_certain", "vi_date", "ip_max",
            "ps_max", "ts", "years", "ps_cum",
        )
    )


@query
def esa_overlay(spark, d):
    """The regular list with the records of a special list on top."""
    regular = risk_list.parse_risk_list(_risk_lines(spark, d), keep=("line_no",))
    special = bridge.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("line_no"),
        F.concat(F.replace(bridge.provisional(F.col("s_suppkey")), F.lit(" "), F.lit("")), F.lit(" Special | 7 | * | x | 1E-1")).alias("value"),
    )
    both = risk_list.overlay(regular, risk_list.parse_risk_list(special, keep=("line_no",)), ("line_no",))
    return tidy(both.select("key", "esa_name", "diameter_m", "ip_max", "is_special"))


@query
def sentry_active(spark, d):
    s = bridge.table(spark, d, "supplier")
    entry = F.struct(
        bridge.provisional(F.col("s_suppkey")).alias("des"),
        F.col("s_name").alias("fullname"),
        (F.abs("s_acctbal") / 1.0e7).cast("string").alias("ip"),
        (F.col("s_nationkey") % 11).cast("string").alias("ts_max"),
        F.when(F.col("s_nationkey") != 3, (F.col("s_acctbal") / -1000.0).cast("string")).alias("ps_cum"),
        F.lit("12.0").alias("n_imp"),
    )
    texts = s.select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("value"))
    parsed = impact_risk.parse_active(_parsed(texts, impact_risk.ACTIVE_SCHEMA))
    return tidy(
        parsed.select("designation", "status", "fullname", "impact_probability", "torino_scale", "palermo_scale_cum", "n_impacts")
    )


@query
def sentry_removed(spark, d):
    c = bridge.table(spark, d, "customer")
    entry = F.struct(
        F.concat(F.lit("("), bridge.provisional(F.floor(F.col("c_custkey") / 3)), F.lit(")")).alias("des"),
        F.col("c_name").alias("removed"),
    )
    payloads = c.select(F.col("c_custkey").alias("payload"), F.array(entry).alias("data"))
    return impact_risk.parse_removed(payloads, ("payload",))


@query
def sentry_documents(spark, d):
    n = F.col("s_nationkey")
    document = F.struct(
        F.when(n % 4 == 0, F.lit("specified object was Removed")).when(n % 4 == 1, F.lit("no such thing")).alias("error"),
        F.when(n % 4 == 0, F.lit("2021-05-01")).alias("removed"),
        F.when(
            n % 4 != 2,
            F.struct(
                bridge.provisional(F.col("s_suppkey")).alias("des"),
                (F.abs("s_acctbal") / 1.0e7).cast("string").alias("ip"),
                n.cast("string").alias("nobs"),
            ),
        ).alias("summary"),
    )
    texts = bridge.table(spark, d, "supplier").select(F.col("s_name").alias("designation"), F.to_json(document).alias("value"))
    parsed = _parsed(texts, impact_risk.OBJECT_SCHEMA, "designation")
    return tidy(
        impact_risk.parse_objects(parsed).select("designation", "status", "impact_probability", "n_obs", "removed_date")
    )


# --- resolution ----------------------------------------------------------------------------------

def _orbit_hits(spark, d):
    objects = resolve.with_candidates(_objects(spark, d))
    return resolve.resolve_orbits(objects, resolve.orbit_refs(bridge.orbits(spark, d), "row_no", "asteroid_id"))


@query
def resolve_sbdb(spark, d):
    return _orbit_hits(spark, d).select(
        "asteroid_id", F.col("sbdb.ref.id").alias("sbdb_id"), F.col("sbdb.pos").alias("pos"), F.col("sbdb.form").alias("form"),
        F.array_join(resolve.extended_candidates(F.col("candidates"), F.col("sbdb")), "|").alias("candidates"),
    )


@query
def sbdb_coverage(spark, d):
    return resolve.coverage(_orbit_hits(spark, d))


@query
def gap_fill(spark, d):
    return resolve.gap_fill(_orbit_hits(spark, d))


@query
def index_collisions(spark, d):
    index = resolve.orbit_refs(bridge.orbits(spark, d).withColumn("name", F.col("fullname")), "row_no", "asteroid_id")
    return index.filter(F.col("n_records") > 1).select("key", F.col("ref.id").alias("sbdb_id"), "n_records")


def _fetch_statuses(spark, d):
    last = keyed.dedupe_last(bridge.fetches(spark, d), ["asteroid_id", "source"], ["checked_at", "event_id"])
    return classify_fetches(last)


def _catalogues(spark, d):
    risks = bridge.risks(spark, d).withColumn("row_no", F.col("asteroid_id").cast("bigint"))
    active = risks.filter(F.col("status") == "active")
    removed = risks.filter(F.col("status") == "removed").select(
        text.normalise_designation(F.col("designation")).alias("key"), F.col("fullname").alias("removed_date")
    )
    named = bridge.passages(spark, d).withColumn("designation", bridge.provisional(F.col("asteroid_id").cast("bigint")))
    listed = bridge.risk_list(spark, d).withColumn(
        "key",
        F.when(F.startswith("asteroid_id", F.lit("E")), text.without_blanks(F.col("esa_designation")))
        .otherwise(F.col("esa_designation")),
    )
    return active, removed, named, listed


@query
def resolve_profiles(spark, d):
    active, removed, named, listed = _catalogues(spark, d)
    holds = resolve.active_holds(_fetch_statuses(spark, d), HOLDS_AS_OF)
    found = resolve.resolve_profiles(
        _objects(spark, d), bridge.orbits(spark, d), active, removed, named, listed, holds
    )
    return found.select(
        "asteroid_id", F.array_join("candidates", "|").alias("candidates"), "sbdb_id", "sentry_status",
        "sentry_designation", "sentry_key", "removed_date", "cad_designation", "on_risk_list", "esa_key",
    )


def _landed_documents(spark, d):
    """Responses to the identifiers of all parts: two under the number, the later
    one decides, and one under the designation; documents, refusals and a text
    cut in the middle."""
    number, size = F.col("p_partkey"), F.col("p_size")
    document = F.to_json(F.struct(F.struct(F.col("des"), F.col("spkid")).alias("object")))
    refusal = F.lit('{"message": "no matching object"}')
    part = bridge.table(spark, d, "part")
    early = part.select(
        number.cast("string").alias("lookup_value"), F.when(size % 4 == 1, 200).otherwise(404).alias("http_status"),
        bridge.provisional(number + 5).alias("des"), F.lit("").alias("spkid"), F.lit(0).alias("checked_at"), (size % 4 == 1).alias("ok"),
    )
    late = part.select(
        number.cast("string"), F.when(size % 4 < 2, 200).otherwise(404), F.when(size % 8 < 4, bridge.provisional(number + 1)),
        (number + 30000000).cast("string"), F.lit(1), size % 4 == 0,
    )
    named = part.select(
        bridge.provisional(number), F.when(size % 4 < 3, 200).otherwise(503), bridge.provisional(number * 2),
        number.cast("string"), F.lit(0), size % 4 < 3,
    )
    landed = early.union(late).union(named)
    body = F.when(F.col("ok"), document).when(F.col("http_status") == 200, F.lit('{"object": {"des"')).otherwise(refusal)
    texts = landed.select("lookup_value", "http_status", "checked_at", body.alias("value"))
    parsed = feed.parse_messages(texts, orbits.DOCUMENT_SCHEMA).select("lookup_value", "http_status", "checked_at", "value", "d.object")
    return parsed.select(
        "lookup_value", "http_status", "checked_at", F.col("value").alias("body"), F.col("object").isNotNull().alias("has_document"),
        F.col("object.des").alias("designation"), F.col("object.spkid").alias("spkid"),
    )


def _second_pass(spark, d):
    """(first pass, holds, tries made): the first pass is stored, as fetching lies between."""
    active, removed, named, listed = _catalogues(spark, d)
    holds = resolve.active_holds(_fetch_statuses(spark, d), HOLDS_AS_OF)
    first = materialise(
        resolve.resolve_profiles(_objects(spark, d), bridge.orbits(spark, d), active, removed, named, listed, holds)
    )
    return first, holds, resolve.answered_tries(resolve.open_tries(first, holds), _landed_documents(spark, d))


@query
def resolve_second_pass(spark, d):
    """From landed documents to final references: the misses of the first pass, answered and looked up again."""
    first, holds, tried = _second_pass(spark, d)
    active, removed, named, listed = _catalogues(spark, d)
    final = resolve.resolve_again(first, materialise(tried), active, removed, named, listed, holds)
    return final.select(
        "asteroid_id", F.array_join("candidates", "|").alias("candidates"), "sbdb_id", "answered_by", "sentry_status",
        "sentry_designation", "sentry_key", "removed_date", "cad_designation", "on_risk_list", "esa_key",
    )


@query
def gap_fill_tries(spark, d):
    """The tries of the gap filling as status rows: those up to the first answer."""
    _, _, tried = _second_pass(spark, d)
    outcome = response_outcome(F.col("http_status"), F.col("body"))
    return tried.withColumn("outcome", outcome).select(
        "asteroid_id", "try_no", "lookup_value", "is_answer", "outcome.status_code", "outcome.last_failure_type"
    )


@query
def risk_name_lookup(spark, d):
    """Names looked up on the active list: as a whole, then by leading number."""
    active = bridge.risks(spark, d).select(
        F.when(F.col("torino_scale") % 2 == 0, F.col("asteroid_id")).otherwise(F.col("designation")).alias("designation"),
        "asteroid_id",
    )
    index = lookup.key_index(
        active, text.normalise_designation(F.col("designation")), F.col("asteroid_id"), ("asteroid_id",), "risk"
    )
    number = F.col("c_custkey")
    asked = bridge.table(spark, d, "customer").select(
        number.alias("query_id"),
        F.when(number % 2 == 0, F.concat(F.lit(" ("), bridge.provisional(number), F.lit(")")))
        .otherwise(F.concat(number.cast("string"), F.lit(" Somewhere")))
        .alias("query"),
    )
    return lookup.lookup_names(asked, index).select("query_id", F.col("ref").alias("asteroid_id"))


@query
def removed_names(spark, d):
    _, removed, _, _ = _catalogues(spark, d)
    asked = _objects(spark, d).select("asteroid_id", bridge.provisional(F.col("asteroid_id").cast("bigint")).alias("query"))
    return lookup.was_removed(asked, removed).select("asteroid_id")


def _query_texts(spark, d):
    number, name = F.col("p_partkey"), F.col("p_name")
    kind = number % 8
    return bridge.table(spark, d, "part").select(
        number.alias("query_id"),
        F.when(kind == 0, number.cast("string"))
        .when(kind == 1, bridge.provisional(number))
        .when(kind == 2, (number + 20000000).cast("string"))
        .when(kind == 3, F.concat(F.lit("SUPPLIER#0000000"), F.lpad((number % 100).cast("string"), 2, "0")))
        .when(kind == 4, F.upper(F.concat(name, F.lit(" (1995"))))
        .when(kind == 5, F.concat(F.lit("no such object "), number.cast("string")))
        .when(kind == 6, F.substring(name, 1, 2))
        .otherwise(F.concat((number % 50).cast("string"), F.lit("%"), F.substring(name, 2, 4)))
        .alias("query"),
    )


@query
def identifier_cascade(spark, d):
    return cascade.identifier_cascade(
        _query_texts(spark, d), bridge.orbits(spark, d), bridge.risks(spark, d), bridge.approaches(spark, d)
    )


@query
def cascade_outcomes(spark, d):
    """Queries nobody here can answer: known to the outside catalogue only, or pending."""
    found = cascade.identifier_cascade(
        _query_texts(spark, d), bridge.orbits(spark, d), bridge.risks(spark, d), bridge.approaches(spark, d)
    )
    number, full = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    outside = bridge.table(spark, d, "customer").select(
        F.concat(F.lit("X"), number.cast("string")).alias("designation"),
        F.when(full, F.concat(F.lit("No Such OBJECT "), number.cast("string"))).otherwise(F.lit("")).alias("fullname"),
        F.col("c_name").alias("shortname"),
        F.when(number % 3 == 0, F.concat(F.lit("no such object "), (number + 1).cast("string"))).alias("spkid"),
    )
    return cascade.with_outcome(found, outside).select(
        "query_id", "level", "outcome", "catalogue_designation", "catalogue_name"
    )


@query
def wildcard_names(spark, d):
    """Queries of wildcards, with few letters, none, or escaped ones: the first object each means."""
    number, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    kind = number % 8
    asked = bridge.table(spark, d, "part").select(
        F.when(kind == 0, F.repeat(F.lit("_"), size + 10))
        .when(kind == 1, F.concat(F.lit("%"), F.repeat(F.lit("_%"), size)))
        .when(kind == 2, F.lit("%%"))
        .when(kind == 3, F.concat(F.lit("\\%"), F.repeat(F.lit("_"), size % 3)))
        .when(kind == 4, F.lit("A\\_"))
        .when(kind == 5, F.concat(F.substring(name, 1, 3), F.lit("_"), F.substring(name, 5, 2)))
        .when(kind == 6, F.concat(F.lit("100\\%"), F.repeat(F.lit("%"), size % 2)))
        .otherwise(F.concat(F.substring(name, 1, 4), F.lit("\\\\")))
        .alias("query")
    )
    number = F.col("asteroid_id").cast("bigint")
    tail = F.when(number % 5 == 0, F.lit(" 100%")).when(number % 7 == 0, F.lit(" a_b")).otherwise(F.lit(""))
    labels = _objects(spark, d).select("asteroid_id", F.concat("name", tail).alias("label"))
    return matching.first_containing(labels, asked, "label", "query", ("asteroid_id",))


@query
def object_search(spark, d):
    return tidy(search.object_search(bridge.approaches(spark, d), bridge.orbits(spark, d), "BOLT (199"))


@query
def object_search_catalogue(spark, d):
    return tidy(search.object_search(bridge.approaches(spark, d), bridge.orbits(spark, d), "20000013"))


# --- changes ------------------------------------------------------------------------------------------

HASHED = ["close_approach_date", "asteroid_id", "orbiting_body", "epoch_date_close_approach"]


def _kept(spark, d):
    """One row per key, stored: the table and the batch both start from it."""
    return materialise(keyed.dedupe_approaches(bridge.approaches(spark, d)).select(*HASHED, "src_line"))


def _stored(kept):
    return kept.withColumn("row_hash", row_hash(HASHED))


def _incoming(kept):
    """The stored rows again: some under a new id, some with another body."""
    moved = kept.withColumns(
        {
            "asteroid_id": F.when(F.col("src_line") == 1, F.concat(F.lit("N"), "asteroid_id")).otherwise(F.col("asteroid_id")),
            "orbiting_body": F.when(F.col("src_line") == 2, "Moon").otherwise(F.col("orbiting_body")),
        }
    )
    return moved.withColumn("row_hash", row_hash(HASHED))


@query
def change_detection(spark, d):
    kept = _kept(spark, d)
    found = changes.detect_changes(_incoming(kept), _stored(kept), APPROACH.keys)
    return found.select("close_approach_date", "asteroid_id", "orbiting_body", "change_type")


@query
def upsert_current(spark, d):
    kept = _kept(spark, d)
    stored = _stored(kept)
    found = changes.detect_changes(_incoming(kept), stored, APPROACH.keys).drop("change_type")
    table = changes.upsert(stored, materialise(found), APPROACH.keys)
    return table.select("close_approach_date", "asteroid_id", "orbiting_body")


# --- ledgers and work lists -------------------------------------------------------------------------------

@query
def classified_fetches(spark, d):
    return classify_fetches(bridge.fetches(spark, d)).select(
        "event_id", "asteroid_id", "source", "status_code", "last_failure_type", "not_found_until"
    )


@query
def fetch_status_counts(spark, d):
    return worklist.status_breakdown(_fetch_statuses(spark, d))


@query
def active_holds(spark, d):
    return resolve.active_holds(_fetch_statuses(spark, d), HOLDS_AS_OF)


@query
def work_without_held(spark, d):
    work = bridge.fetches(spark, d).select("asteroid_id", "source").distinct()
    return resolve.without_held(work, resolve.active_holds(_fetch_statuses(spark, d), HOLDS_AS_OF))


@query
def never_profiled(spark, d):
    return worklist.never_profiled(bridge.approaches(spark, d), bridge.orbits(spark, d))


@query
def refresh_worklist(spark, d):
    work = worklist.refresh_worklist(
        bridge.approaches(spark, d), bridge.orbits(spark, d), WORK_AS_OF, WORK_LIMIT, seen="ingestion_date"
    )
    return work.select("asteroid_id", "name", "priority", "last_seen")


def _bounds(spark, d):
    return bridge.window_ledger(spark, d).agg(
        F.min("window_start").alias("start_date"), F.max("window_start").alias("end_date")
    )


@query
def window_calendar(spark, d):
    return windows.windows_between(_bounds(spark, d))


@query
def delta_windows(spark, d):
    last = F.to_date(F.max("o_orderdate"))
    bounds = bridge.table(spark, d, "orders").agg(
        F.date_sub(last, windows.DELTA_BACK).alias("start_date"), F.date_add(last, windows.DELTA_AHEAD).alias("end_date")
    )
    return windows.windows_between(bounds)


def _window_holds(spark, d):
    ledger = bridge.window_ledger(spark, d)
    days = (F.col("any_key") % 2000).cast("int")
    return ledger.select("window_start", "window_end", F.date_add("window_start", days).cast("timestamp").alias("not_found_until"))


@query
def planned_windows(spark, d):
    return windows.plan_windows(
        windows.windows_between(_bounds(spark, d)), bridge.window_ledger(spark, d), _window_holds(spark, d), WINDOWS_AS_OF
    ).select("window_start", "window_end", "status", "attempt")


@query
def pending_windows(spark, d):
    return windows.pending_windows(
        windows.windows_between(_bounds(spark, d)), bridge.window_ledger(spark, d), _window_holds(spark, d), WINDOWS_AS_OF
    )


@query
def retryable_windows(spark, d):
    return windows.start_retry(bridge.window_ledger(spark, d)).select("window_start", "status", "attempt")


def _outcomes(spark, d):
    pick = F.col("any_key") % 5
    return bridge.window_ledger(spark, d).select(
        "window_start", "window_end", "records",
        F.when(pick < 2, windows.FETCHED).when(pick == 2, windows.NOT_FOUND).when(pick == 3, windows.RETRY)
        .otherwise(windows.ERROR).alias("outcome"),
        F.when(pick == 4, F.lit("broken pipe")).alias("error"),
    )


@query
def window_outcomes(spark, d):
    rows, _ = windows.apply_outcomes(bridge.window_ledger(spark, d), _outcomes(spark, d), WINDOWS_AS_OF)
    return rows


@query
def window_holds(spark, d):
    _, holds = windows.apply_outcomes(bridge.window_ledger(spark, d), _outcomes(spark, d), WINDOWS_AS_OF)
    return holds.select("window_start", "window_end", "last_status_code", F.to_date("not_found_until").alias("until"))


@query
def run_stats(spark, d):
    return windows.run_statistics(bridge.window_ledger(spark, d))


@query
def latest_run_id(spark, d):
    runs = bridge.table(spark, d, "orders").select(
        F.concat(F.when(F.col("o_orderstatus") == "F", F.lit("run_")).otherwise(F.lit("delta_")),
                 F.date_format("o_orderdate", "yyyyMMdd")).alias("run_id")
    )
    return windows.latest_run(runs)


# --- envelopes and streams ------------------------------------------------------------------------------------

def _envelopes(spark, d):
    active, removed, named, listed = _catalogues(spark, d)
    found = resolve.resolve_profiles(
        _objects(spark, d), bridge.orbits(spark, d), active, removed, named, listed,
        resolve.active_holds(_fetch_statuses(spark, d), HOLDS_AS_OF),
    )
    keyed_active = active.withColumn("key", text.normalise_designation(F.col("designation")))
    per_object = envelopes.build_envelopes(
        materialise(found), bridge.orbits(spark, d), keyed_active, named, listed, WORK_AS_OF
    )
    return per_object.unionByName(envelopes.fireball_envelopes(bridge.fireballs(spark, d), WORK_AS_OF))


def _route(spark, d):
    # Written once and read by each table, as a topic would be.
    folder = f"{run_folder(spark)}/messages"
    publish(envelopes.to_messages(_envelopes(spark, d)), "text", path=folder)
    raw = spark.read.text(folder)
    good, _ = feed.split_malformed(feed.parse_messages(raw, agencies.ENVELOPE_SCHEMA), "asteroid_id")
    # Parsed once, read by five tables.
    return agencies.route_envelope(materialise(good.select("d.*")))


@query
def envelope_route_counts(spark, d):
    """Profiles resolved, put into envelopes, sent as JSON and routed to their tables."""
    return metrics.table_counts(_route(spark, d))


@query
def envelope_risk_rows(spark, d):
    return _route(spark, d)["sentry"].groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("designation").alias("n_designations")
    )


def _streamed(spark, d, batches: int | None = None, fresh: bool = False) -> KeyedTable:
    """Two rounds of messages through the approach stream, the second one after
    a restart from the checkpoint.

    With `batches` each round comes in so many, and the log is folded on the
    way.  With `fresh` the second round has a topic and a checkpoint of its own.
    """
    folder = run_folder(spark)
    table = KeyedTable(spark, f"{folder}/close_approaches", APPROACH).create()
    # Both rounds start from the same table.
    kept = materialise(keyed.dedupe_approaches(bridge.approaches(spark, d, heavy=True)))
    again = kept.withColumns(
        {
            "asteroid_id": F.when(F.col("src_line") == 1, F.concat(F.lit("N"), "asteroid_id")).otherwise(F.col("asteroid_id")),
            "orbiting_body": F.when(F.col("src_line") == 2, "Moon").otherwise(F.col("orbiting_body")),
        }
    )
    for number, rows in enumerate((kept, again)):
        topic = number if fresh else 0
        # A batch has as many files as a poll may take, or one task would write and read all of it.  Rows are dealt
        # out before they are messages, which are several times as long.
        dealt = rows.repartition(batches * feed.FILES_PER_TRIGGER) if batches else rows
        publish(to_keyed_json(feed.to_messages(dealt), approach_key()), "text", path=f"{folder}/messages-{topic}")
        messages = feed.read_message_stream(spark, "text", path=f"{folder}/messages-{topic}")
        stream = approach_stream.start(
            messages, table, f"{folder}/checkpoint-{topic}", quarantine=f"{folder}/quarantine", once=True,
            fold_every=3 if batches else approach_stream.FOLD_EVERY,
        )
        stream.awaitTermination()
    return table


def _stream_rows(table: KeyedTable):
    return tidy(
        table.current().select(
            "close_approach_date", "asteroid_id", "name", "orbiting_body", "epoch_date_close_approach",
            F.col("miss_distance_km").cast("double").alias("miss_distance_km"),
        ),
        4,
    )


@query
def stream_upsert(spark, d):
    """The approach table after both rounds."""
    return _stream_rows(_streamed(spark, d))


@query
def stream_small_batches(spark, d):
    """The same rows in eight batches, with folds between them."""
    return _stream_rows(_streamed(spark, d, batches=4))


@query
def stream_new_checkpoint(spark, d):
    """The same rows, the second round by a stream with a new checkpoint."""
    return _stream_rows(_streamed(spark, d, fresh=True))


@query
def stream_history(spark, d):
    """What the rounds wrote, by kind of change and body."""
    history = _streamed(spark, d).history()
    return history.groupBy("change_type", "orbiting_body").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("asteroid_id").alias("n_objects")
    )


@query
def stream_agencies(spark, d):
    """Envelopes through the agency stream: rows of each table."""
    folder = run_folder(spark)
    held = agency_stream.create_tables(spark, f"{folder}/tables")
    publish(envelopes.to_messages(_envelopes(spark, d)), "text", path=f"{folder}/messages")
    messages = agency_stream.read(spark, "text", path=f"{folder}/messages")
    agency_stream.start(messages, held, f"{folder}/checkpoint", once=True).awaitTermination()
    return metrics.table_counts({name: table.current() for name, table in held.items()})


@query
def ingest_measured(spark, d):
    """A run of the agency stream by its own log: rows written per table, and whether the tables hold as many."""
    folder = run_folder(spark)
    held = agency_stream.create_tables(spark, f"{folder}/tables")
    log = IngestLog(spark, f"{folder}/log").create()
    publish(envelopes.to_messages(_envelopes(spark, d)), "text", path=f"{folder}/messages")
    messages = agency_stream.read(spark, "text", path=f"{folder}/messages")
    agency_stream.start(messages, held, f"{folder}/checkpoint", once=True, rejects=f"{folder}/rejects", log=log).awaitTermination()
    stored = progress.rows_per_source({name: table.history() for name, table in held.items()})
    stored = stored.groupBy("source").agg(F.sum("n_rows").alias("n_stored"))
    return log.totals().join(stored, "source").select(
        "source", "n_inserted", (F.col("n_inserted") + F.col("n_updated") == F.col("n_stored")).alias("agrees"),
        (F.col("throughput") > 0).alias("timed"), "n_rejected",
    )


@query
def ingest_metrics(spark, d):
    """Backlog and throughput with the hours of the event table as batches."""
    hours = bridge.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.round(F.sum("value"), 2).alias("seconds"), F.min("event_id").alias("batch_id")
    )
    batches = hours.select("batch_id", "n_messages", "seconds", (F.lit(1000000) - F.col("batch_id")).alias("lag"))
    return tidy(progress.ingest_metrics(batches), 4)


# --- stored tables ------------------------------------------------------------------------------------------------

@query
def stored_scan(spark, d):
    """The approach table written in yearly folders and read back between two dates."""
    path = f"{run_folder(spark)}/close_approaches"
    write_chunked(APPROACH.conform(keyed.dedupe_approaches(bridge.approaches(spark, d, heavy=True))), path, "close_approach_date")
    stored = tables.read_table(spark, path, APPROACH, DATE_MIN, DATE_MAX)
    return tidy(
        stored.select(
            "close_approach_date", "asteroid_id", "name", F.col("miss_distance_km").cast("double").alias("miss_distance_km")
        ),
        4,
    )


@query
def status_ledger(spark, d):
    """The fetch-status ledger after the responses of two half months."""
    ledger = KeyedTable(spark, f"{run_folder(spark)}/fetch_status", FETCH_STATUS).create()
    responses = bridge.fetches(spark, d)
    first = F.col("checked_at") < F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    for number, part in enumerate((responses.filter(first), responses.filter(~first))):
        last = keyed.dedupe_last(part, FETCH_STATUS.keys, ["checked_at", "event_id"])
        ledger.apply(FETCH_STATUS.conform(classify_fetches(last)), number)
    return ledger.current().select("asteroid_id", "source", "status_code", "last_failure_type")


@query
def window_ledger_table(spark, d):
    """The window ledger as planned and after its outcomes."""
    table = KeyedTable(spark, f"{run_folder(spark)}/window_ledger", WINDOW_LEDGER).create()
    known = bridge.window_ledger(spark, d)
    table.apply(WINDOW_LEDGER.conform(known), 0)
    rows, _ = windows.apply_outcomes(table.current(), _outcomes(spark, d), WINDOWS_AS_OF)
    table.apply(rows, 1)
    return table.current().groupBy("status", "attempt").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("records").alias("n_records")
    )


@query
def stale_objects(spark, d):
    return worklist.stale_objects(bridge.orbits(spark, d), WORK_AS_OF, "ingestion_date")


@query
def distinct_objects(spark, d):
    return bridge.approaches(spark, d).select("asteroid_id").distinct()


@query
def sql_views(spark, d):
    """Tables and views under names, queried in SQL."""
    fireballs = bridge.fireballs(spark, d)
    views.register(
        {
            "close_approaches": bridge.approaches(spark, d),
            "agency_sbdb": ORBIT.conform(bridge.orbits(spark, d)),
            "agency_sentry": RISK.conform(bridge.risks(spark, d)),
            "agency_esa": RISK_LIST.conform(bridge.risk_list(spark, d)),
            "agency_cad": PASSAGE.conform(bridge.passages(spark, d)),
            "fireball_events": fireballs,
        },
        "np_",
    )
    return spark.sql(
        """
        SELECT 'days' AS what, COUNT(*) AS n, SUM(anomaly_count) AS total FROM np_daily_metrics
        UNION ALL SELECT 'profiles', COUNT(*), COUNT(esa_on_risk_list) FROM np_asteroid_profile
        UNION ALL SELECT 'watched', COUNT(*), COUNT(palermo_scale_cum) FROM np_sentry_watchlist
        UNION ALL SELECT 'passages', COUNT(*), COUNT_IF(on_sentry_watchlist) FROM np_cad_upcoming
        UNION ALL SELECT 'classes', COUNT(*), SUM(pha_count) FROM np_orbit_class_dist
        UNION ALL SELECT 'years', COUNT(*), SUM(event_count) FROM np_fireball_annual
        """
    )
