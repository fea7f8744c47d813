"""The approach feed: documents, messages and their flat rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.schemas import APPROACH, Entity
from nearpass.session import spread

# --- fixed values: message layout ----------------------------------------------
_RANGE = "STRUCT<estimated_diameter_min: DOUBLE, estimated_diameter_max: DOUBLE>"
ASTEROID_TYPE = (
    "STRUCT<id: STRING, neo_reference_id: STRING, name: STRING, absolute_magnitude_h: DOUBLE,"
    " is_potentially_hazardous_asteroid: BOOLEAN, is_sentry_object: BOOLEAN, nasa_jpl_url: STRING,"
    f" estimated_diameter: STRUCT<kilometers: {_RANGE}, meters: {_RANGE}, miles: {_RANGE}, feet: {_RANGE}>,"
    " close_approach_data: ARRAY<STRUCT<close_approach_date_full: STRING, epoch_date_close_approach: DOUBLE,"
    " orbiting_body: STRING,"
    " relative_velocity: STRUCT<kilometers_per_second: STRING, kilometers_per_hour: STRING, miles_per_hour: STRING>,"
    " miss_distance: STRUCT<astronomical: STRING, lunar: STRING, kilometers: STRING, miles: STRING>>>>"
)
MESSAGE_SCHEMA = f"date STRING, asteroid {ASTEROID_TYPE}"
FEED_SCHEMA = f"element_count INT, near_earth_objects MAP<STRING, ARRAY<{ASTEROID_TYPE}>>"

# fixed values: unit names in messages and in columns
DIAMETER_UNITS = {"km": "kilometers", "m": "meters", "miles": "miles", "feet": "feet"}
VELOCITY_UNITS = {"km_s": "kilometers_per_second", "km_h": "kilometers_per_hour", "mph": "miles_per_hour"}
DISTANCE_UNITS = {"astronomical": "astronomical", "lunar": "lunar", "km": "kilometers", "miles": "miles"}

# fixed values: stream limits
OFFSETS_PER_TRIGGER = 1000
FILES_PER_TRIGGER = 16
# --- end of fixed values ----------------------------------------------------------

CORRUPT = "_corrupt_record"
# The columns of a message stream that order its arrival.
ARRIVAL = ("timestamp", "partition", "offset")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed documents, one per file, to messages: one row per (date, object)."""
    return feed_to_messages(spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(path))


def feed_to_messages(feeds: DataFrame) -> DataFrame:
    """One message per object and day; those of a large document are dealt out before anything is made of them."""
    by_day = feeds.select(F.explode("near_earth_objects").alias("date", "objects"))
    return spread(by_day.select("date", F.explode("objects").alias("asteroid")))


def read_message_stream(
    spark: SparkSession, fmt: str, per_trigger: int | None = None, max_bytes: int | None = None, **options: str
) -> DataFrame:
    """A stream of raw messages: a text column `value` and, last, the columns
    that order its arrival.

    `fmt` is "kafka", from the earliest offset and tolerant of lost offsets, or
    "text" for a folder of line-delimited JSON given as `path`, or "json" for one
    of lines that hold key and value.  A batch is
    bounded by `per_trigger` messages or, of a folder, files; or, of a folder, by
    `max_bytes` instead (a larger file is a batch of its own).

    All messages of a file arrived together: where in it a line stands, and how
    Spark splits it, decides nothing.
    """
    if fmt == "kafka":
        defaults = {
            "startingOffsets": "earliest",
            "failOnDataLoss": "false",
            "maxOffsetsPerTrigger": str(per_trigger or OFFSETS_PER_TRIGGER),
        }
        raw = spark.readStream.format("kafka").options(**{**defaults, **options}).load()
        return raw.select(F.col("value").cast("string").alias("value"), "timestamp", "partition", "offset")
    path = options.pop("path")
    bound = ("maxBytesPerTrigger", max_bytes) if max_bytes else ("maxFilesPerTrigger", per_trigger or FILES_PER_TRIGGER)
    reader = spark.readStream.format("json" if fmt == "json" else "text").option(bound[0], str(bound[1])).options(**options)
    raw = (reader.schema("key STRING, value STRING") if fmt == "json" else reader).load(path)
    return raw.select(
        "value",
        F.col("_metadata.file_modification_time").alias("timestamp"),
        F.col("_metadata.file_name").alias("partition"),
        F.lit(0).cast("bigint").alias("offset"),
    )


def parse_messages(raw: DataFrame, schema: str = MESSAGE_SCHEMA, value: str = "value") -> DataFrame:
    """Add the parsed struct `d`; its `_corrupt_record` holds the text itself
    where that is not valid JSON of the given layout.

    The struct comes out of an explode of one element: filters and projections
    on its fields stay above that step, so a message is parsed once and not
    once per use.
    """
    with_corrupt = f"{schema}, {CORRUPT} STRING"
    parsed = F.from_json(
        F.col(value).cast("string"), with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return raw.select("*", F.explode_outer(F.array(parsed)).alias("d"))


def with_verdict(parsed: DataFrame, required: str) -> DataFrame:
    """Add `verdict`: why a message cannot be used, NULL for a good one."""
    broken, part = F.col(f"d.{CORRUPT}").isNotNull(), F.col(f"d.{required}")
    reason = F.when(broken, F.lit("malformed")).when(part.isNull(), F.lit(f"no {required}"))
    return parsed.withColumn("verdict", reason)


def split_malformed(parsed: DataFrame, required: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine): a message that does not parse, or without its
    `required` part, keeps its text and the reason."""
    judged = with_verdict(parsed, required)
    return judged.filter(F.col("verdict").isNull()).drop("verdict"), quarantined(judged, value)


def without_texts(judged: DataFrame, value: str = "value") -> DataFrame:
    """Judged messages that keep their text only where `quarantined` asks for it: a good one has all of it in `d`."""
    return judged.withColumn(value, F.when(F.col("verdict").isNotNull(), F.col(value)))


def quarantined(judged: DataFrame, value: str = "value") -> DataFrame:
    """The text of messages with a verdict, and the reason."""
    bad = judged.filter(F.col("verdict").isNotNull())
    return bad.select(F.col(value).cast("string").alias("value"), F.col("verdict").alias("reason"))


def flatten_messages(messages: DataFrame, keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """Messages (`date`, `asteroid`) to one row per element of
    `close_approach_data`, with the columns of the approach table; with `outer`
    a message without any gives one row too.

    Numbers stay as sent; `Entity.conform` types them.
    """
    passes = (F.explode_outer if outer else F.explode)("asteroid.close_approach_data")
    rows = messages.select(*keep, "date", "asteroid", passes.alias("pass"))

    def sized(unit: str, part: str) -> Column:
        return F.col(f"asteroid.estimated_diameter.{unit}.estimated_diameter_{part}")

    return rows.select(
        *keep,
        F.col("date").alias("close_approach_date"),
        F.col("asteroid.id").alias("asteroid_id"),
        "asteroid.neo_reference_id",
        "asteroid.name",
        "asteroid.absolute_magnitude_h",
        *[
            sized(unit, part).alias(f"estimated_diameter_{short}_{part}")
            for short, unit in DIAMETER_UNITS.items()
            for part in ("min", "max")
        ],
        F.col("asteroid.is_potentially_hazardous_asteroid").alias("is_potentially_hazardous"),
        "asteroid.is_sentry_object",
        "pass.close_approach_date_full",
        "pass.epoch_date_close_approach",
        "pass.orbiting_body",
        *[
            F.col(f"pass.relative_velocity.{unit}").alias(f"relative_velocity_{short}")
            for short, unit in VELOCITY_UNITS.items()
        ],
        *[
            F.col(f"pass.miss_distance.{unit}").alias(f"miss_distance_{short}")
            for short, unit in DISTANCE_UNITS.items()
        ],
        "asteroid.nasa_jpl_url",
    )


def drop_incomplete(df: DataFrame, keys: tuple[str, ...] = APPROACH.keys) -> DataFrame:
    """Drop rows that lack a part of the key."""
    return df.na.drop(subset=list(keys))


def with_faults(rows: DataFrame, entity: Entity) -> DataFrame:
    """Rows as sent plus `faults`: why each part of the key cannot be used, NULL
    for a row that can be stored.

    A part is "missing" where nothing was sent, and "unreadable" where what was
    sent is not of the part's type.  A part with a default is never at fault.
    """
    def fault(name: str) -> Column:
        sent = F.col(f"`{name}`") if name in rows.columns else F.lit(None).cast("string")
        reason = F.when(sent.isNull(), F.lit("missing")).when(
            sent.try_cast(entity.columns[name]).isNull(), F.lit("unreadable")
        )
        return F.struct(F.lit(name).alias("column"), reason.alias("reason"))

    keys = [name for name in entity.keys if name not in entity.defaults]
    found = F.filter(F.array(*[fault(name) for name in keys]), lambda f: f["reason"].isNotNull())
    # The map is made for rows at fault only.
    unusable = [F.col(f"`{name}`").try_cast(entity.columns[name]).isNull() if name in rows.columns else F.lit(True) for name in keys]
    at_fault = reduce(or_, unusable, F.lit(False))
    return rows.withColumn("faults", F.when(at_fault, F.map_from_entries(found)))


def rejected_rows(checked: DataFrame, entity: Entity) -> DataFrame:
    """Rows that cannot be stored: the entity, what was sent as JSON, and the reason for each part of the key."""
    bad = checked.filter(F.col("faults").isNotNull())
    sent = [F.col(f"`{name}`") for name in entity.columns if name in checked.columns]
    return bad.select(F.lit(entity.name).alias("entity"), F.to_json(F.struct(*sent)).alias("row"), "faults")


def to_messages(approaches: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat approach rows back to messages, one per row, with the columns in
    `keep` in front: the publishing side."""
    def column(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in approaches.columns else F.lit(None).cast(kind)

    ranges = [
        F.struct(
            column(f"estimated_diameter_{short}_min", "double").alias("estimated_diameter_min"),
            column(f"estimated_diameter_{short}_max", "double").alias("estimated_diameter_max"),
        ).alias(unit)
        for short, unit in DIAMETER_UNITS.items()
    ]
    one_pass = F.struct(
        column("close_approach_date_full", "string").alias("close_approach_date_full"),
        column("epoch_date_close_approach", "double").alias("epoch_date_close_approach"),
        column("orbiting_body", "string").alias("orbiting_body"),
        F.struct(
            *[column(f"relative_velocity_{s}", "string").alias(u) for s, u in VELOCITY_UNITS.items()]
        ).alias("relative_velocity"),
        F.struct(
            *[column(f"miss_distance_{s}", "string").alias(u) for s, u in DISTANCE_UNITS.items()]
        ).alias("miss_distance"),
    )
    asteroid = F.struct(
        column("asteroid_id", "string").alias("id"),
        column("neo_reference_id", "string").alias("neo_reference_id"),
        column("name", "string").alias("name"),
        column("absolute_magnitude_h", "double").alias("absolute_magnitude_h"),
        column("is_potentially_hazardous", "boolean").alias("is_potentially_hazardous_asteroid"),
        column("is_sentry_object", "boolean").alias("is_sentry_object"),
        column("nasa_jpl_url", "string").alias("nasa_jpl_url"),
        F.struct(*ranges).alias("estimated_diameter"),
        F.array(one_pass).alias("close_approach_data"),
    )
    return approaches.select(*keep, column("close_approach_date", "string").alias("date"), asteroid.alias("asteroid"))
