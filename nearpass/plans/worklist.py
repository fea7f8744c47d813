"""Which objects to refresh next."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpass.operators.resolve import object_names

# --- fixed values: refresh rule -----------------------------------------------------
STALE_AFTER = timedelta(days=7)
BATCH_LIMIT = 2000
# --- end of fixed values --------------------------------------------------------------


def last_seen(orbits: DataFrame, seen: str = "ingestion_time", checks: DataFrame | None = None) -> DataFrame:
    """When each object's orbit was last written or, by the fetch ledger in
    `checks`, last looked at."""
    known = orbits.select("asteroid_id", F.col(seen).alias("last_seen"))
    if checks is None:
        return known
    looked = checks.groupBy("asteroid_id").agg(F.max("last_checked_at").alias("looked_at"))
    return known.join(looked, "asteroid_id", "left").select(
        "asteroid_id", F.greatest("last_seen", "looked_at").alias("last_seen")
    )


def _is_stale(as_of: datetime | Column) -> Column:
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.col("last_seen") < now - F.lit(STALE_AFTER)


def stale_objects(
    orbits: DataFrame, as_of: datetime | Column, seen: str = "ingestion_time", checks: DataFrame | None = None
) -> DataFrame:
    """Objects last seen more than seven days before `as_of`."""
    return last_seen(orbits, seen, checks).filter(_is_stale(as_of))


def never_profiled(approaches: DataFrame, orbits: DataFrame) -> DataFrame:
    """Objects with approaches and without an orbit."""
    return approaches.select("asteroid_id").distinct().join(orbits.select("asteroid_id"), "asteroid_id", "left_anti")


def refresh_worklist(
    approaches: DataFrame,
    orbits: DataFrame,
    as_of: datetime | Column,
    limit: int = BATCH_LIMIT,
    seen: str = "ingestion_time",
    checks: DataFrame | None = None,
) -> DataFrame:
    """Stale objects, oldest first, then objects never profiled, up to one
    shared limit, each with the name of its latest approach.

    One aggregate of the approaches gives both the objects and their names; a
    full join with the orbits tells the two kinds of work apart.
    """
    known = last_seen(orbits, seen, checks).withColumn("has_orbit", F.lit(True))
    everything = object_names(approaches).join(known, "asteroid_id", "full")
    priority = F.when(F.col("has_orbit").isNull(), 1).when(_is_stale(as_of), 0)
    return (
        everything.select("asteroid_id", "name", priority.alias("priority"), "last_seen")
        .filter(F.col("priority").isNotNull())
        .orderBy("priority", F.col("last_seen").asc_nulls_last(), "asteroid_id")
        .limit(limit)
    )


def status_breakdown(statuses: DataFrame) -> DataFrame:
    """Ledger rows per source and status code."""
    return (
        statuses.groupBy("source", "status_code")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("source", F.col("status_code").asc_nulls_last())
    )
