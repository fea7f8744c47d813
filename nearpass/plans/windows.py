"""Backfill calendar and its ledger."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.schemas import WINDOW_HOLD, WINDOW_LEDGER

# --- fixed values: calendar and retry rules -----------------------------------------
WINDOW_DAYS = 7
HOLD_DAYS = 30
MAX_ATTEMPTS = 3
DELTA_BACK, DELTA_AHEAD = 1, 14
PENDING, SUCCESS, FAILED, SKIPPED = "PENDING", "SUCCESS", "FAILED", "SKIPPED"
RUN_PREFIX = "run_"

# fixed values: outcomes of a fetch
FETCHED, NOT_FOUND, RETRY, ERROR = "FETCHED", "NOT_FOUND", "RETRY", "ERROR"

# fixed values: notes in the ledger
HELD_NOTE = "a recent 404 puts the window on hold"
HOLD_NOTE = "404; retry held until "
FAILED_NOTE, FAILED_AGAIN_NOTE = "Fetch or Send Failed", "Failed on retry attempt"
LIMITED_NOTE = "Rate limited on retry"
# --- end of fixed values --------------------------------------------------------------


def windows_between(bounds: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """Calendar of a one-row table (start_date, end_date): windows of `days`
    days, both ends included, the last one clipped."""
    starts = F.sequence("start_date", "end_date", F.make_dt_interval(F.lit(days)))
    return bounds.filter(F.col("start_date") <= F.col("end_date")).select(
        F.explode(starts).alias("window_start"), "end_date"
    ).select("window_start", F.least(F.date_add("window_start", days - 1), "end_date").alias("window_end"))


def window_calendar(spark: SparkSession, start: date, end: date, days: int = WINDOW_DAYS) -> DataFrame:
    bounds = spark.range(1).select(F.lit(start).alias("start_date"), F.lit(end).alias("end_date"))
    return windows_between(bounds, days)


def delta_calendar(spark: SparkSession, today: date) -> DataFrame:
    """Windows from yesterday to two weeks ahead."""
    return window_calendar(spark, today - timedelta(days=DELTA_BACK), today + timedelta(days=DELTA_AHEAD))


def _now(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def held_windows(holds: DataFrame, as_of: datetime | Column) -> DataFrame:
    return holds.filter(F.col("not_found_until") > _now(as_of)).select("window_start", "window_end")


def plan_windows(calendar: DataFrame, ledger: DataFrame, holds: DataFrame, as_of: datetime | Column) -> DataFrame:
    """The calendar without finished windows; a window on hold is SKIPPED with
    its reason, every other one PENDING.

    Start and end identify a window, so a last window that was clipped in an
    earlier run comes up again once it is longer.
    """
    key = ["window_start", "window_end"]
    finished = ledger.filter(F.col("status") == SUCCESS).select(*key)
    held = held_windows(holds, as_of).distinct().withColumn("held", F.lit(True))
    on_hold = F.coalesce("held", F.lit(False))
    earlier = ledger.select(*key, F.col("attempt").alias("old_attempt"))
    return (
        calendar.join(finished, key, "left_anti")
        .join(held, key, "left")
        .join(earlier, key, "left")
        .select(
            *key,
            F.when(on_hold, SKIPPED).otherwise(PENDING).alias("status"),
            F.lit(0).cast("bigint").alias("records"),
            F.lit(None).cast("string").alias("error"),
            F.when(on_hold, HELD_NOTE).alias("reason"),
            # A skipped window keeps its count, a registered one starts anew.
            F.when(on_hold, F.coalesce("old_attempt", F.lit(1))).otherwise(F.lit(1)).cast("int").alias("attempt"),
        )
    )


def pending_windows(calendar: DataFrame, ledger: DataFrame, holds: DataFrame, as_of: datetime | Column) -> DataFrame:
    planned = plan_windows(calendar, ledger, holds, as_of)
    return planned.filter(F.col("status") == PENDING).select("window_start", "window_end")


def retryable(ledger: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed windows with attempts left."""
    return ledger.filter((F.col("status") == FAILED) & (F.coalesce("attempt", F.lit(1)) < max_attempts))


def start_retry(ledger: DataFrame) -> DataFrame:
    """Retryable windows as they enter the next attempt."""
    return retryable(ledger).withColumns({"attempt": F.coalesce("attempt", F.lit(1)) + 1, "status": F.lit(PENDING)})


def apply_outcomes(
    ledger: DataFrame, outcomes: DataFrame, as_of: datetime | Column, hold_days: int = HOLD_DAYS
) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, hold rows) after fetches: `outcomes` has the window, the
    `outcome` and, when fetched, the number of `records`.

    A rate-limited window stays PENDING on its first attempt and fails on a
    later one; a window not found is skipped and held.
    """
    key = list(WINDOW_LEDGER.keys)
    hold_until = _now(as_of) + F.make_dt_interval(F.lit(hold_days))
    done = outcomes.select(*key, "outcome", F.col("records").alias("fetched"), F.col("error").alias("message"))
    known = ledger.select(*key, F.coalesce("attempt", F.lit(1)).alias("attempt"))
    joined = done.join(known, key, "left").withColumn("attempt", F.coalesce("attempt", F.lit(1)))
    outcome, again = F.col("outcome"), F.col("attempt") > 1
    status = (
        F.when(outcome == FETCHED, SUCCESS)
        .when(outcome == NOT_FOUND, SKIPPED)
        .when((outcome == RETRY) & ~again, PENDING)
        .otherwise(FAILED)
    )
    default_error = (
        F.when(outcome == RETRY, LIMITED_NOTE).when(again, FAILED_AGAIN_NOTE).otherwise(FAILED_NOTE)
    )
    rows = joined.select(
        *key,
        status.alias("status"),
        F.when(outcome == FETCHED, F.coalesce("fetched", F.lit(0))).otherwise(0).cast("bigint").alias("records"),
        F.when(status == FAILED, F.coalesce("message", default_error)).alias("error"),
        F.when(status == SKIPPED, F.concat(F.lit(HOLD_NOTE), F.to_date(hold_until).cast("string"))).alias("reason"),
        F.col("attempt").cast("int").alias("attempt"),
    )
    return rows, mark_not_found(outcomes.filter(F.col("outcome") == NOT_FOUND), as_of, hold_days)


def mark_not_found(windows: DataFrame, as_of: datetime | Column, hold_days: int = HOLD_DAYS) -> DataFrame:
    """Hold rows for windows that had nothing."""
    return WINDOW_HOLD.conform(
        windows.select(
            *WINDOW_HOLD.keys,
            F.lit(404).alias("last_status_code"),
            _now(as_of).alias("last_checked_at"),
            (_now(as_of) + F.make_dt_interval(F.lit(hold_days))).alias("not_found_until"),
        )
    )


def run_statistics(ledger: DataFrame) -> DataFrame:
    """Totals of a run: windows by status, records sent, range, retries."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return ledger.agg(
        F.count(F.lit(1)).alias("total_windows"),
        n(SUCCESS).alias("successful_windows"),
        n(FAILED).alias("failed_windows"),
        n(SKIPPED).alias("skipped_windows"),
        n(PENDING).alias("pending_windows"),
        F.coalesce(F.sum(F.when(F.col("status") == SUCCESS, F.col("records"))), F.lit(0)).cast("bigint").alias("total_records_sent"),
        F.min("window_start").alias("start_date"),
        F.max_by("window_end", "window_start").alias("end_date"),
        F.count_if(F.col("attempt") > 1).alias("retried_windows"),
    )


def latest_run(runs: DataFrame, column: str = "run_id", prefix: str = RUN_PREFIX) -> DataFrame:
    """The newest run by name; the names carry the time they started."""
    return runs.filter(F.startswith(F.col(column), F.lit(prefix))).agg(F.max(column).alias(column))
