"""Numbers and flags from text that may hold anything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearpass.functions.text import strip

# --- fixed values: what counts as a number ------------------------------------
DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_TEXT = r"^[+-]?\d+$"
TRUE_TEXT = ("Y", "true", "1")
# --- end of fixed values --------------------------------------------------------


def safe_double(value: Column) -> Column:
    """Decimal or scientific text to double, `nan`/`inf` included, else NULL.

    The pattern keeps out what the cast alone would take, such as `1.0d`.
    """
    text = strip(value.cast("string"))
    return (
        F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))
        .when(text.rlike(r"(?i)^[+-]?nan$"), F.lit(float("nan")))
        .when(text.rlike(r"(?i)^[+]?inf(inity)?$"), F.lit(float("inf")))
        .when(text.rlike(r"(?i)^-inf(inity)?$"), F.lit(float("-inf")))
    )


def safe_int(value: Column) -> Column:
    """Whole-number text to int; `12.0` and anything out of range are NULL."""
    text = strip(value.cast("string"))
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("int"))


def flag(value: Column) -> Column:
    """Y / true / 1 to true, everything else (also NULL) to false."""
    return F.coalesce(value.cast("string").isin(*TRUE_TEXT), F.lit(False))


def rounded(value: Column, digits: int) -> Column:
    return F.round(value, digits)


def rate(amount: Column, seconds: Column) -> Column:
    """Amount per second, 0 when no time has passed."""
    return F.coalesce(F.try_divide(amount.cast("double"), seconds.cast("double")), F.lit(0.0))


def eta_seconds(remaining: Column, throughput: Column) -> Column:
    """Seconds until `remaining` is worked off; NULL when unknown or standing still."""
    return F.when(throughput > 0, remaining / throughput)


def progress_percent(remaining: Column, initial: Column, done: Column) -> Column:
    """Share of the backlog worked off, in percent; 0 without a backlog."""
    return F.when(initial > 0, (1 - remaining / (initial + done)) * 100).otherwise(F.lit(0.0))
