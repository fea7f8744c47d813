"""Population z-scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _standardised(value: Column, mean: Column, deviation: Column) -> Column:
    """0 where nothing deviates, NULL where the value is unknown."""
    return F.when(deviation == 0, F.lit(0.0)).otherwise((value - mean) / F.nullif(deviation, F.lit(0.0)))


def zscore(
    df: DataFrame, columns: dict[str, str], partition_by: Iterable[str] = (), over: DataFrame | None = None
) -> DataFrame:
    """Add a z-score column per entry of `columns` (source -> new name).

    Without `partition_by` the moments of the whole table (or of `over`, when
    given) come from one aggregate whose single row reaches every task as a
    scalar subquery; a window without partition would move all rows to one task.
    """
    groups = list(partition_by)

    def moments(name: str) -> list[Column]:
        value = F.col(name).cast("double")
        return [F.avg(value).alias(f"{name}__mean"), F.stddev_pop(value).alias(f"{name}__dev")]

    wanted = [moment for name in columns for moment in moments(name)]
    if groups:
        # Same plan at any skew: partial sums per task, then a join on the groups.
        grouped = df.groupBy(*groups).agg(*wanted)
        keyed = grouped.select(*[F.col(g).alias(f"{g}__key") for g in groups], *grouped.columns[len(groups):])
        same = [F.col(g).eqNullSafe(F.col(f"{g}__key")) for g in groups]
        joined = df.join(keyed, same, "left")
        scores = {
            new: _standardised(F.col(name).cast("double"), F.col(f"{name}__mean"), F.col(f"{name}__dev"))
            for name, new in columns.items()
        }
        return joined.select(*df.columns, *[value.alias(new) for new, value in scores.items()])

    # One subquery column, read below: naming the subquery in every expression
    # would run it once per use.
    table_moments = (over if over is not None else df).agg(F.struct(*wanted).alias("m")).scalar()
    with_moments = df.withColumn("__moments", table_moments)
    scores = [
        _standardised(
            F.col(name).cast("double"), F.col(f"__moments.{name}__mean"), F.col(f"__moments.{name}__dev")
        ).alias(new)
        for name, new in columns.items()
    ]
    return with_moments.select(*df.columns, *scores)
