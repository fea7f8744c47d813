"""Stored tables and profiles of landed text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.schemas import Entity
from nearpass.sinks.chunks import YEAR


def read_table(
    spark: SparkSession, path: str, entity: Entity, since: date | None = None, until: date | None = None
) -> DataFrame:
    """A stored entity table, optionally between two dates (both inclusive).

    Bounds on a year-partitioned table prune whole folders before any file is
    opened; the date filter itself reaches the Parquet reader.
    """
    ddl = entity.ddl + ", row_hash STRING, ingestion_time TIMESTAMP"
    if entity.year_of is None:
        return spark.read.schema(ddl).parquet(path)
    df = spark.read.schema(f"{ddl}, {YEAR} INT").parquet(path)
    day = F.col(entity.year_of)
    if since is not None:
        df = df.filter((F.col(YEAR) >= since.year) & (day >= F.lit(since)))
    if until is not None:
        df = df.filter((F.col(YEAR) <= until.year) & (F.to_date(day) <= F.lit(until)))
    return df


def text_profile(texts: DataFrame, text: str, by: str) -> DataFrame:
    """Per source: whether any text is there, and how many characters."""
    return texts.groupBy(by).agg(
        (F.sum(F.length(text)) > 0).alias("available"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("n_chars"),
    )


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """Characters per landed text file, counted line by line so that one large
    file is shared by many tasks.

    Line ends are the bytes of the file that belong to no line, so the count is
    exact whether or not the last line is terminated.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.length("value").alias("chars"),
        F.octet_length("value").alias("octets"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
    )
    return lines.groupBy("file").agg(
        (F.sum("chars") + F.max("size") - F.sum("octets")).alias("n_chars"),
        F.lit(True).alias("available"),
    )
