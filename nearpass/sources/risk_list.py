"""Pipe-delimited risk list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpass.functions.numbers import safe_double, safe_int
from nearpass.functions.text import non_empty, normalise_designation, strip

# --- fixed values: layout of a line ------------------------------------------------
HEADER_STARTS = ("Last", "Num", "AAAA", "Object")
MIN_PARTS = 5
PARTS = {
    1: ("diameter_m", "DOUBLE"),
    2: ("diameter_certain", "FLAG"),
    3: ("vi_date", "TEXT"),
    4: ("ip_max", "DOUBLE"),
    5: ("ps_max", "DOUBLE"),
    6: ("ts", "INT"),
    7: ("vel_km_s", "DOUBLE"),
    8: ("years", "TEXT"),
    9: ("ip_cum", "DOUBLE"),
    10: ("ps_cum", "DOUBLE"),
}
CERTAIN = "*"
# --- end of fixed values --------------------------------------------------------------


def read_risk_list(spark: SparkSession, path: str) -> DataFrame:
    """A landed list, read line by line (a large file is split over tasks)."""
    return parse_risk_list(spark.read.text(path))


def parse_risk_list(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines to records with their matching `key`; headers, lines with fewer
    than five parts and lines without a designation are dropped."""
    text = strip(F.col(value))
    is_header = F.lit(False)
    for start in HEADER_STARTS:
        is_header = is_header | F.startswith(F.col("line"), F.lit(start))
    parts = lines.select(*keep, text.alias("line")).filter((F.col("line") != "") & ~is_header)
    parts = parts.select(*keep, F.transform(F.split("line", r"\|"), strip).alias("p")).filter(
        (F.size("p") >= MIN_PARTS) & (F.get("p", F.lit(0)) != "")
    )
    tokens = F.split(F.get("p", F.lit(0)), r"\s+")
    read = {
        "DOUBLE": safe_double,
        "INT": safe_int,
        "TEXT": lambda part: part,
        "FLAG": lambda part: F.contains(part, F.lit(CERTAIN)),
    }

    def part(i: int, kind: str) -> Column:
        return read[kind](F.get("p", F.lit(i)))

    return parts.select(
        *keep,
        normalise_designation(F.get(tokens, F.lit(0))).alias("key"),
        F.get(tokens, F.lit(0)).alias("esa_designation"),
        non_empty(F.array_join(F.slice(tokens, F.lit(2), F.size(tokens)), " ")).alias("esa_name"),
        *[part(i, kind).alias(name) for i, (name, kind) in PARTS.items()],
    )


def overlay(regular: DataFrame, special: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """One record per key: the special list overrides the regular one, and
    inside a list the last line (by `order`) counts."""
    columns = [name for name in regular.columns if name not in ("key", *order)]
    both = regular.withColumn("list_no", F.lit(0)).unionByName(special.withColumn("list_no", F.lit(1)))
    best = both.groupBy("key").agg(
        F.max_by(F.struct(*columns), F.struct("list_no", *order)).alias("r"),
        F.max("list_no").alias("list_no"),
    )
    return best.select("key", "r.*", (F.col("list_no") == 1).alias("is_special"))
