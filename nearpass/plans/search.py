"""Search by name or id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearpass.functions.text import like_pattern
from nearpass.operators.keyed import latest_per_key

# --- fixed values: length of the answer and sources -------------------------------
MAX_HITS = 10
ENOUGH_LOCAL = 5
LOCAL, CATALOGUE = "local_db", "jpl_sbdb"
# --- end of fixed values ------------------------------------------------------------


def local_hits(approaches: DataFrame, query: str, n: int = MAX_HITS, escape: bool = False) -> DataFrame:
    """The last approach of the first `n` objects (by id) whose name or id
    contains the query, whatever the case."""
    pattern = like_pattern(F.lit(query), escape)
    found = approaches.filter(F.ilike("name", pattern) | F.ilike("asteroid_id", pattern)).select(
        "asteroid_id", "name", "is_potentially_hazardous", "estimated_diameter_km_max", "close_approach_date",
        "miss_distance_km", "epoch_date_close_approach",
    )
    latest = latest_per_key(
        found, ["asteroid_id"], "close_approach_date",
        F.col("miss_distance_km").asc_nulls_last(), F.col("epoch_date_close_approach").asc_nulls_last(),
    )
    return latest.drop("miss_distance_km", "epoch_date_close_approach").orderBy("asteroid_id").limit(n)


def catalogue_hit(orbits: DataFrame, query: str) -> DataFrame:
    """The catalogue's one object of that designation, spk id or full name; it is
    called by its full name, else its short one if the catalogue has such a column, else as asked."""
    text = query.lower()
    names = [F.nullif(F.col(c), F.lit("")) for c in ("fullname", "shortname") if c in orbits.columns]
    same = (F.lower("designation") == text) | (F.col("spkid") == query) | (F.lower("fullname") == text)
    return (
        orbits.filter(same)
        .orderBy(F.col("designation").asc_nulls_last())
        .limit(1)
        .select(
            F.coalesce("designation", F.lit("")).alias("asteroid_id"),
            F.coalesce(*names, F.lit(query)).alias("name"),
            F.coalesce("is_pha", F.lit(False)).alias("is_potentially_hazardous"),
        )
    )


def object_search(approaches: DataFrame, orbits: DataFrame, query: str, escape: bool = False) -> DataFrame:
    """Local hits, and the catalogue's hit where fewer than five are local.

    The count runs over at most eleven rows, inside the plan.
    """
    if not query:
        raise ValueError("the query must not be empty")
    local = local_hits(approaches, query, escape=escape).withColumn("source", F.lit(LOCAL))
    both = local.unionByName(
        catalogue_hit(orbits, query).withColumn("source", F.lit(CATALOGUE)), allowMissingColumns=True
    )
    n_local = F.count_if(F.col("source") == LOCAL).over(Window.partitionBy(F.lit(1)))
    return (
        both.withColumn("n_local", n_local)
        .filter((F.col("source") == LOCAL) | (F.col("n_local") < ENOUGH_LOCAL))
        .drop("n_local")
        .orderBy(F.col("source").desc(), "asteroid_id")
        .limit(MAX_HITS)
    )
