"""Which object a query text means: the first level with a hit decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpass.functions.text import first_non_empty
from nearpass.operators.matching import first_containing
from nearpass.session import materialise, spread


def identifier_cascade(
    queries: DataFrame,
    orbits: DataFrame,
    risks: DataFrame,
    approaches: DataFrame,
    query: str = "query",
    wildcards: bool = True,
) -> DataFrame:
    """Queries plus `asteroid_id` and `level`, both NULL without a hit.

    Levels: 1 an object with an orbit, by id; 2 by designation or spk id; 3 an
    object on the risk list by designation or part of its name; 4 an object
    with approaches by id or part of its name.  Inside a level the smallest id
    counts.  Only queries that levels 1 and 2 leave open reach the substring
    levels.

    Two steps are written out, as several branches read them: the names of the
    objects and the answers of the equality levels.
    """
    def exact(df: DataFrame, column: str, level: int) -> DataFrame:
        return df.select(F.col(column).alias(query), F.lit(level).alias("level"), "asteroid_id")

    # The same text is looked up once, however often it is asked; one row per
    # object and spelling, not one per approach.
    asked = queries.select(query).distinct()
    named = spread(materialise(approaches.select("asteroid_id", "name").distinct()))
    keys = (
        exact(orbits, "asteroid_id", 1)
        .unionByName(exact(orbits, "designation", 2))
        .unionByName(exact(orbits, "spkid", 2))
        .unionByName(exact(risks, "designation", 3))
        .unionByName(exact(named, "asteroid_id", 4))
    )
    by_key = materialise(
        asked.join(keys, query, "left")
        .groupBy(query)
        .agg(F.min(F.when(F.col("level").isNotNull(), F.struct("level", "asteroid_id"))).alias("k"))
    )
    open_queries = by_key.filter(F.coalesce(F.col("k.level"), F.lit(9)) > 2)
    labels = (
        risks.select(F.lit(3).alias("level"), "asteroid_id", F.col("fullname").alias("label"))
        .unionByName(named.select(F.lit(4).alias("level"), "asteroid_id", F.col("name").alias("label")))
        .filter(F.col("label").isNotNull())
    )
    by_part = first_containing(labels, open_queries, "label", query, ("level", "asteroid_id"), wildcards).select(
        query, F.struct("level", "asteroid_id").alias("p")
    )
    found = by_key.join(by_part, query, "left").select(query, F.least("k", "p").alias("b"))
    return queries.join(found, query, "left").select(*queries.columns, "b.level", "b.asteroid_id")


INGESTED, CATALOGUE_ONLY, PENDING = "ingested", "catalogue_only", "pending"


def with_outcome(found: DataFrame, catalogue: DataFrame, query: str = "query") -> DataFrame:
    """Cascade answers plus `outcome` and what an outside catalogue says of the
    queries that no level answers.

    "ingested": some level has the object.  "catalogue_only": the catalogue has
    it under that designation, spk id or name (any case), but it is not stored
    yet; `catalogue_designation` and `catalogue_name` (full, else short) are its
    own.  "pending": nobody knows it.  Of several records the smallest
    designation counts.
    """
    record = F.struct(F.col("designation"), first_non_empty(F.col("fullname"), F.col("shortname")).alias("name"))
    keys = F.array_distinct(F.array_compact(F.array(F.lower("designation"), F.lower("spkid"), F.lower("fullname"))))
    index = catalogue.select(F.explode(keys).alias("__key"), record.alias("r")).filter("__key <> ''")
    index = index.groupBy("__key").agg(F.min("r").alias("r"))
    # A hit needs no look at the catalogue: its key is left out of the join.
    asked = found.withColumn("__key", F.when(F.col("level").isNull(), F.lower(query)))
    joined = asked.join(index, "__key", "left")
    outcome = F.when(F.col("level").isNotNull(), INGESTED).when(F.col("r").isNotNull(), CATALOGUE_ONLY).otherwise(PENDING)
    return joined.select(
        *found.columns, outcome.alias("outcome"), F.col("r.designation").alias("catalogue_designation"),
        F.col("r.name").alias("catalogue_name"),
    )
