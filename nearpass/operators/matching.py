"""Matches that are not one equality: an OR of two, and substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearpass.functions.text import like_pattern

GRAM = 3


def risk_list_matches(orbits: DataFrame, risk_list: DataFrame) -> DataFrame:
    """Risk-list rows per object: those under its id and those whose designation
    equals its own, each once.

    The OR of the two conditions as two equality joins.  The right side of the
    second is keyed by object already, so tables of any size join the result on
    `asteroid_id` alone.
    """
    listed = risk_list.withColumnRenamed("asteroid_id", "esa_id")
    by_id = listed.withColumn("asteroid_id", F.col("esa_id"))
    designations = orbits.select("asteroid_id", F.lower("designation").alias("__d"))
    by_designation = listed.join(designations, F.lower("esa_designation") == F.col("__d")).drop("__d")
    return by_id.unionByName(by_designation).dropDuplicates(["asteroid_id", "esa_id"])


def _grams(text: Column, sizes: Column) -> Column:
    """All distinct pieces of a text of the given sizes."""
    pieces = F.transform(
        sizes,
        lambda n: F.when(
            F.length(text) >= n,
            F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)),
        ).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.flatten(pieces))


# Stand-ins for escaped characters while a pattern is taken apart (private use).
_ESCAPED = {"\\\\": "\ue000", "\\%": "\ue001", "\\_": "\ue002"}


def _protected(pattern: Column) -> Column:
    """A pattern in lower case whose remaining `%` and `_` are all wildcards."""
    text = F.lower(pattern)
    for escaped, mark in _ESCAPED.items():
        text = F.replace(text, F.lit(escaped), F.lit(mark))
    return F.replace(text, F.lit("\\"), F.lit(""))


def _literal_run(protected: Column) -> Column:
    """The longest run without wildcards, as it stands in a text."""
    runs = F.split(protected, "[%_]")
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("n"), run.alias("run"))))
    text = longest["run"]
    for escaped, mark in _ESCAPED.items():
        text = F.replace(text, F.lit(mark), F.lit(escaped[1:]))
    return text


def first_of_length(texts: DataFrame, wanted: DataFrame, text: str, length: str, order: tuple[str, ...]) -> DataFrame:
    """(length, best) for each distinct length of `wanted` that some text has or
    exceeds: the smallest `order` columns among the texts at least that long.

    The texts are brought down to one row per length; the minimum then runs from
    the longest length down, over those rows and the wanted lengths alone.
    """
    per_length = texts.filter(F.col(text).isNotNull()).groupBy(F.length(text).alias("__length")).agg(
        F.min(F.struct(*order)).alias("__best")
    )
    asked = wanted.select(F.col(length).alias("__length")).distinct().withColumn("__best", F.lit(None).cast(per_length.schema["__best"].dataType))
    rows = per_length.withColumn("__asked", F.lit(False)).unionByName(asked.withColumn("__asked", F.lit(True)))
    # Peers of one length count, so a range frame.
    down = Window.orderBy(F.col("__length").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("best", F.min("__best").over(down)).filter("__asked AND best IS NOT NULL")
    return found.select(F.col("__length").alias(length), "best")


def _pieces(text: str) -> Column:
    """What a text can be met on: its pieces of one to three letters."""
    return _grams(F.lower(text), F.array(*[F.lit(n) for n in range(1, GRAM + 1)]))


def first_containing(
    texts: DataFrame, queries: DataFrame, text: str, query: str, order: tuple[str, ...], wildcards: bool = True
) -> DataFrame:
    """Per distinct query the smallest `order` columns among the texts that
    contain it, whatever the case; queries no text contains are absent.

    A text that contains a query contains each of its three-letter pieces, so
    texts and queries meet in an equality join on the query's rarest piece and
    only those pairs are compared.  Queries shorter than three letters meet on
    what they have.  A query of at most three plain letters is itself a piece:
    the smallest text per piece answers it and no pair is formed.  One of
    wildcards alone asks for the length of a text: the smallest text of at
    least as many letters as it has `_` answers it, and no pair is formed either.
    """
    body = _protected(F.col(query)) if wildcards else F.lower(query)
    every = queries.filter(F.col(query).isNotNull()).select(query).distinct().select(
        query,
        (body.rlike("[%_]") if wildcards else F.lit(False)).alias("wild"),
        (_literal_run(body) if wildcards else body).alias("lit"),
        F.length(F.regexp_replace(body, "[^_]", "") if wildcards else F.col(query)).alias("letters"),
    )
    blank = every.filter(F.col("lit") == "")
    by_length = blank.join(first_of_length(texts, blank, text, "letters", order), "letters").select(query, "best")
    asked = every.filter(F.col("lit") != "").withColumn("brief", (F.length("lit") <= GRAM) & ~F.col("wild"))
    size = F.least(F.length("lit"), F.lit(GRAM))
    parts = asked.select(
        query,
        "brief",
        "wild",
        "lit",
        F.explode(_grams(F.col("lit"), F.array(size))).alias("gram"),
    )
    spread = texts.select(*order, text, F.explode(_pieces(text)).alias("gram")).join(
        parts.select("gram").distinct(), "gram", "left_semi"
    )
    best = F.min(F.struct(*order)).alias("best")
    per_piece = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), best)
    # A piece that no text has rules its query out, hence the left join and the 0.
    anchors = (
        parts.join(per_piece, "gram", "left")
        .groupBy(query, "brief", "wild", "lit")
        .agg(F.min(F.struct(F.coalesce(F.col("n"), F.lit(0)).alias("n"), "gram", "best")).alias("a"))
        .filter(F.col("a.n") > 0)
        .select(query, "brief", "wild", "lit", "a.gram", "a.best")
    )
    answered = anchors.filter("brief").select(query, "best")
    pattern = like_pattern(F.col(query))
    # The literal run settles plain queries and keeps most other pairs from the pattern.
    matches = F.contains(F.lower(text), F.col("lit")) & F.when(F.col("wild"), F.ilike(F.col(text), pattern)).otherwise(True)
    pairs = spread.join(anchors.filter(~F.col("brief")).select(query, "wild", "lit", "gram"), "gram").filter(matches)
    found = answered.unionByName(by_length).unionByName(pairs.groupBy(query).agg(best))
    return found.select(query, "best.*")
