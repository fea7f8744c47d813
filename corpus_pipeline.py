"""From a table of documents to packed training sequences.

STAGES in order: each function takes (spark, docs, folder of tables) and
returns the documents it keeps, with the columns of the table; the last returns
the packed pieces.  Between two stages the documents are written as Parquet and
read again.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from nearpass.llm import jaccard_join, language_id, pattern_packing, positional_index, suffix_dedup  # noqa: E402
from nearpass.llm.work import Work, columns_of, forget, fresh, meets, misses, release, without  # noqa: E402
from nearpass.session import configure  # noqa: E402


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is rejected: no letters, or noise.

    Null and empty texts are rejected.  Repeated rows are judged alike, rows of
    one id with different texts each for itself.  An empty table stays empty.
    Extra columns of any name come through, here and in all stages but the last.
    """
    forget()
    return language_id.keep_identified(docs)


def row_key() -> Column:
    """A number for each pair of id and text, never null; rows equal in both share it."""
    return F.xxhash64("doc_id", "text")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id.

    Rows of one id with different texts are documents of their own; in one group
    the one with the smaller row key stays.  Of rows equal in id and text one
    stays.  Documents without words or without an id stay.
    """
    release()
    [key] = fresh(docs, "row_key")
    rows = docs.select(*columns_of(docs), row_key().alias(key))
    # Ordered by id, and a row without an id names a group only if all are without.
    own = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", row_key().alias("row"))
    groups = jaccard_join.jaccard_groups(docs.select(own.alias("doc"), "text"), key="doc", words=5, percent=80)
    groups = groups.filter("NOT doc.nameless").select(F.col("doc.row").alias(key), (F.col("doc") == F.col("component_id")).alias("stays"))
    groups = Work(spark).save(groups)
    gone = groups.filter("NOT stays").select(key)
    twice = groups.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key)
    kept = without(rows.filter("doc_id IS NOT NULL"), gone, key)
    once = misses(kept, twice, key)
    rest = meets(kept, twice, key).dropDuplicates([key])
    return once.union(rest).select(*columns_of(docs)).union(docs.filter("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur more than once; a text of which nothing is left goes.

    Null and empty texts stay as they are.  Repeated rows are each other's
    copies: nothing of a text of 200 bytes or more is left, and all of them go.
    """
    release()
    names = [f"column_{k}" for k in range(len(docs.columns))]  # of the input's columns while they are carried
    place = {c.lower(): name for c, name in zip(docs.columns, names, strict=True)}
    hidden = [c.alias(name) for c, name in zip(columns_of(docs), names, strict=True)]
    cut = suffix_dedup.remove_repeats(docs.select("doc_id", "text", *hidden), with_text=True, carry=tuple(names))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col(place["text"]))}
    if "n_chars" in place:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col(place["n_chars"]))
    left = cut.filter(~changed | (F.trim("kept_text") != ""))
    return left.select(*[new.get(c.lower(), F.col(name)).alias(c) for c, name in zip(docs.columns, names, strict=True)])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold passages of the benchmark; each text of an id is judged alone, and so are rows without an id."""
    release()
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    [key] = fresh(docs, "row_key")
    judged = positional_index.contamination(docs.select(row_key().alias(key), "text"), benchmark, key=key)
    bad = Work(spark).save(judged.filter("contaminated").select(key))
    rows = docs.select(*columns_of(docs), row_key().alias(key))
    return without(rows, bad, key).select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    Null and empty texts are a closing id alone; repeated rows are packed each
    for itself; an empty table gives no rows; extra columns are not read.
    """
    release()
    return pattern_packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("jaccard_join", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("pattern_packing", packed),
]

# Not expressible in SQL (trained model, token ids); tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        docs = Work(spark, passing=False).save(result)
    release()
    return docs
