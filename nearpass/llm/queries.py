"""Registered queries of this subpackage: opN_<name>(spark, folder of tables) -> DataFrame.

Each applies its operator with production parameters to the whole table.  SQL
has the statements that DuckDB can run on the same files; the other queries are
compared with brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearpass.llm import (
    cap_filters,
    jaccard_join,
    language_id,
    license_scan,
    pattern_packing,
    positional_index,
    quality,
    sharding,
    suffix_dedup,
    token_alignment,
    token_rows,
    vector_codes,
    warc,
)
from nearpass.llm.work import Work
from nearpass.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark, d):
    """Language of every page and document from text, markup, address and host or source."""
    return language_id.languages_of(table(spark, d, "pages"), table(spark, d, "documents"))


@query
def op2_license_scan(spark, d):
    """Licences named or quoted anywhere in each document."""
    return license_scan.scan_licenses(table(spark, d, "documents"))


@query
def op3_quality(spark, d):
    """Quality score of every document, learnt from the labelled ones that are not held out."""
    return quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op4_suffix_dedup(spark, d):
    """Bytes of each document covered by a 200-byte string that starts anywhere else too."""
    return suffix_dedup.remove_repeats(table(spark, d, "documents"))


@query
def op5_cap_filters(spark, d):
    """Links and components of vectors of one label with a cosine of 0.93 or more."""
    return cap_filters.near_vectors(table(spark, d, "embeddings"))


@query
def op6_decontamination(spark, d):
    """Documents with words inside 13-word passages of the benchmark."""
    return positional_index.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op7_token_rows(spark, d):
    """Packed rows of token ids of all documents, written as files and read back as digests."""
    path = f"{Work(spark).folder}/token_rows"
    token_rows.write_token_rows(table(spark, d, "documents"), path)
    return token_rows.digest(spark.read.parquet(path))


@query
def op8_sharding(spark, d):
    """Shards of all documents of nearly equal bytes, equal texts together."""
    return sharding.shard(table(spark, d, "documents"))


@query
def op9_jaccard_join(spark, d):
    """Groups of documents whose sets of four-word shingles are similar by 0.85 or more."""
    return jaccard_join.jaccard_groups(table(spark, d, "documents"))


@query
def op10_pattern_packing(spark, d):
    """Pieces of all documents in sequences of 2048 tokens."""
    return pattern_packing.pack(table(spark, d, "documents"))


@query
def op11_warc(spark, d):
    """WARC records of all pages, written as archives and read back."""
    return warc.archived(table(spark, d, "pages"), f"{Work(spark).folder}/archives")


SQL["op11_warc"] = """
WITH sized AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), hashed AS (
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM sized
), first AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM hashed
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f IS NULL OR f IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to
FROM first
"""


@query
def op12_vector_codes(spark, d):
    """Codes of all vectors by 16 codebooks of 64 entries, their errors, and the digest of the codebooks."""
    return vector_codes.code_digests(table(spark, d, "embeddings"))


def _vector_codes_sql() -> str:
    """The codes by plain comparison of every part with every entry."""
    distance = "list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, len(v) + 1)])"
    steps = [
        """kept AS (
            SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
            FROM embeddings
            WHERE len(embedding) > 0 AND len(embedding) % 16 = 0
              AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding]))""",
        "placed AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS place FROM kept)",
        """parts AS (
            SELECT place, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS v
            FROM placed CROSS JOIN (SELECT unnest(range(16)) AS p))""",
        "book0 AS (SELECT p, place - 1 AS e, v AS c FROM parts WHERE place <= 64)",
    ]
    for r in range(3):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT place, p, any_value(v) AS v, min([CAST({distance} AS BIGINT), e]) AS best"
            f" FROM parts JOIN book{r} USING (p) GROUP BY place, p)"
        )
        if r < 2:
            steps.append(
                f"""sums{r} AS (
                    SELECT p, best[2] AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
                    FROM near{r} CROSS JOIN LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL)"""
            )
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (
                    SELECT b.p, b.e, coalesce(any_value(m.c), any_value(b.c)) AS c FROM book{r} b LEFT JOIN (
                        SELECT p, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM sums{r} GROUP BY p, e
                    ) m ON m.p = b.p AND m.e = b.e GROUP BY b.p, b.e)"""
            )
    steps.append(
        """coded AS (
            SELECT place, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
            FROM near2 GROUP BY place)"""
    )
    steps.append(
        """digest AS (
            SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)"""
    )
    return (
        "WITH " + ",\n".join(steps) + """
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM placed JOIN coded USING (place) CROSS JOIN digest"""
    )


SQL["op12_vector_codes"] = _vector_codes_sql()


@query
def op13_token_alignment(spark, d):
    """Groups and links between the tokens that two tokenizers cut each document into."""
    return token_alignment.align_tokens(table(spark, d, "documents"))
