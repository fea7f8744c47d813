"""Expressions on the values that are easy to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from nearpass.functions import dates, documents, fetches, hashing, numbers, risk, text


def values(spark, rows, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i INT, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_safe_double(spark):
    got = values(
        spark, ["12.0", " 12 ", "nan", "2.35E-3", "", "1.0d", "-inf", ".5", "5.", "1_000", None, "\t7\n"], "STRING",
        numbers.safe_double,
    )
    assert got[:2] == [12.0, 12.0] and math.isnan(got[2])
    assert got[3:] == [0.00235, None, None, -math.inf, 0.5, 5.0, None, None, 7.0]


def test_safe_int(spark):
    got = values(spark, ["12.0", " 12 ", "+7", "-3", "", "99999999999", "x", None], "STRING", numbers.safe_int)
    assert got == [None, 12, 7, -3, None, None, None, None]


def test_flags(spark):
    assert values(spark, ["Y", "true", "1", "N", "", None], "STRING", numbers.flag) == [True, True, True, False, False, False]


def test_passage_dates(spark):
    got = values(
        spark, ["2028-Jun-26 05:23", "2028-JUN-06", "2028-06-26", "2028-06-26 01:00", "garbage", "", "2028-Foo-26", None],
        "STRING", dates.passage_date,
    )
    day = dt.date(2028, 6, 26)
    assert got == [day, dt.date(2028, 6, 6), day, day, None, None, None, None]


def test_approach_dates(spark):
    assert values(spark, ["2026-01-31", "2026-02-31", "soon", None], "STRING", dates.approach_date) == [
        dt.date(2026, 1, 31), None, None, None,
    ]


@pytest.mark.parametrize(
    "object_id, name, expected",
    [
        ("2000433", "433 Name (1998 AB1)", ["433", "1998 AB1", "433 Name", "2000433"]),
        ("7", "(2010 AB7)", ["2010 AB7", "7"]),
        ("7", "Just a name", ["Just a name", "7"]),
        ("7", None, ["7"]),
        ("7", "  ", ["7"]),
        ("A898 PA", "(A898 PA)", ["A898 PA"]),
        ("433", "433 ", ["433"]),
        ("", "12 X", ["12", "12 X"]),
        (None, None, []),
    ],
)
def test_candidates(spark, object_id, name, expected):
    df = spark.createDataFrame([(object_id, name)], "id STRING, name STRING")
    assert df.select(text.designation_candidates(F.col("id"), F.col("name")).alias("c")).first().c == expected


def test_normalise_designation(spark):
    got = values(spark, [" (2000  SG344) ", "O'Neil", "99942", None], "STRING", text.normalise_designation)
    assert got == ["2000 sg344", "oneil", "99942", None]
    assert values(spark, ["O'Neil (x)"], "STRING", lambda c: text.normalise_designation(c, "()")) == ["o'neil x"]


def test_like_pattern_escapes_on_request(spark):
    assert values(spark, ["50%_a\\b"], "STRING", lambda c: text.like_pattern(c, escape=True)) == ["%50\\%\\_a\\\\b%"]
    assert values(spark, ["50%"], "STRING", text.like_pattern) == ["%50%%"]
    assert values(spark, ["a\\b\\%\\\\c\\"], "STRING", text.like_pattern) == ["%ab\\%\\\\c%"]


def test_risk_score_and_bands(spark):
    df = spark.createDataFrame(
        [(20.0, 2.0, 1e7, False), (None, None, 0.0, True), (20.0, 2.0, None, True), (400.0, 50.0, 1.0, True)],
        "v DOUBLE, d DOUBLE, m DOUBLE, h BOOLEAN",
    )
    got = [r.s for r in df.select(risk.risk_score(*map(F.col, "vdmh")).alias("s")).collect()]
    assert got == [pytest.approx(20 / 40 * 0.35 + 2 / 5 * 0.35 + 0.03), 1.0, 0.0, 1.0]
    assert values(spark, [None, 0, 1, 2, 4, 5, 7, 8, 10], "INT", risk.torino_band) == [
        "0", "0", "1", "2-4", "2-4", "5-7", "5-7", "8+", "8+",
    ]
    assert values(spark, [0.005, 0.01, 0.1, 0.5, 1.0], "DOUBLE", risk.size_class) == [
        "<10m", "10-100m", "100-500m", "500m-1km", ">1km",
    ]
    assert values(spark, [-1.0, 0.0, 39.9, 40.0], "DOUBLE", risk.velocity_bucket) == [0, 1, 8, 9]


def test_anomaly_counts_unknown_as_zero(spark):
    df = spark.createDataFrame([(None, 2.5), (None, 2.0), (None, None), (-3.0, 0.0)], "a DOUBLE, b DOUBLE")
    assert [r.x for r in df.select(risk.is_anomaly(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False, True]


def test_orbit_class_names(spark):
    df = spark.createDataFrame([("APO", "x"), ("ZZZ", "given"), ("ZZZ", ""), ("ZZZ", None)], "c STRING, n STRING")
    got = [r.x for r in df.select(risk.orbit_class_label(F.col("c"), F.col("n")).alias("x")).collect()]
    assert got == ["Apollo", "given", "ZZZ", "ZZZ"]
    assert len(risk.ORBIT_CLASSES) == 16


def test_row_hash_sees_moved_nulls(spark):
    df = spark.createDataFrame([(None, "x"), ("x", None)], "a STRING, b STRING")
    strict = df.select(hashing.row_hash(["a", "b"]).alias("h")).collect()
    loose = df.select(hashing.row_hash(["a", "b"], null_token=None).alias("h")).collect()
    assert strict[0].h != strict[1].h and loose[0].h == loose[1].h
    record = df.select(hashing.record_hash(df, ["b", "a"]).alias("h")).collect()
    assert record[0].h != record[1].h


def test_named_value_takes_the_last(spark):
    df = spark.createDataFrame([([("e", "1"), ("", "9"), ("e", "2")],), (None,)], "p ARRAY<STRUCT<name: STRING, value: STRING>>")
    assert [r.x for r in df.select(documents.named_value(F.col("p"), "e").alias("x")).collect()] == ["2", None]


def test_rates(spark):
    df = spark.createDataFrame([(100, 0.0, 50), (100, 20.0, 50)], "n INT, s DOUBLE, lag INT")
    df = df.withColumn("t", numbers.rate(F.col("n"), F.col("s")))
    got = df.select("t", numbers.eta_seconds(F.col("lag"), F.col("t")).alias("eta")).collect()
    assert [(r.t, r.eta) for r in got] == [(0.0, None), (5.0, 10.0)]


@pytest.mark.parametrize(
    "status, body, expected",
    [
        (200, '{"error": "Object was Removed"}', (200, "removed", False)),
        (200, '{"error": "Not Found"}', (404, "not_found", True)),
        (200, '{"data": []}', (200, None, False)),
        (200, "{cut", (200, "invalid_json", False)),
        (300, "[]", (300, "multiple_choices", False)),
        (400, '{"message": "no matching object"}', (404, "not_found", True)),
        (400, '{"message": "", "error": "not found"}', (404, "not_found", True)),
        (400, "no matching object", (400, "client_error", False)),
        (404, None, (404, "not_found", True)),
        (429, None, (429, "rate_limited", False)),
        (403, None, (403, "client_error", False)),
        (503, None, (503, "server_error", False)),
        (None, None, (None, "exhausted_retries", False)),
    ],
)
def test_response_outcome(spark, status, body, expected):
    df = spark.createDataFrame([(status, body)], "s INT, b STRING")
    got = df.select(fetches.response_outcome(F.col("s"), F.col("b")).alias("o")).select("o.*").first()
    assert tuple(got) == expected


def test_hold_until(spark):
    at = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("1", "S", 404, None, at)], "asteroid_id STRING, source STRING, http_status INT, body STRING, checked_at TIMESTAMP")
    row = fetches.classify_fetches(df, at, 30).first()
    assert row.not_found_until == dt.datetime(2026, 1, 31) and row.last_checked_at == at
