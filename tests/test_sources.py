"""Readers on small landed files with the awkward cases in them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from nearpass.operators.keyed import dedupe_approaches
from nearpass.schemas import APPROACH, ORBIT, RISK
from nearpass.sources import agencies, approaches, fireballs, impact_risk, matrix, orbits, passages, risk_list, tables
from nearpass.sinks.chunks import write_chunked


def write(path, *texts):
    path.mkdir(parents=True, exist_ok=True)
    for i, text in enumerate(texts):
        (path / f"{i}.json").write_text(text)
    return str(path)


def messages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value STRING")


def passing(date="2026-01-31", object_id="1", passes=None, **more):
    default = [{"orbiting_body": "Earth", "miss_distance": {"kilometers": "45290298.225725659"}}]
    asteroid = {"id": object_id, "name": "n", "close_approach_data": default if passes is None else passes, **more}
    return json.dumps({"date": date, "asteroid": asteroid, "unknown": 1})


def test_feed_documents(spark, tmp_path):
    feed = {"element_count": 3, "near_earth_objects": {"2026-01-01": [{"id": "1"}, {"id": "2"}], "2026-01-02": [{"id": "3"}], "2026-01-03": []}}
    got = approaches.read_feed(spark, write(tmp_path, json.dumps(feed, indent=1)))
    assert sorted((r.date, r.asteroid.id) for r in got.collect()) == [("2026-01-01", "1"), ("2026-01-01", "2"), ("2026-01-02", "3")]


def test_malformed_messages_are_set_aside(spark):
    raw = messages(spark, passing(), passing()[:40], "", '{"date": "2026-01-01"}')
    good, bad = approaches.split_malformed(approaches.parse_messages(raw), "asteroid")
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "no asteroid", "no asteroid"] or bad.count() == 3


def test_flatten_keeps_each_pass(spark):
    two = [{"epoch_date_close_approach": 1.0, "miss_distance": {"kilometers": "7"}}, {"epoch_date_close_approach": 2.0, "miss_distance": {"kilometers": "5"}}]
    missing = json.dumps({"date": "2026-01-01", "asteroid": {"id": "9"}})
    raw = messages(spark, passing(), passing(object_id="2", passes=two), passing(object_id="3", passes=[]), missing, passing(object_id=None))
    flat = approaches.flatten_messages(approaches.parse_messages(raw).select("d.*"))
    assert set(flat.columns) == set(APPROACH.columns)
    kept = approaches.drop_incomplete(APPROACH.conform(flat))
    assert sorted(r.asteroid_id for r in kept.collect()) == ["1", "2", "2"]
    nearest = dedupe_approaches(kept).filter("asteroid_id = '2'").first()
    assert nearest.epoch_date_close_approach == 2 and nearest.miss_distance_km == 5
    exact = kept.filter("asteroid_id = '1'").first()
    assert str(exact.miss_distance_km) == "45290298.225725659000000000"


def test_bad_date_becomes_null(spark):
    flat = approaches.flatten_messages(approaches.parse_messages(messages(spark, passing(date="soon"))).select("d.*"))
    assert APPROACH.conform(flat).first().close_approach_date is None


def test_messages_round_trip(spark):
    flat = APPROACH.conform(approaches.flatten_messages(approaches.parse_messages(messages(spark, passing(nasa_jpl_url="u"))).select("d.*")))
    again = approaches.to_messages(flat).select(F.to_json(F.struct("*")).alias("value"))
    back = APPROACH.conform(approaches.flatten_messages(approaches.parse_messages(again).select("d.*")))
    assert back.collect() == flat.collect()


def test_matrix_rows(spark, tmp_path):
    payload = {"count": 2, "fields": ["a", "b", "a"], "data": [["1", "2", "3"], ["4"], ["5", "6", "7", "8"]]}
    df = matrix.read_matrix(spark, write(tmp_path, json.dumps(payload), json.dumps({"fields": ["a"], "data": []})))
    entries = [r.entry for r in matrix.zip_fields_rows(df).orderBy("row_no").collect()]
    assert entries == [{"a": "3", "b": "2"}, {"a": "4"}, {"a": "7", "b": "6"}]
    cells = [(r.a, r.b, r.c) for r in matrix.matrix_cells(df, ["a", "b", "c"]).orderBy("row_no").collect()]
    assert cells == [("3", "2", None), ("4", None, None), ("7", "6", None)]


def test_bulk_orbits(spark):
    df = spark.createDataFrame(
        [(["pdes", "full_name", "neo", "pha", "e", "n_obs_used", "class"], [["433", "433 Eros", "Y", "N", "0.22", "12.0", "AMO"], ["", "x"], [None]])],
        "fields ARRAY<STRING>, data ARRAY<ARRAY<STRING>>",
    )
    rows = orbits.parse_bulk(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.designation, r.is_neo, r.is_pha, r.eccentricity, r.n_obs_used, r.equinox, r.prefix) == ("433", True, False, 0.22, None, "J2000", None)
    assert set(ORBIT.columns) - {"asteroid_id"} <= set(rows[0].asDict())


def test_orbit_documents(spark, tmp_path):
    full = {
        "object": {"des": "1", "neo": True, "orbit_class": {"code": "APO", "name": "Apollo"}, "des_alt": [{"des": "x"}], "orbit_id": ""},
        "orbit": {"orbit_id": "7", "elements": [{"name": "e", "value": ".1"}, {"name": "", "value": "9"}, {"name": "e", "value": ".2"}], "n_obs_used": 12, "model_pars": []},
        "phys_par": [{"name": "spec_B", "value": ""}, {"name": "spec_T", "value": "S"}, {"name": "H", "value": "17"}],
        "discovery": {"who": "w", "discovery": "text"},
    }
    bare = {"object": {"des": "2", "des_alt": []}}
    other = {"message": "not found"}
    df = orbits.read_objects(spark, write(tmp_path, *map(json.dumps, (full, bare, other))))
    one, two = df.orderBy("designation").collect()
    assert (one.eccentricity, one.orbit_id, one.spectral_type, one.des_alt, one.model_pars) == (0.2, "7", "S", '[{"des":"x"}]', None)
    assert (one.n_obs_used, one.absolute_magnitude_h, one.discovery_text, one.is_pha) == (12, 17.0, "text", False)
    assert (two.des_alt, two.spectral_type, two.is_neo, two.orbit_class) == (None, None, False, None)


def test_risk_documents(spark, tmp_path):
    docs = [
        {"designation": "a", "error": "object was Removed", "removed": "2021-01-01"},
        {"designation": "b", "error": "no data"},
        {"designation": "c"},
        {"designation": "d", "summary": {"des": "D", "ip": "1e-3", "nobs": "12.0", "darc": "5 d"}},
    ]
    rows = impact_risk.read_objects(spark, write(tmp_path, *map(json.dumps, docs))).orderBy(F.lower("designation")).collect()
    assert [(r.designation, r.status, r.removed_date, r.impact_probability, r.n_obs) for r in rows] == [
        ("a", "removed", "2021-01-01", None, None),
        ("b", "not_found", None, None, None),
        ("c", "not_found", None, None, None),
        ("D", "active", None, 0.001, None),
    ]
    assert set(RISK.columns) - {"asteroid_id"} == set(rows[0].asDict())


def test_risk_lists(spark, tmp_path):
    active = impact_risk.read_active(spark, write(tmp_path / "a", json.dumps({"data": [{"des": "1", "ip": "0.5", "range": "2056-2113"}]})))
    row = active.first()
    assert (row.status, row.impact_probability, row.impact_date_range, row.method) == ("active", 0.5, "2056-2113", None)
    removed = impact_risk.read_removed(spark, write(tmp_path / "r", json.dumps({"data": [{"des": "(2000  AB)", "removed": "x"}, {"des": "2000 ab", "removed": "y"}]})))
    assert [tuple(r) for r in removed.collect()] == [("2000 ab", "y")]


def test_passages(spark):
    df = spark.createDataFrame(
        [(["des", "cd", "dist", "fullname", "body"], [["1", "2028-Jun-26 05:23", "0.1", "  (x) ", None], ["2", "garbage", "0.1", "y", "Moon"], ["", "2028-06-26", "n/a", None, "Moon"]])],
        "fields ARRAY<STRING>, data ARRAY<ARRAY<STRING>>",
    )
    rows = passages.parse_passages(df)
    assert [(r.designation, r.approach_date, r.distance_au, r.fullname, r.body) for r in rows.orderBy("row_no").collect()] == [
        ("1", dt.date(2028, 6, 26), 0.1, "(x)", "Earth"),
        ("", dt.date(2028, 6, 26), None, "", "Moon"),
    ]
    assert passages.designation_groups(rows).count() == 1
    assert passages.in_range(rows).count() == 2
    assert passages.in_range(rows, dist_max_au=150.0).count() == 1
    assert passages.in_range(rows, date_max=dt.date(2028, 6, 25)).count() == 0


def test_fireballs(spark):
    df = spark.createDataFrame(
        [(["date", "energy", "impact-e", "lat-dir"], [["2024-01-31 12:00:01", "2.5", "0.08", "N"], [None, "1"], ["never", "1"]])],
        "fields ARRAY<STRING>, data ARRAY<ARRAY<STRING>>",
    )
    rows = fireballs.parse_fireballs(df).collect()
    assert [(r.event_date, r.total_radiated_energy_j, r.impact_energy_kt, r.latitude_dir, r.altitude_km) for r in rows] == [
        (dt.datetime(2024, 1, 31, 12, 0, 1), 2.5, 0.08, "N", None)
    ]


RISK_LINES = """Last Update: 2026-01-01 00:00 UTC
Num/des  Name | m | *=Y | Date/Time | IP max | PS max | TS | Vel km/s | Years | IP cum | PS cum
AAAAAAAA | NN | A | ...
2031AB7             |  14 |  *  | 2044-11-08 17:08 | 2.35E-3 | -2.67 | 0 | 21.01 | 2044-2049 | 2.35E-3 | -2.67 |

90001  Example Two  | 480 |     | 2182-09-24 10:00 | 3.7E-4  | -1.60 |   | 5.99  | 2178-2290 | 5.7E-4  | -1.40 |
short | 1 | * | 2044
   | 1 | * | 2044 | 1E-3 | -2
five | x | * | 2044 | 1E-3
"""


def test_risk_list_lines(spark, tmp_path):
    (tmp_path / "list.txt").write_text(RISK_LINES)
    rows = {r.key: r for r in risk_list.read_risk_list(spark, str(tmp_path)).collect()}
    assert set(rows) == {"2031ab7", "90001", "five"}
    first, second, third = rows["2031ab7"], rows["90001"], rows["five"]
    assert (first.esa_designation, first.esa_name, first.diameter_certain, first.ip_max, first.ts) == ("2031AB7", None, True, 0.00235, 0)
    assert (second.esa_name, second.diameter_m, second.diameter_certain, second.ts, second.ps_cum) == ("Example Two", 480.0, False, None, -1.4)
    assert (third.diameter_m, third.diameter_certain, third.ps_max) == (None, True, None)


def test_special_list_overrides(spark):
    lines = lambda *texts: risk_list.parse_risk_list(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value STRING, n INT"), keep=("n",))
    regular = lines("a | 1 | | t | 1", "b | 2 | | t | 1", "B | 3 | | t | 1")
    special = lines("A | 9 | * | t | 1")
    got = {r.key: (r.diameter_m, r.is_special) for r in risk_list.overlay(regular, special, ("n",)).collect()}
    assert got == {"a": (9.0, True), "b": (3.0, False)}


def test_file_profile_counts_characters(spark, tmp_path):
    (tmp_path / "a.txt").write_text("äb\ncd\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("äb\n\ncd", encoding="utf-8")
    got = {r.file.rsplit("/", 1)[1]: r.n_chars for r in tables.file_profile(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": 6, "b.txt": 6}


def test_chunked_table_prunes_years(spark, tmp_path):
    rows = [(dt.date(2020 + i % 3, 1, 1), str(i)) for i in range(30)]
    df = APPROACH.conform(spark.createDataFrame(rows, "close_approach_date DATE, asteroid_id STRING"))
    path = str(tmp_path / "t")
    write_chunked(df, path, "close_approach_date")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == [f"approach_year={y}" for y in (2020, 2021, 2022)]
    back = tables.read_table(spark, path, APPROACH, since=dt.date(2021, 1, 1), until=dt.date(2021, 12, 31))
    assert back.count() == 10
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(approach_year" in plan and "close_approach_date" in plan.split("PushedFilters:")[1]


def test_envelope_routing(spark):
    envelope = {
        "asteroid_id": "1", "name": "n", "timestamp": "t",
        "agencies": {
            "sbdb": {"designation": "d", "n_obs_used": 12, "is_neo": True, "eccentricity": 0.1},
            "sentry": {},
            "cad": [{"approach_date": "2026-01-01", "distance_au": 0.1}, {"distance_au": 0.2}],
            "fireball": [],
        },
    }
    shared = {"asteroid_id": agencies.FIREBALL_ID, "agencies": {"fireball": [{"event_date": "2024-01-01 00:00:00", "latitude": 1.5}, {}]}}
    nobody = {"asteroid_id": "", "agencies": {"sbdb": {"designation": "x"}}}
    raw = messages(spark, *map(json.dumps, (envelope, shared, nobody)))
    parts = agencies.route_envelope(approaches.parse_messages(raw, agencies.ENVELOPE_SCHEMA).select("d.*"))
    got = {name: df.collect() for name, df in parts.items()}
    assert {name: len(rows) for name, rows in got.items()} == {"sbdb": 1, "sentry": 0, "cad": 1, "esa": 0, "fireball": 1}
    assert (got["sbdb"][0].asteroid_id, got["sbdb"][0].n_obs_used, got["sbdb"][0].is_neo) == ("1", 12, True)
    assert got["cad"][0].body == "Earth" and got["fireball"][0].latitude == 1.5
    assert "asteroid_id" not in got["fireball"][0].asDict()


def test_defaults_fill_missing_values(spark):
    df = spark.createDataFrame([("1", None)], "asteroid_id STRING, status STRING")
    assert RISK.conform(df).first().status == "unknown"


@pytest.mark.parametrize("entity, n", [(APPROACH, 26), (ORBIT, 64), (RISK, 29)])
def test_column_counts(entity, n):
    assert len(entity.columns) == n
