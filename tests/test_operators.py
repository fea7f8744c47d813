"""Operators against brute force on small data, and the plans they make."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from nearpass.operators import cascade, changes, keyed, lookup, matching, resolve
from nearpass.operators.zscore import zscore
from nearpass.plans import metrics, profiles, search, watch, windows, worklist


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- z-scores ---------------------------------------------------------------------

@pytest.mark.parametrize("partition_by", [(), ("g",)])
def test_zscore(spark, partition_by):
    rows = [("a", 1.0, 5.0), ("a", 3.0, 5.0), ("a", None, 5.0), ("b", 9.0, None), (None, 2.0, 1.0)]
    df = zscore(spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE"), {"x": "zx", "y": "zy"}, partition_by)
    for row in df.collect():
        for value, got in ((row.x, row.zx), (row.y, row.zy)):
            column = 1 if value is row.x else 2
            same = [r[column] for r in rows if r[column] is not None and (not partition_by or r[0] == row.g)]
            if not same:
                assert got is None
                continue
            mean = sum(same) / len(same)
            dev = (sum((v - mean) ** 2 for v in same) / len(same)) ** 0.5
            if dev == 0:
                assert got == 0.0
            else:
                assert (got is None) == (value is None) and (value is None or got == pytest.approx((value - mean) / dev))


def test_zscore_moves_no_rows(spark):
    df = zscore(spark.range(100).select(F.col("id").cast("double").alias("x")), {"x": "z"})
    plan = plan_of(df)
    assert plan.count("Subquery") >= 1 and "Window" not in plan and "NestedLoop" not in plan
    # Only partial aggregates are gathered, never the rows.
    lines = plan.splitlines()
    gathered = [lines[i + 1] for i, line in enumerate(lines) if "SinglePartition" in line]
    assert gathered and all("partial_avg" in line for line in gathered)


def test_metrics_with_constant_columns(spark):
    day = dt.date(2026, 1, 1)
    rows = [(day, 1.0, None, 10.0, 0.0, True), (day, 1.0, None, 10.0, None, None)]
    df = spark.createDataFrame(
        rows,
        "close_approach_date DATE, estimated_diameter_km_min DOUBLE, estimated_diameter_km_max DOUBLE,"
        " relative_velocity_km_s DOUBLE, miss_distance_km DOUBLE, is_potentially_hazardous BOOLEAN",
    )
    row = metrics.daily_metrics(df).first()
    assert (row.asteroid_count, row.hazardous_count, row.anomaly_count, row.high_risk_count) == (2, 1, 0, 1)
    assert row.avg_risk_score == 0.5


# --- keyed picks ----------------------------------------------------------------------

def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    latest = keyed.latest_per_key(df, ["k"], "t")
    assert sorted((r.k, r.t) for r in latest.collect()) == [(0, 999), (1, 997), (2, 998)]
    assert "WindowGroupLimit" in plan_of(latest)


def test_dedupe_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k STRING, n INT, v STRING")
    assert sorted((r.k, r.v) for r in keyed.dedupe_last(df, ["k"], ["n"]).collect()) == [("a", "y"), ("b", "z")]


# --- changes ---------------------------------------------------------------------------

def test_changes_and_upsert(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("z", "1")], "k STRING, row_hash STRING")
    batch = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "k STRING, row_hash STRING")
    got = {r.k: r.change_type for r in changes.label_changes(batch, stored, ["k"]).collect()}
    assert got == {"a": "SAME", "b": "UPDATE", "c": "INSERT"}
    found = changes.detect_changes(batch, stored, ["k"]).drop("change_type")
    table = {r.k: r.row_hash for r in changes.upsert(stored, found, ["k"]).collect()}
    assert table == {"a": "1", "b": "2", "c": "1", "z": "1"}


# --- lookups ---------------------------------------------------------------------------

def lookup_by_hand(candidates, key_forms, index):
    for candidate in candidates:
        for form in key_forms:
            if form(candidate) in index:
                return index[form(candidate)]
    return None


def test_lookup_first_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["Aa", "aa", "Bb", "bb", "cC", "cc", "D", "d", "E e", "e e"]
    objects = [(str(i), rng.sample(words, rng.randint(0, 4))) for i in range(60)]
    keys = rng.sample(words, 5)
    index = {key: f"rec-{key}" for key in keys}
    df = spark.createDataFrame(objects, "asteroid_id STRING, candidates ARRAY<STRING>")
    idx = spark.createDataFrame([("c", k, 0, v) for k, v in index.items()], "catalogue STRING, key STRING, rank INT, ref STRING")
    got = lookup.lookup_first(df, idx, {"c": lookup.ORBIT_FORMS})
    assert {r.asteroid_id: r.c.ref if r.c else None for r in got.collect()} == {
        i: lookup_by_hand(cands, [str, str.lower], index) for i, cands in objects
    }
    assert "NestedLoop" not in plan_of(got)


def resolved(spark, objects, **tables):
    def df(name, ddl):
        return spark.createDataFrame(tables.get(name, []), ddl)

    return resolve.resolve_profiles(
        spark.createDataFrame(objects, "asteroid_id STRING, name STRING"),
        df("orbits", "row_no INT, asteroid_id STRING, designation STRING, spkid STRING, name STRING"),
        df("active", "row_no INT, designation STRING"),
        df("removed", "key STRING, removed_date STRING"),
        df("passages", "designation STRING"),
        df("risk_list", "key STRING"),
        df("holds", "asteroid_id STRING, source STRING"),
    )


def test_removed_on_an_earlier_candidate_beats_active_on_a_later_one(spark):
    row = resolved(spark, [("7", "(2010 AB7)")], active=[(0, "7")], removed=[("2010 ab7", "2020-01-01")]).first()
    assert (row.sentry_status, row.sentry_designation, row.removed_date, row.sentry_key) == ("removed", "2010 AB7", "2020-01-01", None)
    row = resolved(spark, [("7", "(2010 AB7)")], active=[(0, "2010 AB7")], removed=[("2010 ab7", "2020-01-01")]).first()
    assert (row.sentry_status, row.sentry_key) == ("active", "2010 ab7")


def test_orbit_hit_extends_the_candidates(spark):
    row = resolved(
        spark, [("7", "Name")], orbits=[(0, "7", "DES", "200", "name")], active=[(0, "des")], passages=[("200",)],
        risk_list=[("na me",), ("name",)],
    ).first()
    assert row.candidates == ["DES", "Name", "7", "200"]
    assert (row.sbdb_id, row.sentry_status, row.cad_designation, row.esa_key) == ("7", "active", "200", "name")


def test_risk_list_without_blanks(spark):
    row = resolved(spark, [("7", "(2010 AB7)")], risk_list=[("2010ab7",)]).first()
    assert (row.on_risk_list, row.esa_key) == (True, "2010ab7")


def test_held_sources_are_left_out(spark):
    held = [("7", "JPL_Sentry"), ("7", "ESA_NEOCC"), ("7", "JPL_SBDB")]
    row = resolved(spark, [("7", "x")], orbits=[(0, "7", "x", None, None)], holds=held).first()
    assert (row.sbdb_id, row.sentry_status, row.sentry_designation, row.on_risk_list) == (None, None, None, None)
    row = resolved(spark, [("7", "x")]).first()
    assert (row.sentry_status, row.sentry_designation, row.on_risk_list) == ("not_found", "x", False)


def test_later_record_of_a_key_wins(spark):
    orbits = [(0, "a", "K", "1", None), (1, "b", "J", "K", None), (2, "c", "I", "2", "K")]
    df = spark.createDataFrame(orbits, "row_no INT, asteroid_id STRING, designation STRING, spkid STRING, name STRING")
    index = {r.key: (r.ref.id, r.n_records) for r in resolve.orbit_refs(df, "row_no", "asteroid_id").collect()}
    assert index["K"] == ("b", 2) and index["k"] == ("c", 1)


def test_ids_are_profiled_or_not(spark):
    approaches = spark.createDataFrame([("1",), ("1",), ("2",), ("3",)], "asteroid_id STRING")
    orbits = spark.createDataFrame([("2",), ("9",)], "asteroid_id STRING")
    assert sorted(r.asteroid_id for r in worklist.never_profiled(approaches, orbits).collect()) == ["1", "3"]


# --- OR join and substrings -----------------------------------------------------------------

def test_or_join_equals_brute_force(spark):
    orbits = [("1", "X"), ("2", "y"), ("3", None), ("4", "x")]
    listed = [("1", "x"), ("5", "Y"), ("2", "y"), ("6", None), ("7", "X")]
    expected = sorted(
        {(o, e) for (o, d), (e, ed) in itertools.product(orbits, listed) if o == e or (d and ed and d.lower() == ed.lower())}
        | {(e, e) for e, _ in listed}
    )
    got = matching.risk_list_matches(
        spark.createDataFrame(orbits, "asteroid_id STRING, designation STRING"),
        spark.createDataFrame(listed, "asteroid_id STRING, esa_designation STRING"),
    )
    assert sorted((r.asteroid_id, r.esa_id) for r in got.collect()) == expected
    assert "NestedLoop" not in plan_of(got)


def like(text, pattern):
    import re

    return re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), text, re.I | re.S)


@pytest.mark.parametrize("wildcards", [True, False])
def test_first_containing_equals_brute_force(spark, wildcards):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abAB 1") for _ in range(rng.randint(0, 12)))) for i in range(80)]
    queries = ["", "a", "AB", "ab1", "b 1a", "abab", "%", "a%1", "_b_a", "zz", "bA 1", "1%b%a", "a_"]
    queries += ["".join(rng.choice("ab 1") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    got = matching.first_containing(
        spark.createDataFrame(texts, "id INT, label STRING"), spark.createDataFrame([(q,) for q in queries], "q STRING"),
        "label", "q", ("id",), wildcards,
    )
    hit = (lambda t, q: like(t, q)) if wildcards else (lambda t, q: q.lower() in t.lower())
    expected = {q: min(i for i, t in texts if hit(t, q)) for q in queries if any(hit(t, q) for _, t in texts)}
    assert {r.q: r.id for r in got.collect()} == expected
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cascade_levels(spark):
    orbits = spark.createDataFrame([("1", "d1", "s1"), ("2", "q", "s2"), ("3", "q", "9")], "asteroid_id STRING, designation STRING, spkid STRING")
    risks = spark.createDataFrame([("5", "r5", "Risky One"), ("4", "q", "Risky Two")], "asteroid_id STRING, designation STRING, fullname STRING")
    approaches = spark.createDataFrame([("9", "Risky Name"), ("8", "Other name"), ("7", None)], "asteroid_id STRING, name STRING")
    asked = ["1", "q", "s2", "r5", "risky", "other", "9", "7", "nothing", "NAME"]
    got = cascade.identifier_cascade(
        spark.createDataFrame([(q,) for q in asked], "query STRING"), orbits, risks, approaches
    )
    assert {r.query: (r.level, r.asteroid_id) for r in got.collect()} == {
        "1": (1, "1"), "q": (2, "2"), "s2": (2, "2"), "r5": (3, "5"), "risky": (3, "4"), "other": (4, "8"),
        "9": (2, "3"), "7": (4, "7"), "nothing": (None, None), "NAME": (4, "8"),
    }


# --- lists ------------------------------------------------------------------------------------

def test_watchlist_order(spark):
    rows = [("a", 0.1, 1, 0), ("b", 0.5, 0, 1), ("a", 0.5, 9, 2), ("c", None, None, 3), ("b", 0.5, 7, 4)]
    df = spark.createDataFrame(rows, "designation STRING, impact_probability DOUBLE, torino_scale INT, n INT")
    got = watch.top_watchlist(df, "n").collect()
    assert [(r.designation, r.impact_probability, r.torino_scale, r.torino_band) for r in got] == [
        ("a", 0.5, 9, "8+"), ("b", 0.5, 0, "0"), ("c", None, None, "0"),
    ]


def approaches_for_search(spark, n):
    rows = [(f"{i:02d}", f"{i} Ring", dt.date(2026, 1, 1 + j), 1.0 * j, i, False, 1.0) for i in range(n) for j in range(2)]
    return spark.createDataFrame(
        rows, "asteroid_id STRING, name STRING, close_approach_date DATE, miss_distance_km DOUBLE,"
        " epoch_date_close_approach INT, is_potentially_hazardous BOOLEAN, estimated_diameter_km_max DOUBLE",
    )


@pytest.mark.parametrize("n, expected", [(3, 4), (5, 5), (20, 10)])
def test_search_fills_up_from_the_catalogue(spark, n, expected):
    orbits = spark.createDataFrame([("x", "ring", "s", "Ring", True)], "asteroid_id STRING, designation STRING, spkid STRING, fullname STRING, is_pha BOOLEAN")
    got = search.object_search(approaches_for_search(spark, n), orbits, "RING").collect()
    assert len(got) == expected
    assert [r.source for r in got].count("jpl_sbdb") == (1 if n < 5 else 0)
    assert all(r.close_approach_date == dt.date(2026, 1, 2) for r in got if r.source == "local_db")


def test_search_wildcards(spark):
    orbits = spark.createDataFrame([], "asteroid_id STRING, designation STRING, spkid STRING, fullname STRING, is_pha BOOLEAN")
    approaches = approaches_for_search(spark, 4)
    assert search.object_search(approaches, orbits, "1%ring").count() == 1
    assert search.object_search(approaches, orbits, "1%ring", escape=True).count() == 0


def test_worklist(spark):
    as_of = dt.datetime(2026, 1, 31)
    orbits = spark.createDataFrame([("a", dt.datetime(2026, 1, 1)), ("b", dt.datetime(2026, 1, 30)), ("c", dt.datetime(2026, 1, 2))], "asteroid_id STRING, ingestion_time TIMESTAMP")
    approaches = spark.createDataFrame([("a", "old", dt.date(2020, 1, 1)), ("a", "new", dt.date(2021, 1, 1)), ("n", "x", dt.date(2021, 1, 1))], "asteroid_id STRING, name STRING, close_approach_date DATE")
    got = worklist.refresh_worklist(approaches, orbits, as_of).collect()
    assert [(r.asteroid_id, r.name, r.priority) for r in got] == [("a", "new", 0), ("c", None, 0), ("n", "x", 1)]
    assert [r.asteroid_id for r in worklist.refresh_worklist(approaches, orbits, as_of, limit=1).collect()] == ["a"]
    checks = spark.createDataFrame([("a", dt.datetime(2026, 1, 30))], "asteroid_id STRING, last_checked_at TIMESTAMP")
    assert [r.asteroid_id for r in worklist.refresh_worklist(approaches, orbits, as_of, checks=checks).collect()] == ["c", "n"]


# --- windows -------------------------------------------------------------------------------------

@pytest.mark.parametrize("days", [1, 6, 7, 8, 20, 365])
def test_calendar_covers_the_range_once(spark, days):
    start = dt.date(2025, 12, 20)
    rows = windows.window_calendar(spark, start, start + dt.timedelta(days=days - 1)).orderBy("window_start").collect()
    covered = [r.window_start + dt.timedelta(days=k) for r in rows for k in range((r.window_end - r.window_start).days + 1)]
    assert covered == [start + dt.timedelta(days=k) for k in range(days)]


def test_delta_calendar(spark):
    rows = windows.delta_calendar(spark, dt.date(2026, 1, 10)).orderBy("window_start").collect()
    assert (rows[0].window_start, rows[-1].window_end, len(rows)) == (dt.date(2026, 1, 9), dt.date(2026, 1, 24), 3)


def ledger(spark, *rows):
    return spark.createDataFrame(
        [(dt.date(2026, 1, a), dt.date(2026, 1, b), s, n) for a, b, s, n in rows],
        "window_start DATE, window_end DATE, status STRING, attempt INT",
    )


def test_planned_windows(spark):
    calendar = windows.window_calendar(spark, dt.date(2026, 1, 1), dt.date(2026, 1, 28))
    known = ledger(spark, (1, 7, "SUCCESS", 1), (8, 10, "SUCCESS", 1), (15, 21, "FAILED", 2))
    holds = spark.createDataFrame(
        [(dt.date(2026, 1, 15), dt.date(2026, 1, 21), dt.datetime(2026, 3, 1)), (dt.date(2026, 1, 22), dt.date(2026, 1, 28), dt.datetime(2026, 1, 1))],
        "window_start DATE, window_end DATE, not_found_until TIMESTAMP",
    )
    got = windows.plan_windows(calendar, known, holds, dt.datetime(2026, 2, 1)).orderBy("window_start").collect()
    assert [(r.window_start.day, r.status, r.attempt) for r in got] == [(8, "PENDING", 1), (15, "SKIPPED", 2), (22, "PENDING", 1)]


def test_outcomes(spark):
    known = ledger(spark, (1, 7, "PENDING", 1), (8, 14, "PENDING", 2))
    outcomes = spark.createDataFrame(
        [(dt.date(2026, 1, 1), dt.date(2026, 1, 7), "RETRY", None, None), (dt.date(2026, 1, 8), dt.date(2026, 1, 14), "RETRY", None, None),
         (dt.date(2026, 1, 15), dt.date(2026, 1, 21), "NOT_FOUND", None, None), (dt.date(2026, 1, 22), dt.date(2026, 1, 28), "ERROR", None, "boom")],
        "window_start DATE, window_end DATE, outcome STRING, records BIGINT, error STRING",
    )
    rows, holds = windows.apply_outcomes(known, outcomes, dt.datetime(2026, 2, 1))
    assert [(r.status, r.error) for r in rows.orderBy("window_start").collect()] == [
        ("PENDING", None), ("FAILED", "Rate limited on retry"), ("SKIPPED", None), ("FAILED", "boom"),
    ]
    assert [(r.window_start.day, r.not_found_until) for r in holds.collect()] == [(15, dt.datetime(2026, 3, 3))]
    assert windows.retryable(ledger(spark, (1, 7, "FAILED", 2), (8, 14, "FAILED", 3))).count() == 1


def test_latest_run(spark):
    df = spark.createDataFrame([("run_1",), ("run_3",), ("zzz",)], "run_id STRING")
    assert windows.latest_run(df).first().run_id == "run_3"


# --- plans ---------------------------------------------------------------------------------------

def test_no_python_workers_or_nested_loops(spark, small):
    import __spark_entry__ as driver

    for name in ("daily_metrics", "object_profile", "cad_enriched", "resolve_profiles", "change_detection", "profile_document"):
        plan = plan_of(driver.queries()[name](spark, small))
        for word in ("NestedLoop", "Cartesian", "Python", "Arrow"):
            assert word not in plan, (name, word)


def test_views_by_name(spark, small):
    import __spark_entry__ as driver
    from nearpass.plans import views

    rows = driver.queries()["sql_views"](spark, small).collect()
    assert {r.what for r in rows} == {"days", "profiles", "watched", "passages", "classes", "years"}
    assert set(views.TABLES) >= {"close_approaches", "agency_cad"}


def test_documents_leave_out_absent_agencies(spark):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    passages = spark.createDataFrame([("1", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(60)], "asteroid_id STRING, approach_date DATE, distance_au DOUBLE")
    targets = spark.createDataFrame([("1", "asked")], "asteroid_id STRING, designation STRING")
    documents = profiles.profile_documents(targets, empty("asteroid_id STRING"), empty("asteroid_id STRING"), empty("asteroid_id STRING"), passages)
    row = documents.first()
    assert row.name == "asked" and row.agencies.jpl_sbdb is None and row.is_neo is None
    assert row.agencies.jpl_cad["count"] == 50 and row.agencies.jpl_cad.approaches[0].date == "2000-02-29"
    text = profiles.to_json_documents(documents).first().document
    assert "jpl_sbdb" not in text and "jpl_cad" in text


# --- hot keys --------------------------------------------------------------------------------------

def test_hot_keys_keep_results_whole(spark):
    """A third of all rows under one key, one name or one designation."""
    n = 3000
    ids = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), (F.col("id") % 500).cast("string")))
    rows = spark.range(n).select(
        ids.alias("asteroid_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("close_approach_date"),
        F.lit("Same Name").alias("name"),
        F.col("id").alias("epoch_date_close_approach"),
        F.col("id").cast("double").alias("miss_distance_km"),
    )
    latest = {r.asteroid_id: r.epoch_date_close_approach for r in profiles.latest_approaches(rows).collect()}
    by_hand = {}
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"o{i % 500}"
        place = (i % 900, -i)
        if key not in by_hand or place > by_hand[key]:
            by_hand[key] = place
    assert latest == {k: -v[1] for k, v in by_hand.items()}

    objects = rows.select("asteroid_id", F.lit("Same Name").alias("name")).distinct()
    orbits = spark.createDataFrame([(0, "x", "D", "1", "same name")], "row_no INT, asteroid_id STRING, designation STRING, spkid STRING, name STRING")
    hits = resolve.resolve_orbits(resolve.with_candidates(objects), resolve.orbit_refs(orbits, "row_no", "asteroid_id"))
    assert hits.filter("sbdb.ref.id = 'x'").count() == objects.count()

    passages = rows.select("asteroid_id", F.col("close_approach_date").alias("approach_date"), F.lit(0.1).alias("distance_au"))
    risks = spark.createDataFrame([("hot", "active")], "asteroid_id STRING, status STRING")
    none = spark.createDataFrame([], "asteroid_id STRING")
    rich = profiles.enriched_passages(passages, none, risks, none)
    assert rich.count() == n and rich.filter("on_sentry_watchlist").count() == n // 3


def test_of_list_keys_with_one_bare_spelling_the_first_counts(spark):
    listed = spark.createDataFrame([(1, "2020 AB"), (2, "2020AB"), (3, "2020 A B")], "line INT, key STRING")
    refs = {(r.catalogue, r.key): r.ref.id for r in resolve.risk_list_refs(listed, ("line",)).collect()}
    assert refs == {("esa", k): k for k in ("2020 AB", "2020AB", "2020 A B")} | {("esa_bare", "2020AB"): "2020 AB"}
