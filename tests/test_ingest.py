"""Measured ingest, rejected rows, arrival inside files, bounds of batches, second pass of the resolution, large documents."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from nearpass.functions.hashing import record_hash
from nearpass.operators import cascade, matching, resolve
from nearpass.plans import metrics, search
from nearpass.schemas import APPROACH
from nearpass.sinks import publish
from nearpass.sinks.changelog import KeyedTable
from nearpass.sources import matrix
from nearpass.sources.approaches import parse_messages, read_message_stream, split_malformed
from nearpass.streaming import agency_stream, approach_stream
from nearpass.streaming.measures import IngestLog, offsets_behind


def message(day, object_id, name="n", km="5"):
    passes = [{"orbiting_body": "Earth", "miss_distance": {"kilometers": km}}]
    return json.dumps({"date": day, "asteroid": {"id": object_id, "name": name, "close_approach_data": passes}})


def land(folder, number, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{number}.txt").write_text("\n".join(lines) + "\n")


def run(spark, tmp_path, name, messages, **options):
    table = KeyedTable(spark, str(tmp_path / name), APPROACH).create()
    approach_stream.start(messages, table, str(tmp_path / f"{name}-ckpt"), once=True, **options).awaitTermination()
    return table


def test_measured_batches_rejects_and_triggers(spark, tmp_path):
    land(tmp_path / "in", 0, message("2026-01-01", "a"), message("2026-01-01", "b"), message("2026-13-01", "c"), "{cut")
    land(tmp_path / "in", 1, message("2026-01-01", "a", "m"), message("2026-01-01", "b"), message("2026-01-02T00", None), message(None, "d"))
    land(tmp_path / "in", 2, "{}")
    for i in range(3):
        os.utime(tmp_path / "in" / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    log = IngestLog(spark, str(tmp_path / "log")).create()
    assert log.batches().count() == log.triggers().count() == 0
    listener = log.watch()
    try:
        messages = read_message_stream(spark, "text", 1, path=str(tmp_path / "in"))
        table = run(
            spark, tmp_path, "t", messages, quarantine=str(tmp_path / "bad"), rejects=str(tmp_path / "rejects"), log=log
        )
        for _ in range(60):  # progress reports arrive a little later
            if log.triggers().filter("n_input_rows > 0").count() >= 3:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    rows = {(r.batch_id, r.source): r for r in log.batches().collect()}
    assert {k: (r.n_messages, r.n_malformed) for k, r in rows.items() if k[1] == "messages"} == {
        (0, "messages"): (4, 1), (1, "messages"): (4, 0), (2, "messages"): (1, 1),
    }
    name = APPROACH.name
    assert [(r.n_rows, r.n_rejected, r.n_inserted, r.n_updated) for r in (rows[n, name] for n in range(3))] == [
        (3, 1, 2, 0), (4, 2, 0, 1), (0, 0, 0, 0),
    ]
    history = {(r.batch_id, r.change_type): r["count"] for r in table.history().groupBy("batch_id", "change_type").count().collect()}
    assert history == {(0, "INSERT"): 2, (1, "UPDATE"): 1}
    rejects = spark.read.parquet(f"{tmp_path}/rejects/{name}").collect()
    assert sorted(sorted(r.faults.items()) for r in rejects) == [
        [("asteroid_id", "missing"), ("close_approach_date", "unreadable")], [("close_approach_date", "missing")],
        [("close_approach_date", "unreadable")],
    ]
    assert {json.loads(r.row).get("asteroid_id") for r in rejects} == {None, "c", "d"}
    total = {r.source: r for r in log.totals().collect()}
    assert total[name].n_inserted + total[name].n_updated == 3 and total["messages"].throughput > 0
    triggers = log.triggers().filter("n_input_rows > 0").collect()
    assert len(triggers) >= 3 and all(json.loads(r.end_offset) and r.seconds > 0 for r in triggers)


def test_agency_log_and_rejects(spark, tmp_path):
    good = {"asteroid_id": "1", "agencies": {"sbdb": {"designation": "x"}, "cad": [{"approach_date": "2026-01-01", "body": "Moon"}, {"approach_date": "soon", "body": "Moon"}]}}
    land(tmp_path / "in", 0, json.dumps(good), '{"asteroid_id": ')
    tables = agency_stream.create_tables(spark, str(tmp_path / "tables"))
    log = IngestLog(spark, str(tmp_path / "log")).create()
    messages = agency_stream.read(spark, "text", path=str(tmp_path / "in"))
    agency_stream.start(messages, tables, str(tmp_path / "ckpt"), once=True, rejects=str(tmp_path / "rejects"), log=log).awaitTermination()
    rows = {r.source: r for r in log.batches().collect()}
    assert (rows["messages"].n_messages, rows["messages"].n_malformed) == (2, 1)
    assert (rows["cad"].n_rows, rows["cad"].n_rejected, rows["cad"].n_inserted) == (2, 1, 1)
    assert rows["sentry"].n_rows == rows["sentry"].n_inserted == 0
    rejected = spark.read.parquet(f"{tmp_path}/rejects/{tables['cad'].entity.name}").collect()
    assert [r.faults for r in rejected] == [{"approach_date": "unreadable"}]


def test_offsets_behind():
    assert offsets_behind('{"t": {"0": 9, "1": 4}}', '{"t": {"0": 5, "1": 4}}') == 4
    assert offsets_behind('{"t": {"0": 9}}', '{}') == 9
    assert offsets_behind(None, '{"logOffset": 3}') is None and offsets_behind('{"logOffset": 4}', '{"logOffset": 3}') is None


@pytest.mark.parametrize("size", ["200", "128m"])
def test_splits_of_a_file_decide_nothing(spark, tmp_path, size):
    """The nearest of the passes in one file is stored, wherever it stands and however the file is split."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    land(tmp_path / "in", 0, *[message("2026-01-01", "a", km=str(abs(i - 20) + 1)) for i in range(60)])
    for n in names:
        spark.conf.set(n, size)
    try:
        table = run(spark, tmp_path, "t", read_message_stream(spark, "text", path=str(tmp_path / "in")))
        assert [r.miss_distance_km for r in table.current().collect()] == [1.0]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    for i in range(9):
        land(tmp_path / "in", i, *[message("2026-01-01", f"o{i}-{k}") for k in range(200 if i == 0 else 2)])
        os.utime(tmp_path / "in" / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    log = IngestLog(spark, str(tmp_path / "log")).create()
    run(spark, tmp_path, "t", read_message_stream(spark, "text", max_bytes=1500, path=str(tmp_path / "in")), log=log)
    counts = [r.n_messages for r in log.batches().filter("source = 'messages'").orderBy("batch_id").collect()]
    assert counts[0] == 200 and sum(counts) == 216 and len(counts) > 2 and max(counts[1:]) < 16


def test_json_files_keep_the_key(spark, tmp_path):
    rows = [("2026-01-01", "1"), ("2026-01-01", "2"), ("2026-01-02", "1")]
    df = spark.createDataFrame(rows, "date STRING, id STRING")
    publish.publish(publish.to_keyed_json(df, "date"), "json", path=str(tmp_path / "out"))
    raw = read_message_stream(spark, "json", path=str(tmp_path / "out"))
    assert raw.columns[0] == "value"
    stored = spark.read.schema("key STRING, value STRING").json(str(tmp_path / "out"))
    assert sorted((r.key, json.loads(r.value)["id"]) for r in stored.collect()) == sorted(rows)
    files = stored.withColumn("file", F.input_file_name()).groupBy("key").agg(F.count_distinct("file").alias("n")).collect()
    assert {r.n for r in files} == {1}


def test_good_and_rejected_rows_add_up(spark):
    lines = [message(day, key) for day in ("2026-01-01", "2026-02-30", None) for key in ("a", "b", None)]
    raw = spark.createDataFrame([(x, 0, 0, 0) for x in lines], "value STRING, timestamp INT, partition INT, offset INT")
    good, _ = split_malformed(parse_messages(raw), "asteroid")
    checked = approach_stream.checked_rows(good)
    assert checked.count() == 9
    assert approach_stream.approach_rows(checked).count() == 2
    assert approach_stream.rejected_rows(checked, APPROACH).count() == 7


def test_rows_of_one_payload_are_dealt_out(spark):
    """A payload of 10^6 rows under one header: many tasks type the rows."""
    payload = spark.range(1).select(
        F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("fields"),
        F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda i: F.array(i.cast("string"), F.lit("x"), (i * 2).cast("string"))).alias("data"),
    )
    cells = matrix.matrix_cells(payload, ["a", "b", "c"]).withColumn("task", F.spark_partition_id())
    got = cells.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("tasks"), F.sum(F.col("a").cast("long")).alias("a"),
        F.count("c").alias("c"), F.count_distinct("row_no").alias("places"),
    ).first()
    assert (got.n, got.a, got.c, got.places) == (1_000_000, 1_000_001_000_000, 0, 1_000_000) and got.tasks > 1
    entries = matrix.zip_fields_rows(payload).withColumn("task", F.spark_partition_id())
    got = entries.agg(F.count_distinct("task").alias("tasks"), F.sum(F.size("entry")).alias("cells")).first()
    assert got.cells == 2_000_000 and got.tasks > 1


def test_second_pass(spark):
    """An answer rewrites the candidates; held objects are not asked, and later identifiers are no tries."""
    objects = [("1", "1 Alpha (2001 AB1)"), ("2", "2 Beta"), ("3", "3 Gamma"), ("4", "4 Delta"), ("5", "5 Known")]
    objects = spark.createDataFrame(objects, "asteroid_id STRING, name STRING")
    orbits = spark.createDataFrame([(1, "5", "5", None, "s5")], "row_no INT, asteroid_id STRING, designation STRING, name STRING, spkid STRING")
    active = spark.createDataFrame([(1, "New 1"), (2, "sp2")], "row_no INT, designation STRING")
    removed = spark.createDataFrame([("delta", "2020")], "key STRING, removed_date STRING")
    passages = spark.createDataFrame([("New 1",), ("5",)], "designation STRING")
    listed = spark.createDataFrame([("new1",)], "key STRING")
    holds = spark.createDataFrame([("3", "JPL_SBDB")], "asteroid_id STRING, source STRING")
    first = resolve.resolve_profiles(objects, orbits, active, removed, passages, listed, holds).cache()
    tries = resolve.open_tries(first, holds)
    assert {r.asteroid_id for r in tries.collect()} == {"1", "2", "4"}
    landed = [
        ("1", 404, 0, "{}", False, None, None), ("2001 AB1", 200, 0, "{}", True, "old", "x"), ("2001 AB1", 200, 1, "{}", True, "New 1", ""),
        ("1 Alpha", 200, 0, "{}", True, "never asked", None), ("2", 200, 0, "{}", True, None, " sp2 "), ("3", 200, 0, "{}", True, "x", "x"),
        ("4", 200, 0, "{cut", False, None, None),
    ]
    schema = "lookup_value STRING, http_status INT, checked_at INT, body STRING, has_document BOOLEAN, designation STRING, spkid STRING"
    tried = resolve.answered_tries(tries, spark.createDataFrame(landed, schema)).cache()
    assert sorted((r.asteroid_id, r.try_no, r.is_answer) for r in tried.collect()) == [("1", 0, False), ("1", 1, True), ("2", 0, True), ("4", 0, False)]
    final = resolve.resolve_again(first, tried, active, removed, passages, listed, holds)
    rows = {r.asteroid_id: r for r in final.collect()}
    assert len(rows) == 5
    one = rows["1"]
    assert (one.answered_by, one.candidates[0], one.sentry_status, one.cad_designation, one.on_risk_list) == ("2001 AB1", "New 1", "active", "New 1", True)
    assert (rows["2"].candidates[-1], rows["2"].sentry_status) == ("sp2", "active")
    assert (rows["3"].answered_by, rows["4"].answered_by, rows["5"].sbdb_id, rows["5"].cad_designation) == (None, None, "5", "5")


def test_queries_without_letters_form_no_pair(spark):
    texts = [(f"{i:03}", "x" * (i % 9), i) for i in range(60)] + [("900", "50% of_it", 1), ("901", None, 1)]
    names = spark.createDataFrame(texts, "asteroid_id STRING, label STRING, n INT")
    asked = ["%", "%%%", "_", "_" * 8, "_%_" * 3, "_" * 9, "_" * 10, "\\%", "\\_", "0\\%%", "\\\\", "", None]
    queries = spark.createDataFrame([(x,) for x in asked], "query STRING")
    got = {r.query: r.asteroid_id for r in matching.first_containing(names, queries, "label", "query", ("asteroid_id",)).collect()}
    assert got == {
        "%": "000", "%%%": "000", "": "000", "_": "001", "_" * 8: "008", "_%_" * 3: "006", "_" * 9: "900", "\\%": "900", "\\_": "900", "0\\%%": "900",
    }


def test_cascade_outcomes(spark):
    found = spark.createDataFrame([("a", 1, "7"), ("x y", None, None), ("SP1", None, None), ("gone", None, None)], "query STRING, level INT, asteroid_id STRING")
    catalogue = spark.createDataFrame([("D2", "X Y", None, "s"), ("D1", None, "short", "sp1"), ("a", "A", None, "")], "designation STRING, fullname STRING, shortname STRING, spkid STRING")
    rows = {r.query: (r.outcome, r.catalogue_designation, r.catalogue_name) for r in cascade.with_outcome(found, catalogue).collect()}
    assert rows == {"a": ("ingested", None, None), "x y": ("catalogue_only", "D2", "X Y"), "SP1": ("catalogue_only", "D1", "short"), "gone": ("pending", None, None)}


def test_record_hashes(spark):
    schema = "m MAP<STRING, STRING>, a ARRAY<STRING>, s STRUCT<x: STRING, y: STRING>, t STRING, u STRING"
    rows = [
        ({"k": "1", "l": "2"}, ["p", None], ("", None), "b||c", "d"), ({"l": "2", "k": "1"}, ["p", None], ("", None), "b||c", "d"),
        ({"k": "1", "l": "2"}, ["p", None], ("", None), "b", "c||d"), ({"k": "1", "l": "2"}, ["p"], ("", None), "b||c", "d"),
        ({"k": "1", "l": "2"}, ["p", None], (None, ""), "b||c", "d"), ({}, ["p", None], ("", None), "b||c", "d"),
        (None, None, None, None, None), (None, [], None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    hashes = [r.h for r in df.select(record_hash(df).alias("h")).collect()]
    assert hashes[0] == hashes[1] and len(set(hashes)) == len(hashes) - 1


def test_sketches_of_years(spark):
    rows = [(dt.date(2020 + i % 3, 1, 1), str(i % 700)) for i in range(3000)]
    df = spark.createDataFrame(rows, "close_approach_date DATE, asteroid_id STRING")
    parts = [metrics.object_sketches(df.filter(F.hash("asteroid_id") % 2 == k)) for k in (0, 1, -1)]
    merged = metrics.merge_sketches(metrics.merge_sketches(parts[0], parts[1]), parts[2])
    row = metrics.estimated_objects(merged).first()
    assert row.total_records == 3000 and abs(row.unique_asteroids - 700) < 35
    assert metrics.estimated_objects(merged, 2021, 2021).first().total_records == 1000
    assert metrics.estimated_objects(merged, 1900, 1901).first().unique_asteroids == 0


def test_catalogue_hits_have_a_name(spark):
    rows = [("d1", "s1", "Full One", "one"), ("d2", "s2", None, "two"), ("d3", "s3", "", None)]
    orbits = spark.createDataFrame(rows, "designation STRING, spkid STRING, fullname STRING, shortname STRING").withColumn("is_pha", F.lit(None).cast("boolean"))
    assert [search.catalogue_hit(orbits, q).first().name for q in ("D1", "s2", "s3")] == ["Full One", "two", "s3"]
    assert search.catalogue_hit(orbits.drop("shortname"), "d2").first().name == "d2"
