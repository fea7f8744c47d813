"""What large tables need: compressed messages, one shuffle where one is enough, no broadcast by the size of files."""

import datetime as dt
import json
import re
import threading
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import functions as F

from nearpass.checks import registry
from nearpass.operators import keyed, lookup, resolve
from nearpass.schemas import APPROACH, ORBIT
from nearpass.sinks import changelog, publish
from nearpass.sinks.changelog import KeyedTable
from nearpass.sources import approaches as feed
from nearpass.sources.bridge import LAYOUTS
from nearpass.streaming import agency_stream, approach_stream

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DAY = dt.datetime(1997, 3, 1)


def tables(spark, folder):
    """Three objects, two of them with several passes on one day, over two documents."""
    lines = [(order, part, 1, line, 1.0 + line, 10.0 * line, 0.1, 0.0, "R", "F", DAY + dt.timedelta(days=order % 3))
             for order in (1, 2, 3, 500) for line, part in ((1, 1), (2, 2), (3, 1), (7, 3))]
    parts = [(k, f"name {k}", "b", "t", 7 * k, 1.0) for k in (1, 2, 3)]
    for name, rows in (("lineitem", lines), ("part", parts)):
        spark.createDataFrame(rows, LAYOUTS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def initial_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def message(day, key):
    one = {"epoch_date_close_approach": 1.0, "orbiting_body": "Earth"}
    return json.dumps({"date": day, "asteroid": {"id": key, "close_approach_data": [one]}})


def test_published_files_are_compressed(spark, tmp_path):
    df = spark.range(2000).select(F.lit("2026-01-01").alias("date"), F.repeat(F.lit("the same text "), 20).alias("text"), "id")
    keyed_rows = publish.to_keyed_json(df, "date")
    for fmt in ("text", "json"):
        publish.publish(keyed_rows, fmt, path=str(tmp_path / fmt))
        files = [f for f in Path(tmp_path / fmt).iterdir() if f.name.startswith("part-")]
        assert sum(f.stat().st_size for f in files) < 2000 * 14 * 20 / 5
    texts = spark.read.text(str(tmp_path / "text")).collect()
    assert sorted(r.value for r in texts) == sorted(r.value for r in keyed_rows.collect())
    assert spark.read.schema("key STRING, value STRING").json(str(tmp_path / "json")).count() == 2000


def test_feed_days_shuffles_documents_once(spark, tmp_path):
    found = registry.QUERIES["feed_days"](spark, tables(spark, tmp_path))
    # The lists by day and by document need no shuffle of their own.
    assert len(re.findall(r"Exchange hashpartitioning\(document", initial_plan(found)[1].split("Initial Plan")[-1])) == 1
    rows = {(r.day, r.asteroid_id): (r.n_messages, r.miss_km) for r in found.collect()}
    assert rows[(dt.date(1997, 3, 2), "1")] == (2, 40000.0) and rows[(dt.date(1997, 3, 3), "2")] == (2, 40000.0)
    assert sum(n for n, _ in rows.values()) == 16 and len(rows) == 9


def test_upsert_starts_from_one_computation(spark, tmp_path, monkeypatch):
    calls, dedupe = [], keyed.dedupe_approaches
    monkeypatch.setattr(keyed, "dedupe_approaches", lambda df: calls.append(1) or dedupe(df))
    found = registry.QUERIES["upsert_current"](spark, tables(spark, tmp_path)).collect()
    assert len(calls) == 1
    # Nine keys; three of them come again under a new id, three with another body.
    assert len(found) == 12 and sum(r.asteroid_id.startswith("N") for r in found) == 3
    assert sum(r.orbiting_body == "Moon" for r in found) == 3


def test_indexes_are_not_broadcast(spark, tmp_path):
    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    objects = spark.createDataFrame([("a", ["k1", "k2"])], "asteroid_id STRING, candidates ARRAY<STRING>")
    records = stored(spark.createDataFrame([("k2", "x")], "key STRING, id STRING"), "records")
    index = lookup.key_index(records, F.col("key"), F.struct("id"), ("id",), "c")
    found = lookup.lookup_first(objects, index, {"c": (lambda c: c,)})
    assert "Broadcast" not in initial_plan(found)[0] and found.first().c.ref.id == "x"
    tries = spark.createDataFrame([("a", 0, "v")], "asteroid_id STRING, try_no INT, lookup_value STRING")
    landed = spark.createDataFrame([("v", 200, True, 1)], "lookup_value STRING, http_status INT, has_document BOOLEAN, checked_at INT")
    made = resolve.answered_tries(tries, stored(landed, "landed"))
    assert "Broadcast" not in initial_plan(made)[0] and made.first().is_answer


def test_texts_of_good_messages_are_not_kept(spark):
    lines = [message("2026-01-01", "a"), "{broken", '{"date": "2026-01-01"}']
    raw = spark.createDataFrame([(x,) for x in lines], "value STRING")
    judged = feed.with_verdict(feed.parse_messages(raw), "asteroid")
    kept = feed.without_texts(judged)
    assert {(r.verdict, r.value) for r in kept.collect()} == {(None, None), ("malformed", lines[1]), ("no asteroid", lines[2])}
    assert sorted(feed.quarantined(kept).collect()) == sorted(feed.quarantined(judged).collect())


def test_streams_free_their_shuffles(spark):
    session = spark.newSession()
    raw = session.createDataFrame([], "value STRING, timestamp INT, partition INT, offset INT")
    approach_stream.process_batch(None)(raw, 0)
    assert session.conf.get(FREED) == "true" and spark.conf.get(FREED) != "true"


def test_agency_tables_are_written_side_by_side(spark, tmp_path, monkeypatch):
    met = threading.Barrier(5)
    monkeypatch.setattr(agency_stream, "store_part", lambda *_: met.wait(20))
    tables = agency_stream.create_tables(spark, str(tmp_path))
    raw = spark.newSession().createDataFrame([('{"asteroid_id": "a"}', 0, 0, 0)], "value STRING, timestamp INT, partition INT, offset INT")
    agency_stream.process_batch(tables)(raw, 0)
    assert met.n_waiting == 0 and not met.broken


def raw_messages(session, *lines):
    return session.createDataFrame([(x, 0, "f", 0) for x in lines], "value STRING, timestamp INT, partition STRING, offset INT")


def test_approach_batches_are_parsed_once_and_kept_on_disk(spark, tmp_path, monkeypatch):
    levels, frame = [], type(spark.range(0))
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *level: levels.append(level) or persist(self, *level))
    table = KeyedTable(spark, str(tmp_path / "t"), APPROACH).create()
    run = approach_stream.process_batch(table, str(tmp_path / "bad"))
    run(raw_messages(spark.newSession(), message("2026-01-01", "a"), "{broken", message("2026-01-02x", "a")), 0)
    assert levels == [(StorageLevel.DISK_ONLY,)]
    assert [r.asteroid_id for r in table.current().collect()] == ["a"]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "bad/epoch=0/batch_id=0")).collect()] == [("{broken", "malformed")]
    # Without bad messages an empty table is there, also where the batch ran before.
    run(raw_messages(spark.newSession(), message("2026-01-01", "a")), 0)
    assert spark.read.parquet(str(tmp_path / "bad/epoch=0/batch_id=0")).count() == 0


def test_marked_rows_are_the_rows_of_good_messages(spark):
    lines = [message("2026-01-01", "a"), message(None, "a"), message("2026-01-01", None), message("2026-01-03 ", "a"), "{broken", ""]
    lines += [json.dumps({"date": "2026-01-01", "asteroid": {"id": k, "close_approach_data": x}}) for k, x in (("b", [None]), ("c", []), ("d", None))]
    lines += ['{"date": "2026-01-01"}', '{"date": "2026-01-01", "asteroid": {"id": "e", "name": 7, "close_approach_data": [{}, {}]}, "more": 1}', '[1', "null"]
    judged = feed.with_verdict(feed.parse_messages(raw_messages(spark, *lines)), "asteroid")
    plain = approach_stream.approach_rows(approach_stream.checked_rows(judged.filter("verdict IS NULL")))
    marked = approach_stream.approach_rows(approach_stream.marked_rows(judged), ("__bad",))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(marked.filter("NOT __bad").drop("__bad")) == rows(plain) and {r.asteroid_id for r in plain.collect()} == {"a", "b", "e"}
    assert marked.filter("__bad").count() == 1


def test_the_epoch_is_looked_up_once(spark, tmp_path, monkeypatch):
    calls, epoch_of = [], KeyedTable.epoch_of
    monkeypatch.setattr(KeyedTable, "epoch_of", lambda self, query: calls.append(query) or epoch_of(self, query))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "metadata").write_text('{"id": "q"}')
    table = KeyedTable(spark, str(tmp_path / "t"), APPROACH).create()
    run = approach_stream.process_batch(table, checkpoint=str(tmp_path / "c"))
    for number, day in enumerate(("2026-01-01", "2026-01-02")):
        run(raw_messages(spark.newSession(), message(day, "a")), number)
    assert calls == ["q"] and table.current().count() == 2


def test_stored_rows_read_the_log_once(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), APPROACH).create()
    rows = lambda *names: APPROACH.conform(
        spark.createDataFrame([(dt.date(2026, 1, 1), k, n) for k, n in names], "close_approach_date DATE, asteroid_id STRING, name STRING")
    )
    for number, names in enumerate(([("a", "1"), ("b", "1")], [("a", "2")], [("a", "3"), ("c", "1")])):
        table.apply(rows(*names), number)
        if number == 1:
            assert table.compact() == 0
    batch = table._with_year(rows(("a", ""), ("b", ""), ("d", "")))
    for before, expected in (((0, 2), [("a", "2"), ("b", "1")]), ((0, 3), [("a", "3"), ("b", "1")])):
        stored = table.stored_rows(batch, before)
        assert sorted((r.asteroid_id, r.name) for r in stored.collect()) == expected
        assert len(re.findall(r"FileScan parquet", initial_plan(stored)[0])) == 2


def test_long_hash_expressions_are_made_once(spark, tmp_path, monkeypatch):
    calls, made = [], changelog.record_hash
    monkeypatch.setattr(changelog, "record_hash", lambda *args: calls.append(1) or made(*args))
    table = KeyedTable(spark, str(tmp_path / "o"), ORBIT, record_hashes=True).create()
    for number, designation in enumerate("xyy"):
        table.apply(ORBIT.conform(spark.createDataFrame([("1", designation)], "asteroid_id STRING, designation STRING")), number)
    assert len(calls) == 1 and sorted((r.batch_id, r.change_type) for r in table.history().collect()) == [(0, "INSERT"), (1, "UPDATE")]
