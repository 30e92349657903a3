"""Compaction: the same rows before and after, in fewer files, whatever happens on the way."""

import glob
import os
from datetime import date, timedelta

from conftest import T0, listed
from pyspark.sql import functions as F

from spanloom.functions.skew import one_of_each, shared_folder
from spanloom.sources import compaction
from spanloom.sources.deltas import counter_deltas
from spanloom.sources.tables import compact, read_points, read_summaries, read_telemetry, write_telemetry
from spanloom.streaming import ingest
from spanloom.streaming.ingest import merge_points

DAY = 86_400
LATER = (T0 + timedelta(days=9)).date()


def files(root, table):
    return len(glob.glob(f"{root}/{table}/writer=*/batch=*/event_date=*/*.parquet"))


def test_points_keep_their_increments(spark, raw_points, tmp_path):
    root = str(tmp_path)
    every = raw_points(*[{"t": i * 5000, "v": float(i % 7), "a": {"session.id": f"s{i % 3}"}} for i in range(60)])
    want = listed(counter_deltas(every), "id", "value_delta")
    parts = [every.where(F.pmod("id", F.lit(4)) == k) for k in range(4)]
    for k in (0, 1):
        merge_points(parts[k], root, k)
    before, many = listed(read_points(spark, root), "id", "value_delta"), files(root, "points")
    days = compact(spark, root, "points", LATER)
    assert len(days) == 4 and listed(read_points(spark, root), "id", "value_delta") == before
    assert compact(spark, root, "points", LATER) == []
    merge_points(parts[2], root, 2)  # between compaction and clearing up, also into days that were rewritten
    assert compaction.vacuum(spark, root, "points") == 8 and compaction.vacuum(spark, root, "points") == 0
    compaction.vacuum(spark, root, "point_fixes")
    merge_points(parts[3], root, 3)
    merge_points(parts[3], root, 3)
    assert listed(read_points(spark, root), "id", "value_delta") == want
    compact(spark, root, "points", LATER)
    compaction.vacuum(spark, root, "points")
    compaction.vacuum(spark, root, "point_fixes")
    assert listed(read_points(spark, root), "id", "value_delta") == want and files(root, "points") < many
    assert compaction.places(spark, root, "point_fixes") == []
    lives = read_summaries(spark, root).session_lives()
    assert lives.agg(F.round(F.sum("cost_usd"), 6)).first()[0] == counter_deltas(every).agg(F.round(F.sum("value_delta"), 6)).first()[0]


def test_spans_delivered_again_count_once(spark, spans, tmp_path):
    root, rows = str(tmp_path), spans(*[{"s": f"s{i}", "t": i * 1000} for i in range(20)])
    for batch in range(3):
        write_telemetry(rows, root, "spans", batch)
    assert read_telemetry(spark, root, "spans").count() == 60
    assert compact(spark, root, "spans", date(2000, 1, 1)) == []
    assert compact(spark, root, "spans", LATER) == [str(T0.date())]
    assert read_telemetry(spark, root, "spans").count() == 20
    write_telemetry(spans({"s": "new", "t": 5}), root, "spans", 9)
    assert read_telemetry(spark, root, "spans").count() == 21


def test_a_snapshot_without_its_manifest_is_not_read(spark, spans, tmp_path):
    root, rows = str(tmp_path), spans(*[{"s": f"s{i}"} for i in range(5)])
    for batch in range(2):
        write_telemetry(rows.where(F.col("id") % 2 == batch), root, "spans", batch)
    write_telemetry(rows, root, "spans", 0, f"{compaction.SNAPSHOT}1")  # as left by a compaction that was stopped
    assert read_telemetry(spark, root, "spans").count() == 5
    compact(spark, root, "spans", LATER)
    assert read_telemetry(spark, root, "spans").count() == 5
    assert compaction.vacuum(spark, root, "spans") >= 2 and read_telemetry(spark, root, "spans").count() == 5


def test_ids_that_occur_once_are_not_dealt_again(spark):
    once = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, text string")
    assert one_of_each(once) is once
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "id long, text string")
    assert sorted(map(str, one_of_each(twice).collect())) == sorted(map(str, once.collect()))


def test_merging_and_storing_increments_leave_no_scratch(spark, raw_points, tmp_path):
    root, folder = str(tmp_path), shared_folder(spark)
    before = set(os.listdir(folder))
    rows = raw_points({"v": 1.0}, {"v": 3.0, "t": 60})
    ingest.merge_points(rows.where("id = 0"), root, 0)
    ingest.merge_points(rows.where("id = 1"), root, 1)
    stream = rows.first().stream_id
    changes = spark.createDataFrame([(stream, 1, int(rows.where("id = 1").first().timestamp.timestamp() * 1e6), 2.0, "insert")],
                                    "stream_id string, id long, at long, value_delta double, change string")
    ingest.store_increments(changes, root, 0, "stream")
    assert sorted((r.id, r.value_delta) for r in read_points(spark, root).collect()) == [(0, 1.0), (1, 2.0)]
    assert not set(os.listdir(folder)) - before
