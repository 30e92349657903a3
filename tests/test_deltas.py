"""Increments of cumulative counters, in batch, with late rows, and as a stream."""

import random

import pytest
from conftest import listed
from pyspark.sql import functions as F

from spanloom.sources.deltas import apply_repairs, counter_deltas, newest_per_stream, repair_deltas
from spanloom.streaming import stateful
from spanloom.sources.tables import read_points
from spanloom.streaming.ingest import merge_points


def deltas(df):
    return {r.id: r.value_delta for r in df.collect()}


def test_growth_and_reset(points):
    assert deltas(points({"v": 100}, {"v": 250}, {"v": 400}, {"v": 30}, {"v": 30})) == {0: 100, 1: 150, 2: 150, 3: 30, 4: 0}


def test_streams_differ_by_one_attribute(points):
    a, b = {"session.id": "s", "model": "x"}, {"session.id": "s", "model": "y"}
    assert deltas(points({"v": 5, "a": a}, {"v": 7, "a": b}, {"v": 6, "a": a}, {"v": 9, "a": b})) == {0: 5, 1: 7, 2: 1, 3: 2}


def test_equal_times_are_ordered_by_id(points):
    assert deltas(points({"v": 5, "t": 1}, {"v": 8, "t": 1})) == {0: 5, 1: 3}


def test_far_apart_points_of_a_stream(points):
    assert deltas(points({"v": 5, "t": 0}, {"v": 8, "t": 100_000}, {"v": 9, "t": 900_000})) == {0: 5, 1: 3, 2: 1}


def test_late_point_repairs_its_successor(points, raw_points):
    stored = points({"v": 100, "t": 0}, {"v": 400, "t": 20})
    late = raw_points({"v": 250, "t": 10, "id": 7})
    repairs = repair_deltas(stored, late)
    assert deltas(repairs) == {7: 150, 1: 150}
    assert deltas(apply_repairs(stored, repairs)) == {0: 100, 7: 150, 1: 150}


def test_late_reset(points, raw_points):
    stored = points({"v": 100, "t": 0}, {"v": 120, "t": 20})
    assert deltas(repair_deltas(stored, raw_points({"v": 10, "t": 10, "id": 7}))) == {7: 10, 1: 110}


def test_other_streams_are_left_alone(points, raw_points):
    stored = points({"v": 1, "a": {"session.id": "x"}}, {"v": 5})
    assert set(deltas(repair_deltas(stored, raw_points({"v": 9, "t": 50, "id": 7})))) == {7}


def test_newest_per_stream(points):
    df = points({"v": 1, "t": 5}, {"v": 2, "t": 5}, {"v": 9, "a": {"session.id": "x"}})
    assert listed(newest_per_stream(df), "id") == [(1,), (2,)]


def test_a_batch_is_derived_once(spark, raw_points, tmp_path):
    derived = spark.sparkContext.accumulator(0)

    def told(stream):
        derived.add(1)
        return stream

    root = str(tmp_path)
    for n in range(2):
        batch = raw_points(*[{"v": i, "t": 10 * i + 5 * n, "id": 100 * n + i} for i in range(20)])
        merge_points(batch.withColumn("stream_id", F.udf(told)("stream_id")), root, n)
    assert derived.value == 40 and read_points(spark, root).count() == 40


def test_merging_batches_in_any_order_equals_one_batch(spark, raw_points, tmp_path):
    rnd = random.Random(3)
    rows = [{"v": rnd.randrange(100), "t": rnd.randrange(0, 400_000), "id": i, "a": {"session.id": rnd.choice("ab")}} for i in range(60)]
    want = deltas(counter_deltas(raw_points(*rows)))
    root = str(tmp_path)
    rnd.shuffle(rows)
    # The last batch comes twice: once again under its number, and once as a new export.
    for n, part in ((0, rows[:25]), (1, rows[25:40]), (2, rows[40:]), (2, rows[40:]), (3, rows[40:])):
        merge_points(raw_points(*part), root, n)
    assert deltas(read_points(spark, root)) == want


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stateful.ROCKSDB)
    yield
    spark.conf.set(key, before)


def run_stream(spark, build, schema, batches, tmp_path):
    """Feed the batches one by one through files; returns the emitted rows in order."""
    source = tmp_path / "in"
    source.mkdir()
    got = []
    q = (build(spark.readStream.schema(schema).parquet(str(source))).writeStream
         .foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        for i, batch in enumerate(batches):
            batch.coalesce(1).write.parquet(str(tmp_path / f"staged{i}"))
            for f in (tmp_path / f"staged{i}").glob("*.parquet"):
                (source / f"{i}-{f.name}").write_bytes(f.read_bytes())
            q.processAllAvailable()
    finally:
        q.stop()
    return got


def test_stream_equals_batch_with_late_rows(spark, raw_points, rocksdb, tmp_path):
    rows = [{"v": v, "t": t, "id": i} for i, (t, v) in enumerate([(0, 10), (10, 25), (40, 5), (20, 30), (30, 35), (50, 9)])]
    full = raw_points(*rows)
    batches = [full.where(F.col("id").isin(ids)) for ids in ([0, 1, 2], [3], [4, 5])]
    got = run_stream(spark, stateful.stream_deltas, full.schema, batches, tmp_path)
    final = {}
    for r in got:
        final[r.id] = r.value_delta
    assert final == deltas(counter_deltas(full))
    assert {r.change for r in got} == {"insert", "update"}


def test_streams_that_share_a_key_of_the_store(spark, raw_points, rocksdb, tmp_path, monkeypatch):
    """Each keeps its own points; a row without a time leaves the ids of the others whole."""
    monkeypatch.setattr(stateful, "BUCKETS", 1)
    big = 2**60 + 1
    full = raw_points(*[{"v": v, "t": t, "id": big + i, "a": {"session.id": s}} for i, (s, t, v) in enumerate(
        [("a", 0, 10), ("b", 0, 7), ("a", 40, 30), ("b", 20, 9), ("a", 20, 15), ("c", 5, 1)])])
    full = full.withColumn("timestamp", F.when(F.col("session_id") != "c", F.col("timestamp")))
    got = run_stream(spark, stateful.stream_deltas, full.schema, [full.where(F.col("id") < big + 4), full.where(F.col("id") >= big + 4)], tmp_path)
    assert {r.id: r.value_delta for r in got} == deltas(counter_deltas(full))
    assert [r.id - big for r in got if r.change == "update"] == [2] and [r.at for r in got if r.id == big + 5] == [None]


def test_rows_past_the_lateness_ask_for_repair(spark, raw_points, rocksdb, tmp_path):
    full = raw_points({"v": 1, "t": 0}, {"v": 2, "t": 100}, {"v": 9, "t": 500}, {"v": 1, "t": 50})
    batches = [full.where("id < 3"), full.where("id = 3")]
    got = run_stream(spark, lambda df: stateful.stream_deltas(df, lateness_seconds=60), full.schema, batches, tmp_path)
    assert [(r.id, r.change) for r in got if r.change == "repair"] == [(3, "repair")]


def test_trace_status(spark, spans, rocksdb, tmp_path):
    full = spans({"tr": "a", "p": "x", "t": 0}, {"tr": "b", "p": "x", "t": 0}, {"tr": "b", "t": 5}, {"tr": "c", "t": 4000})
    batches = [full.where("trace_id = 'a'"), full.where("trace_id = 'b'"), full.where("trace_id = 'c'"), full.where("trace_id = 'c'")]
    got = run_stream(spark, stateful.stream_trace_status, full.schema, batches, tmp_path)
    assert [(r.trace_id, r.status) for r in got if r.trace_id == "a"] == [("a", "running"), ("a", "stale")]
    assert ("b", "closed") in [(r.trace_id, r.status) for r in got]
