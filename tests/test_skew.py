"""The skew-safe helpers against plain windows and numpy."""

import random

import numpy as np
import pytest
from conftest import at, listed
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import skew


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(7)
    # One key holds most rows, some keys are NULL, and rows spread over many chunks.
    rows = [(i, rnd.choice(["hot"] * 8 + ["a", "b", None]), at(rnd.randrange(0, 20_000)), rnd.choice([None, 1, 2, 3]), rnd.choice("xyy"))
            for i in range(600)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp, v long, lab string").cache()


def plain():
    return Window.partitionBy("k").orderBy("ts", "id")


def same(got, want, *columns):
    assert listed(got, "id", *columns) == listed(want, "id", *columns)


def test_previous_row_keeps_null_payloads(events):
    same(skew.previous_row(events, ["k"], ["ts", "id"], F.col("v"), "p"), events.withColumn("p", F.lag("v").over(plain())), "p")


@pytest.mark.parametrize("current", [True, False])
def test_carry_last(events, current):
    want = events.withColumn("p", F.last("v", ignorenulls=True).over(plain().rowsBetween(Window.unboundedPreceding, 0 if current else -1)))
    same(skew.carry_last(events, ["k"], ["ts", "id"], F.col("v"), "p", include_current=current), want, "p")


def test_running_total_and_row_numbers(events):
    want = events.withColumn("p", F.sum("v").over(plain().rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(plain()).cast("long"))
    got = skew.row_numbers(skew.running_total(events, ["k"], ["ts", "id"], F.col("v"), "p"), ["k"], ["ts", "id"], "n")
    same(got, want, "p", "n")


def test_rows_move_once(spark, events):
    """The join with the chunks' summaries finds the rows where their window left them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (skew.carry_last(events, ["k"], ["ts", "id"], F.col("v"), "p"), skew.running_total(events, ["k"], ["ts", "id"], F.col("v"), "p")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            # For the rows; for the summaries by chunk, by key, and by chunk again.
            assert plan.count("Exchange hashpartitioning") == 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_runs(events):
    changed = F.when(F.lag("lab").over(plain()).eqNullSafe(F.col("lab")), 0).otherwise(1)
    want = events.withColumn("c", changed).withColumn("r", F.sum("c").over(plain().rowsBetween(Window.unboundedPreceding, 0)))
    same(skew.runs(events, ["k"], ["ts", "id"], ["lab"], "r"), want, "r")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60))
def test_exact_percentiles(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    p = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    cont = {r.k: r for r in skew.exact_percentiles(df, ["k"], F.col("v"), p).collect()}
    disc = {r.k: r for r in skew.exact_percentiles(df, ["k"], F.col("v"), p, kind="disc").collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        for name, q in p.items():
            assert cont[key][name] == pytest.approx(np.percentile(values, q * 100), rel=1e-9, abs=1e-6)
            assert disc[key][name] == values[max(0, int(np.ceil(q * len(values))) - 1)]


def crowds(spark):
    """Values that crowd any fixed grid: cents, ratios, a constant, large near-equal ones, tiny and signed ones."""
    n = F.col("id")
    kinds = {"cents": n / 20_000_000, "ratio": F.lit(1.0) - F.lit(1.0) / (n + 1), "constant": F.lit(7.25), "close": F.lit(1e15) + n, "closer": F.lit(1e6) + n / 1e9,
             "tiny": F.pow(F.lit(10.0), -(n % 300)) * (n % 7 - 3), "halves": F.when(n % 2 == 0, n.cast("double")).otherwise(1e300)}
    return spark.range(30_000).select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in kinds.items()])))


def test_percentiles_of_crowded_values(spark):
    df, p = crowds(spark), {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    got = {r.k: r for r in skew.exact_percentiles(df, ["k"], F.col("v"), p).collect()}
    exact = df.groupBy("k").agg(*[F.expr(f"percentile(v, {q})").alias(name) for name, q in p.items()]).collect()
    assert len(exact) == 7
    for want in exact:
        for name in p:
            assert got[want.k][name] == pytest.approx(want[name], rel=1e-12), (want.k, name)


def test_no_crowded_bucket_is_left(spark):
    counts = skew.value_counts(crowds(spark), ["k"], F.col("v"))
    counts = counts.select("__k0", "__v", "__n", skew._value_bucket(F.col("__v")).alias("__b"))
    buckets, _ = skew.rank_buckets(counts, ["__k0"], {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    first = counts.groupBy("__k0", "__b").count()
    assert first.agg(F.max("count")).first()[0] > 6_000  # the logarithm alone leaves crowds
    assert buckets.agg(F.max("__size")).first()[0] < 100


def test_percentiles_of_what_is_no_number(spark):
    rows = [("a", float("nan")), ("a", float("inf")), ("a", -0.0), ("a", 0.0), ("b", None), (None, 5.0), (None, 6.0), ("c", float("-inf"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in skew.exact_percentiles(df, ["k"], F.col("v"), {"m": 0.5}, kind="disc").collect()}
    assert got == {"a": 0.0, None: 5.0, "c": float("-inf")}
    assert skew.exact_percentiles(df.limit(0), ["k"], F.col("v"), {"m": 0.5}).count() == 0


def test_counts_feed_aggregates_and_percentiles_from_one_scan(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = skew.exact_percentiles(df, ["k"], F.col("v"), {"m": 0.5})
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[:text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
    counts = skew.value_counts(df, ["k"], F.col("v"), twice=F.col("v") * 2)
    assert listed(counts.groupBy("__k0").agg(F.sum("__n").alias("n"), F.sum("twice").alias("t")), "__k0", "n", "t") == [
        (k, len(range(k, 1000, 3)), 2 * sum(range(k, 1000, 3))) for k in range(3)]


def test_top_value_breaks_ties_low(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", "z")], "k string, v string")
    assert listed(skew.top_value(df, ["k"], "v", "m"), "k", "m") == [("a", "x"), ("b", "z")]


class _Session:
    """Just what the folder choice reads of a session."""

    def __init__(self, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("C", (), {"applicationId": "app"})()


def test_intermediate_folder_is_the_one_the_session_names():
    assert skew.shared_folder(_Session("hdfs:///shared")) == "hdfs:///shared"
    own = skew.shared_folder(_Session(None))
    assert own and own == skew.shared_folder(_Session(None))


def test_cut_lineage_keeps_the_rows(spark):
    assert skew.cut_lineage(spark.range(5)).count() == 5
