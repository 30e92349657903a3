"""Counters: token usage, catalog, totals, trends, splits, facets, request distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import CFG, TelemetryConfig, TimeRange
from spanloom.functions import expr as E
from spanloom.functions.skew import cut_lineage, exact_percentiles
from spanloom.functions.timebins import bin_index, bin_ts
from spanloom.operators.cost import change_percent, integer_share, sum_when
from spanloom.sources.summaries import Summaries

TREND_BINS = 24
SPARK_BINS = 8
_TYPES = {"input_tokens": "input", "output_tokens": "output", "cache_creation_tokens": "cacheCreation", "cache_read_tokens": "cacheRead"}

# The curated counters, each with the attribute its total is split by.
CURATED = {
    CFG.token_metric: "model", CFG.cost_metric: "model", CFG.session_metric: None, CFG.active_metric: None,
    CFG.lines_metric: "token_type", CFG.edit_decision_metric: "decision", CFG.commit_metric: None,
    CFG.pull_request_metric: None,
}


def moving_points(points: DataFrame, names: Sequence[str] | None, w: TimeRange, repo: str | None = None,
                  wanted: Mapping[str, str | None] | None = None) -> DataFrame:
    test = E.moving() & w.scan() & E.in_repository(repo)
    if names is not None:
        test = test & F.col("metric_name").isin(*names)
    if wanted:
        test = test & E.attrs_match_keyed("attributes", wanted)
    return points.where(test)


def _total(value: Column | None = None) -> Column:
    return F.coalesce(F.sum("value_delta" if value is None else value), F.lit(0.0))


def token_breakdown(points: DataFrame, w: TimeRange, bucket_seconds: int, repo: str | None = None,
                    cfg: TelemetryConfig = CFG) -> DataFrame:
    """By bin and type, by model, and in total, from one scan."""
    rows = moving_points(points, [cfg.token_metric], w, repo).select(
        bin_ts("timestamp", w.start, bucket_seconds).alias("bucket"), "token_type", "model",
        F.col("token_type").alias("kind"), "value_delta")
    row_type = F.when(F.grouping("model") == 0, "model").when(F.grouping("bucket") == 0, "bucket").otherwise("total")
    c = F.col
    grouped = (rows.groupingSets([[c("bucket"), c("token_type")], [c("model")], []], "bucket", "token_type", "model")
               .agg(row_type.alias("row_type"), E.rounded_long(_total()).alias("total"),
                    *[E.rounded_long(sum_when(c("kind") == kind)).alias(name) for name, kind in _TYPES.items()]))
    return grouped.where(~((c("row_type") == "model") & c("model").isNull()) & ~((c("row_type") == "bucket") & c("token_type").isNull()))


def token_usage(points: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = moving_points(points, [cfg.token_metric], w, repo).where(F.col("token_type").isNotNull())
    sums = rows.agg(*[E.rounded_long(sum_when(F.col("token_type") == kind)).alias(name) for name, kind in _TYPES.items()])
    return (sums.withColumn("total_tokens", sum((F.col(n) for n in _TYPES), F.lit(0)))
            .withColumn("cache_read_ratio", E.cache_efficiency("input_tokens", "cache_creation_tokens", "cache_read_tokens", 0.0)))


def token_usage_points(points: DataFrame, w: TimeRange, bucket_seconds: int, repo: str | None = None,
                       cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = moving_points(points, [cfg.token_metric], w, repo).where(F.col("token_type").isNotNull())
    return (rows.groupBy(bin_ts("timestamp", w.start, bucket_seconds).alias("bucket"))
            .agg(*[E.rounded_long(sum_when(F.col("token_type") == kind)).alias(name) for name, kind in _TYPES.items()]).orderBy("bucket"))


def token_usage_models(points: DataFrame, w: TimeRange, repo: str | None = None, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = moving_points(points, [cfg.token_metric], w, repo).where(F.col("model").isNotNull())
    per = rows.groupBy("model").agg(E.rounded_long(_total()).alias("total"),
                                    *[E.rounded_long(sum_when(F.col("token_type") == k)).alias(n) for n, k in _TYPES.items()])
    whole = per.agg(F.sum("total")).scalar()
    return per.withColumn("share_percent", integer_share(F.col("total"), whole)).orderBy(F.desc("total"), "model")


def total_tokens(points: DataFrame, w: TimeRange, cfg: TelemetryConfig = CFG) -> DataFrame:
    return moving_points(points, [cfg.token_metric], w).agg(E.rounded_long(_total()).alias("total_tokens"))


def _both(w: TimeRange) -> list[Column]:
    return [E.rounded_long(sum_when(w.contains())).alias("current_total"), E.rounded_long(sum_when(w.prior())).alias("prior_total")]


def tokens_current_prior(points: DataFrame, w: TimeRange, cfg: TelemetryConfig = CFG) -> DataFrame:
    return moving_points(points, [cfg.token_metric], w.with_prior()).agg(*_both(w))


def token_type_current_prior(points: DataFrame, w: TimeRange, cfg: TelemetryConfig = CFG) -> DataFrame:
    rows = points.where((F.col("metric_name") == cfg.token_metric) & w.with_prior().scan())
    return rows.groupBy("token_type").agg(*_both(w))


def metric_catalog(points: DataFrame, w: TimeRange) -> DataFrame:
    rows = points.where(w.scan()).select("metric_name", "unit", "stream_id")
    # Within one metric, equal attribute sets and equal stream ids are the same thing.
    return (rows.groupBy("metric_name").agg(F.coalesce(F.max("unit"), F.lit("")).alias("unit"),
                                            F.countDistinct("stream_id").alias("cardinality"))
            .withColumn("health", E.cardinality_health("cardinality")).orderBy("metric_name"))


def catalog_sparklines(points: DataFrame, w: TimeRange, bins: int = SPARK_BINS) -> DataFrame:
    seconds = max(1, int(w.seconds) // bins)
    return (points.where(w.scan()).groupBy("metric_name", bin_index("timestamp", w.start, seconds).alias("bucket_index"))
            .agg(E.row_count().alias("row_count")).orderBy("metric_name", "bucket_index"))


def metric_names(points: DataFrame, kept: Summaries | None = None) -> DataFrame:
    days = (kept or Summaries.of(points=points)).metrics
    return days.groupBy("metric_name").agg(F.coalesce(F.min("unit"), F.lit("")).alias("unit")).orderBy("metric_name")


def metric_totals(points: DataFrame, names: Sequence[str], w: TimeRange, repo: str | None = None,
                  wanted: Mapping[str, str | None] | None = None) -> DataFrame:
    rows = moving_points(points, names, w.with_prior(), repo, wanted)
    return rows.groupBy("metric_name").agg(sum_when(w.contains()).alias("current_total"), sum_when(w.prior()).alias("prior_total"))


def metric_cardinality(points: DataFrame, names: Sequence[str], w: TimeRange, repo: str | None = None,
                       wanted: Mapping[str, str | None] | None = None, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("stream_id") if approximate else F.countDistinct("stream_id")
    return moving_points(points, names, w, repo, wanted).groupBy("metric_name").agg(count.alias("cardinality"))


def _binned(points: DataFrame, names: Sequence[str], w: TimeRange, bucket_seconds: int, repo: str | None,
            wanted: Mapping[str, str | None] | None) -> DataFrame:
    return moving_points(points, names, w, repo, wanted).withColumn("bucket", bin_ts("timestamp", w.start, bucket_seconds))


def metric_trend_sum(points, names, w, bucket_seconds, repo=None, wanted=None) -> DataFrame:
    return _binned(points, names, w, bucket_seconds, repo, wanted).groupBy("metric_name", "bucket").agg(_total().alias("total"))


def metric_trend_avg(points, names, w, bucket_seconds, repo=None, wanted=None) -> DataFrame:
    rows = _binned(points, names, w, bucket_seconds, repo, wanted).where("value_delta > 0")
    return rows.groupBy("metric_name", "bucket").agg(F.avg("value_delta").alias("aggregated_value"))


def metric_trend_p95(points, names, w, bucket_seconds, repo=None, wanted=None) -> DataFrame:
    rows = _binned(points, names, w, bucket_seconds, repo, wanted).where("value_delta > 0")
    return exact_percentiles(rows, ["metric_name", "bucket"], F.col("value_delta"), {"aggregated_value": 0.95})


def metric_trend_count(points, names, w, bucket_seconds, repo=None, wanted=None) -> DataFrame:
    rows = _binned(points, names, w, bucket_seconds, repo, wanted).where("value_delta > 0")
    return rows.groupBy("metric_name", "bucket").agg(E.row_count().cast("double").alias("aggregated_value"))


def metric_splits(points: DataFrame, names: Sequence[str], w: TimeRange, repo: str | None = None,
                  wanted: Mapping[str, str | None] | None = None) -> DataFrame:
    """Totals per attribute value; a point counts once under each attribute it carries."""
    grouped = moving_points(points, names, w, repo, wanted).groupBy("metric_name", "model", "token_type", "decision").agg(_total().alias("total"))
    entries = F.array(*[F.struct(F.lit(label).alias("attribute"), F.col(column).alias("label"))
                        for label, column in (("model", "model"), ("type", "token_type"), ("decision", "decision"))])
    return (grouped.select("metric_name", "total", F.inline(entries)).where("label IS NOT NULL")
            .groupBy("metric_name", "attribute", "label").agg(F.sum("total").alias("total"))
            .orderBy("metric_name", "attribute", F.desc("total"), "label"))


def metric_attribute_facets(points: DataFrame, name: str, w: TimeRange, repo: str | None = None,
                            max_values: int | None = None) -> DataFrame:
    """Streams per attribute value; ``max_values`` leaves out keys with more values."""
    streams = (moving_points(points, [name], w, repo).groupBy("stream_id").agg(F.any_value("attributes").alias("attributes")))
    pairs = (streams.select(F.explode("attributes").alias("attribute_key", "attribute_value")).where("attribute_value <> ''")
             .groupBy("attribute_key", "attribute_value").agg(E.row_count().alias("stream_count")))
    if max_values is not None:
        bounded = pairs.groupBy("attribute_key").agg(E.row_count().alias("values")).where(F.col("values") <= max_values)
        pairs = pairs.join(bounded.select("attribute_key"), "attribute_key", "left_semi")
    return pairs.orderBy("attribute_key", F.desc("stream_count"), "attribute_value")


def metric_series(points: DataFrame, w: TimeRange, names: Sequence[str] | None = None, repo: str | None = None,
                  filtered: tuple[str, Mapping[str, str | None]] | None = None, bins: int = TREND_BINS,
                  kept: Summaries | None = None) -> DataFrame:
    """Headline of every counter: total, prior, change, hourly rate, peak bin, cardinality.

    ``filtered`` narrows one metric to points with the given attributes.
    """
    seconds = max(1, int(w.seconds) // bins)
    rows = moving_points(points, names, w.with_prior(), repo)
    if filtered:
        rows = rows.where((F.col("metric_name") != filtered[0]) | E.attrs_match_keyed("attributes", filtered[1]))
    last = F.least(bin_index("timestamp", w.start, seconds), F.lit(bins - 1))
    per_bin = rows.groupBy("metric_name", F.when(w.contains(), last).otherwise(-1).alias("bin")).agg(_total().alias("t"))
    now = F.col("bin") >= 0
    sums = per_bin.groupBy("metric_name").agg(
        sum_when(now, "t").alias("total"), sum_when(~now, "t").alias("prior"),
        F.greatest(F.coalesce(F.max(F.when(now, F.col("t"))), F.lit(0.0)), F.lit(0.0)).alias("peak"))
    streams = rows.where(w.contains()).groupBy("metric_name").agg(F.countDistinct("stream_id").alias("cardinality"))
    known = metric_names(points, kept).select("metric_name", "unit")
    curated = points.sparkSession.createDataFrame([(n,) for n in CURATED], "metric_name string")
    everything = known.join(curated, "metric_name", "full").select("metric_name", F.coalesce("unit", F.lit("")).alias("unit"))
    if names is not None:
        everything = everything.where(F.col("metric_name").isin(*names))
    out = everything.join(sums, "metric_name", "left").join(streams, "metric_name", "left").na.fill(0)
    return (out.withColumn("rate_per_hour", F.col("total") / (max(1, int(w.seconds)) / 3600.0))
            .withColumn("delta_percent", change_percent(F.col("total"), F.col("prior")))
            .withColumn("health", E.cardinality_health("cardinality"))
            .withColumn("curated", F.col("metric_name").isin(*CURATED)).orderBy(F.desc("curated"), "metric_name"))


def metric_series_trend(points: DataFrame, w: TimeRange, names: Sequence[str] | None = None, repo: str | None = None,
                        bins: int = TREND_BINS, kept: Summaries | None = None) -> DataFrame:
    """Dense bins per metric; what lies past the last bin counts in it."""
    seconds = max(1, int(w.seconds) // bins)
    last = F.least(bin_index("timestamp", w.start, seconds), F.lit(bins - 1)).alias("bucket_index")
    sums = moving_points(points, names, w, repo).groupBy("metric_name", last).agg(_total().alias("total"))
    axis = metric_names(points, kept).select("metric_name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bucket_index"))
    if names is not None:
        axis = axis.where(F.col("metric_name").isin(*names))
    return axis.join(sums, ["metric_name", "bucket_index"], "left").na.fill(0.0).withColumn("total", F.round("total", 4))


def metric_points_page(points: DataFrame, w: TimeRange, pairs: Sequence[str], page: int, size: int) -> DataFrame:
    rows = points.where(w.scan() & E.attrs_match("attributes", pairs))
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).offset(page * size).limit(size)


def metric_points_count(points: DataFrame, w: TimeRange, pairs: Sequence[str]) -> DataFrame:
    return points.where(w.scan() & E.attrs_match("attributes", pairs)).agg(E.row_count().alias("row_count"))


# Distribution of single requests.

def _request_points(logs: DataFrame, w: TimeRange, value: Column, repo: str | None, limit: int | None, cfg: TelemetryConfig) -> DataFrame:
    """All requests with a value; ``limit`` keeps the newest, for a chart that shows no more."""
    rows = logs.where((F.col("event_name") == cfg.api_request) & value.isNotNull() & w.scan() & E.in_repository(repo))
    rows = rows if limit is None else rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
    return (rows.select("id", F.col("timestamp").alias("request_timestamp"), value.cast("double").alias("request_value"),
                    E.real_trace_id("trace_id").alias("trace_id"), "request_id",
                    F.coalesce(F.col("derived_severity") == "ERROR", F.lit(False)).alias("request_failed")))


def request_points_tokens(logs: DataFrame, w: TimeRange, limit: int | None = None, repo: str | None = None,
                          cfg: TelemetryConfig = CFG) -> DataFrame:
    parts = [F.coalesce(c, F.lit(0.0)) for c in _TYPES]
    return _request_points(logs, w, parts[0] + parts[1] + parts[2] + parts[3], repo, limit, cfg)


def request_points_cost(logs: DataFrame, w: TimeRange, limit: int | None = None, repo: str | None = None,
                        cfg: TelemetryConfig = CFG) -> DataFrame:
    return _request_points(logs, w, F.col("cost_usd"), repo, limit, cfg)


def select_exemplars(request_points: DataFrame) -> DataFrame:
    """Points worth opening: the largest, those nearest p50/p95/p99, the largest failed one.

    The input is a top-k list. A later request wins a tie.
    """
    pts = cut_lineage(request_points)
    marks = exact_percentiles(pts, [], F.col("request_value"), {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    value, at = F.col("request_value"), F.unix_micros("request_timestamp")
    p = {n: marks.select(n).scalar() for n in ("p50", "p95", "p99")}
    traced = pts.where("trace_id IS NOT NULL").withColumns({f"__{n}": F.abs(value - s) for n, s in p.items()})
    latest = F.struct(value, at, F.col("id"))
    chosen = traced.agg(
        F.max_by("id", latest).alias("largest"),
        *[F.min_by("id", F.struct(F.col(f"__{n}"), -at, -F.col("id"))).alias(n) for n in p],
        F.max_by("id", F.when(F.col("request_failed"), latest)).alias("failed"))
    ids = chosen.select(F.explode(F.array("largest", *p, "failed")).alias("id")).where("id IS NOT NULL").distinct()
    marked = ids.withColumn("is_exemplar", F.lit(True))
    return (pts.join(marked, "id", "left").withColumn("is_exemplar", F.coalesce("is_exemplar", F.lit(False)))
            .withColumn("trace_id", F.when(F.col("is_exemplar"), F.col("trace_id"))))


def exemplar_spans(spans: DataFrame, exemplars: DataFrame, cfg: TelemetryConfig = CFG) -> DataFrame:
    """First model-call span of each exemplar request inside its trace."""
    wanted = exemplars.where("is_exemplar").select("trace_id", "request_id")
    calls = spans.where((F.col("name") == cfg.llm_span) & F.col("request_id").isNotNull())
    return (calls.join(wanted, ["trace_id", "request_id"]).groupBy("trace_id", "request_id")
            .agg(F.min_by("span_id", F.struct("start_timestamp", "span_id")).alias("span_id")))


def nearest_rank_summary(request_points: DataFrame) -> DataFrame:
    p = exact_percentiles(request_points, [], F.col("request_value"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, kind="disc")
    total = request_points.agg(E.row_count()).scalar()
    return p.withColumn("request_count", total)
