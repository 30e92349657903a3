"""Housekeeping over all three tables: dormant sessions, purge, statistics, health, growth."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import ts_lit
from spanloom.functions import expr as E
from spanloom.functions.skew import cut_lineage, discard, one_of_each
from spanloom.sources import compaction
from spanloom.sources.deltas import HEADS, current_value, newest_per_stream, point_heads
from spanloom.sources.summaries import summaries_of
from spanloom.sources.tables import CLUSTERING, corrected, read_points, read_telemetry, write_telemetry

_STORED = {"logs": "timestamp", "points": "timestamp", "spans": "start_timestamp"}
_TIME = {"log_records": "timestamp", "metric_points": "timestamp", "spans": "start_timestamp"}


def _tables(logs: DataFrame, points: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    return {"log_records": logs, "metric_points": points, "spans": spans}


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def dormant_sessions(logs: DataFrame, points: DataFrame, spans: DataFrame, cutoff: datetime) -> DataFrame:
    """Sessions without a row at or after the cutoff in any table."""
    seen = [df.where("session_id IS NOT NULL").select("session_id", F.col(_TIME[n]).alias("at"))
            for n, df in _tables(logs, points, spans).items()]
    return (_stacked(seen).groupBy("session_id").agg(F.max("at").alias("last_seen"))
            .where(F.col("last_seen") < ts_lit(cutoff)).select("session_id"))


def _marked(logs: DataFrame, points: DataFrame, spans: DataFrame, cutoff: datetime) -> dict[str, DataFrame]:
    """The tables with a ``__gone`` flag on rows a purge deletes."""
    # Found once from all three tables, then met by each of them.
    dormant = cut_lineage(dormant_sessions(logs, points, spans, cutoff)).withColumn("__dormant", F.lit(True))
    out = {}
    for name, df in _tables(logs, points, spans).items():
        old = F.col(_TIME[name]) < ts_lit(cutoff)
        gone = old & (F.col("session_id").isNull() | F.col("__dormant").isNotNull())
        marked = df.join(dormant, "session_id", "left")
        if name == "metric_points":
            # The newest point of a stream stays, or its next increment could not be told.
            marked = marked.join(newest_per_stream(df).select("id", F.lit(True).alias("__newest")), "id", "left")
            gone = gone & F.col("__newest").isNull()
        out[name] = marked.withColumn("__gone", gone).withColumn("__old", old).select(*df.columns, "__gone", "__old")
    return out


def purge_preview(logs: DataFrame, points: DataFrame, spans: DataFrame, cutoff: datetime,
                  table_bytes: Mapping[str, int] | None = None) -> DataFrame:
    rows = []
    for name, df in _marked(logs, points, spans, cutoff).items():
        size = F.lit((table_bytes or {}).get(name, 0))
        rows.append(df.agg(F.count_if("__old").alias("rows_older"), F.count_if("__gone").alias("rows_to_delete"), E.row_count().alias("total_rows"))
                    .select(F.lit(name).alias("table_name"), "rows_older", "rows_to_delete",
                            (F.col("rows_older") - F.col("rows_to_delete")).alias("preserved_rows"), "total_rows",
                            F.when(F.col("total_rows") > 0, F.floor(size * F.col("rows_to_delete") / F.col("total_rows")))
                            .otherwise(0).cast("long").alias("estimated_bytes")))
    return _stacked(rows)


def purge(logs: DataFrame, points: DataFrame, spans: DataFrame, cutoff: datetime,
          analyses: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without the purged rows; analyses go with the last span of their trace."""
    kept = {n: df.where(~F.col("__gone")).drop("__gone", "__old") for n, df in _marked(logs, points, spans, cutoff).items()}
    if analyses is not None:
        kept["trace_analyses"] = analyses.join(kept["spans"].select("trace_id").distinct(), "trace_id", "left_semi")
    return kept


def purge_tables(spark: SparkSession, root: str, new_root: str, cutoff: datetime) -> None:
    """Write the kept rows as a new version of the tables; readers switch to it once all are written."""
    tables = [read_telemetry(spark, root, "logs"), read_points(spark, root), read_telemetry(spark, root, "spans")]
    for df, table in zip(purge(*tables, cutoff).values(), ("logs", "points", "spans")):
        write_telemetry(df, new_root, table, 0, "purge")
    kept = read_telemetry(spark, new_root, "points").withColumn("value", current_value())
    point_heads(kept).write.mode("overwrite").partitionBy("event_date").parquet(f"{new_root}/point_heads/writer=purge/batch=0")


def purge_days(spark: SparkSession, root: str, cutoff: datetime) -> dict[str, list[str]]:
    """Purge the tables where they lie; returns the days written anew, by table.

    Only days that lose rows are rewritten, each table's by one snapshot that a manifest puts in the place of the old
    folders, and with them their summaries and heads of streams. The days from the cutoff on are read for session ids
    alone, and newest points come from the heads. Batches that arrive meanwhile stay whole. A purge that broke off is
    run again: a table's own rows are replaced last, so what is still to do shows. Corrections of rewritten points are
    folded in. Where a stream has points without heads (written by other means than ingest), one old point more may stay.
    ``compaction.vacuum`` deletes the old folders; it needs a row left in the table.
    """
    last = cutoff.date()
    stored = {table: compaction.current(spark, root, table) for table in _STORED}
    after = [df.where((F.col("event_date") >= F.lit(last)) & (F.col(_STORED[t]) >= ts_lit(cutoff)) & F.col("session_id").isNotNull())
             .select("session_id") for t, df in stored.items()]
    live = cut_lineage(_stacked(after).distinct().withColumn("__live", F.lit(True)))
    old = {t: df.where(F.col("event_date") <= F.lit(last)) for t, df in stored.items()}
    if compaction.path_exists(spark, f"{root}/point_heads"):
        heads = compaction.current(spark, root, "point_heads", HEADS).select("stream_id", "last.timestamp", "last.id")
        newest = newest_per_stream(heads.unionByName(old["points"].select("stream_id", "timestamp", "id")))
    else:
        newest = newest_per_stream(stored["points"])
    newest = cut_lineage(newest.select("id", F.lit(True).alias("__newest")))
    done = {}
    for table, time in _STORED.items():
        listed = compaction.closed_days(spark, root, table, last + timedelta(days=1), 1)
        corrections = compaction.closed_days(spark, root, "point_fixes", last + timedelta(days=1), 1) if table == "points" else {}
        rows = old[table].where(compaction.lies_in([p for some in listed.values() for p in some]))
        old_row, marked = F.col(time) < ts_lit(cutoff), rows.join(live, "session_id", "left")
        # Only rows of dormant sessions are met with the newest points; of the others no whole row is dealt for it.
        staying, leaving = marked.where(~old_row | F.col("__live").isNotNull()), marked.where(old_row & F.col("__live").isNull())
        spared = leaving.join(newest, "id", "left_semi") if table == "points" else None
        leaving = leaving.join(newest, "id", "left_anti") if table == "points" else leaving
        days = sorted(str(r.event_date) for r in leaving.select("event_date").distinct().collect())
        done[table] = days
        if not days:
            continue
        kept = staying if spared is None else staying.unionByName(spared)
        kept = kept.where(F.col("event_date").isin([date.fromisoformat(d) for d in days])).select(*rows.drop("writer", "batch").columns)
        kept = corrected(kept, root) if table == "points" else kept
        kept = compaction.write_snapshot(one_of_each(kept), root, table, CLUSTERING[table])
        beside = summaries_of(kept, table)
        if table == "points":
            beside["point_heads"] = point_heads(kept.withColumn("value", current_value()))
        for name, frame in beside.items():
            folders = compaction.closed_days(spark, root, name, last + timedelta(days=1), 1)
            compaction.write_snapshot(frame, root, name)
            compaction.replace(spark, root, name, [p for d in days for p in folders.get(d, [])])
        compaction.replace(spark, root, table, [p for d in days for p in listed[d]])
        folded = [p for d in days for p in corrections.get(d, [])]
        if folded:
            compaction.replace(spark, root, "point_fixes", folded)
    discard(live, newest)
    return done


def row_statistics(logs: DataFrame, points: DataFrame, spans: DataFrame, since: datetime) -> DataFrame:
    return _stacked([
        df.agg(E.row_count().alias("row_count"), F.min(_TIME[n]).alias("oldest_timestamp"), F.max(_TIME[n]).alias("newest_timestamp"),
               F.count_if(F.col(_TIME[n]) >= ts_lit(since)).alias("rows_in_window"))
        .select(F.lit(n).alias("table_name"), "*") for n, df in _tables(logs, points, spans).items()])


def freshness(received: Column, now: datetime) -> Column:
    minutes = (F.unix_micros(ts_lit(now)) - F.unix_micros(received)) / 60e6
    return F.when(received.isNull(), "empty").when(minutes <= 15, "live").when(minutes <= 24 * 60, "delayed").otherwise("stale")


def ingest_health(logs: DataFrame, points: DataFrame, spans: DataFrame, now: datetime) -> DataFrame:
    signals = {"logs": (logs, "timestamp", "event_name", None), "metrics": (points, "timestamp", "metric_name", "stream_id"),
               "traces": (spans, "start_timestamp", "name", None)}
    out = []
    for signal, (df, ts, name, series) in signals.items():
        week = F.col(ts) >= ts_lit(now - timedelta(days=7))
        # Distinct names and series come from a small pre-aggregate, in the same scan as the counts.
        keys = [name] + ([series] if series else [])
        per = df.groupBy(*keys).agg(
            F.max(F.struct(F.col(ts).alias("t"), F.col("id"), F.col("received_at"))).alias("newest"),
            F.count_if(F.col(ts) >= ts_lit(now - timedelta(hours=1))).alias("h"),
            F.count_if(F.col(ts) >= ts_lit(now - timedelta(days=1))).alias("d"), F.count_if(week).alias("w"))
        names = per.groupBy(name).agg(
            F.max("newest").alias("newest"), *[F.sum(c).alias(c) for c in "hdw"],
            (F.count(series) if series else F.lit(None).cast("long")).alias("s"))
        out.append(names.agg(
            F.max("newest").alias("newest"), *[F.sum(c).alias(c) for c in "hdw"], F.count(name).alias("n"), F.sum("s").alias("s"))
            .select(F.lit(signal).alias("signal"), F.col("newest.t").alias("newest_timestamp"), F.col("newest.received_at").alias("newest_received_at"),
                    F.col("h").alias("rows_last_hour"), F.col("d").alias("rows_last_day"), F.col("w").alias("rows_last_week"),
                    F.col("n").alias("name_cardinality"), F.col("s").alias("series_cardinality")))
    return _stacked(out).withColumn("freshness", freshness(F.col("newest_received_at"), now))


def repository_usage(logs: DataFrame, points: DataFrame, spans: DataFrame) -> DataFrame:
    seen = [df.where("repository_url IS NOT NULL").select("repository_url", F.col(_TIME[n]).alias("at"))
            for n, df in _tables(logs, points, spans).items()]
    return (_stacked(seen).groupBy("repository_url").agg(F.max("at").alias("last_seen"), E.row_count().alias("row_count"))
            .orderBy(F.desc("last_seen"), "repository_url"))


def growth_estimate(statistics: DataFrame, table_bytes: Mapping[str, int], target_bytes: int, days: int = 7) -> DataFrame:
    """Bytes a day from the rows of the last ``days``, and days until a size is reached."""
    size = F.coalesce(F.create_map(*[F.lit(x) for kv in table_bytes.items() for x in kv])[F.col("table_name")], F.lit(0))
    per_day = F.when(F.col("row_count") > 0, F.floor(size / F.col("row_count") * F.col("rows_in_window") / days)).otherwise(0).cast("long")
    history = F.floor((F.unix_micros("newest_timestamp") - F.unix_micros("oldest_timestamp")) / 86_400e6)
    rows = statistics.select("table_name", size.cast("long").alias("table_bytes"), per_day.alias("estimated_bytes_per_day"),
                             F.when(history > 0, history).cast("long").alias("retention_span_days"))
    day, now = rows.agg(F.sum("estimated_bytes_per_day")).scalar(), rows.agg(F.sum("table_bytes")).scalar()
    return rows.withColumn("days_until_target", F.when((day > 0) & (now < target_bytes), F.round((F.lit(target_bytes) - now) / day)).cast("long"))
