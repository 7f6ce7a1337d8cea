"""Streams over the driver tables, run to their end and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import trust as tr
from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.plans.q_accuracy import FOLDS_SQL, OD
from tidepanel.plans.q_sources import MSG, messages
from tidepanel.plans.q_trust import HIST, NEWEST, OUT, history, outcomes
from tidepanel.session import prepare, scratch_path, table
from tidepanel.sources.readers import parse_messages
from tidepanel.streaming import ingest as ig, keyed

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def event_stream(spark, sf):
    """The events file as a stream, zone-less timestamps turned into TIMESTAMP."""
    prepare(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = ig.read_files(spark, sf, schema, pathGlobFilter="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def staged(spark, df, label, files=4):
    """A table written as several files, to arrive in several micro-batches."""
    path = scratch_path(spark, label)
    df.repartition(files).write.parquet(path)
    return ig.read_files(spark, path, df.schema, files_per_batch=1)


@query("q01_topic_stream", MSG)
def q01_topic_stream(spark, sf):
    """JSON messages arriving in four batches."""
    stream = parse_messages(staged(spark, messages(spark, sf), "topic"))
    return ig.collect_run(spark, stream, "q01").select("series_id", pn.stamp(), "y")


@query("q02_stream_dedupe", "SELECT event_type AS series_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value AS y FROM events")
def q02_stream_dedupe(spark, sf):
    """Every event arrives twice; one of each (series, ts) stays."""
    s = event_stream(spark, sf)
    twice = s.select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = ig.collect_run(spark, ig.first_per_timestamp(twice, "60 days").drop("copy"), "q02")
    return out.select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "y")


@query(
    "q02_stream_keep_first",
    "SELECT event_type AS series_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, value + CASE WHEN event_id % 2 = 1 THEN 1 ELSE 2 END AS y FROM events"
    " WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 DAY",
)
def q02_stream_keep_first(spark, sf):
    """Every event arrives as two different rows; the one with the smaller offset stays, once the watermark has passed it."""
    s = event_stream(spark, sf)
    k = F.col("event_id") % 2
    twice = s.select(F.col("event_type").alias("series_id"), "ts", "value", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    offset = F.col("event_id") * 2 + F.when(k == 1, F.col("copy")).otherwise(-F.col("copy"))
    rows = twice.select("series_id", "ts", (F.col("value") + F.col("copy")).alias("y"), offset.alias("offset"))
    out = ig.collect_run(spark, ig.first_per_timestamp(rows, "1 day", "offset"), "q02d")
    return out.select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "y")


@query(
    "q02_stream_side_sink",
    "SELECT 'good' AS sink, count(*) AS rows FROM events WHERE event_id % 6 <> 0 UNION ALL SELECT 'missing or non-finite target', count(*) FROM events WHERE event_id % 6 = 0",
)
def q02_stream_side_sink(spark, sf):
    s = event_stream(spark, sf)
    k = F.col("event_id")
    y = F.when(k % 12 == 0, float("nan")).when(k % 6 != 0, F.col("value"))
    panel = s.select(F.col("event_type").alias("series_id"), "ts", y.alias("y"))
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "bad")
    ig.ingest(panel, good, bad, scratch_path(spark, "q02b")).awaitTermination()
    a = spark.read.parquet(good).agg(F.lit("good").alias("sink"), F.count(F.lit(1)).alias("rows"))
    return a.unionByName(spark.read.parquet(bad).groupBy(F.col("reason").alias("sink")).agg(F.count(F.lit(1)).alias("rows")))


@query(
    "q02_stream_regular_steps",
    f"WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS y, count(*) AS points FROM events GROUP BY 1, 2) SELECT series_id, {TS}, y, points FROM h WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
)
def q02_stream_regular_steps(spark, sf):
    """Hours are emitted once the watermark (one day behind the latest event) has passed them."""
    panel = event_stream(spark, sf).select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y"))
    out = ig.collect_run(spark, ig.regular_steps(panel), "q02c")
    return out.select("series_id", pn.stamp(), F.round("y", 6).alias("y"), "points")


@query(
    "q03_stream_anomalies",
    f"WITH {pn.EVENTS_RAW}, q AS (SELECT series_id, max(n) AS n, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM events_raw GROUP BY 1),"
    " b AS (SELECT series_id, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q WHERE n >= 4 AND q3 > q1),"
    " a AS (SELECT e.series_id, ts, y, CASE WHEN y > hi THEN y - hi ELSE lo - y END / iqr AS far FROM events_raw e JOIN b USING (series_id) WHERE y < lo OR y > hi)"
    f" SELECT 'anomaly.detected' AS event, series_id, {TS}, y AS value, CASE WHEN far >= 2 THEN 'high' WHEN far >= 1 THEN 'medium' ELSE 'low' END AS severity FROM a",
)
def q03_stream_anomalies(spark, sf):
    bounds = ig.history_bounds(pn.events_raw(spark, sf))
    path = scratch_path(spark, "bounds")
    bounds.write.parquet(path)
    s = event_stream(spark, sf).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"), "ts", F.col("value").alias("y"))
    return ig.collect_run(spark, ig.anomaly_events(s, spark.read.parquet(path)), "q03").withColumn("ts", pn.stamp())


@query(
    "q04_stream_calibration",
    OUT + ", b AS (SELECT agent, least(floor(predicted * 10), 9) AS b, count(*) AS k, avg(predicted) AS p, avg(actual) AS a, sum(predicted - actual) AS d FROM l GROUP BY 1, 2)"
    " SELECT agent, CAST(sum(k) AS BIGINT) AS records, round(sum(d) / sum(k), 6) AS bias, round(sum(k * abs(p - a)) / sum(k), 6) AS ece FROM b GROUP BY 1",
)
def q04_stream_calibration(spark, sf):
    """The last 100 outcomes per agent over four batches."""
    df = outcomes(spark, sf)
    path = scratch_path(spark, "calibration")
    keyed.keep_recent(staged(spark, df, "outcomes"), path, scratch_path(spark, "q04"), ["agent"], NEWEST(), tr.WINDOW).awaitTermination()
    last = keyed.recent_rows(spark, path, df.schema, ["agent"], NEWEST(), tr.WINDOW)
    s = tr.calibration_stats(last, NEWEST())
    return s.select("agent", "records", F.round("bias", 6).alias("bias"), F.round("ece", 6).alias("ece"))


@query("q04_stream_history", HIST + " SELECT domain, records, round(mean_score, 6) AS mean_score, latest_score, trend FROM hs")
def q04_stream_history(spark, sf):
    """The last 500 records per domain, with trend."""
    df = history(spark, sf)
    path = scratch_path(spark, "history")
    keyed.keep_recent(staged(spark, df, "scores"), path, scratch_path(spark, "q04b"), ["domain"], NEWEST(), tr.HISTORY).awaitTermination()
    h = tr.history_stats(keyed.recent_rows(spark, path, df.schema, ["domain"], NEWEST(), tr.HISTORY), NEWEST())
    return h.select("domain", "records", F.round("mean_score", 6).alias("mean_score"), "latest_score", "trend")


@query("q05_stream_usage", f"SELECT CAST(user_id AS VARCHAR) AS key_id, count(*) AS requests, round(sum(value), 4) AS inference_ms, CAST(sum(user_id % 5) AS BIGINT) AS series, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1")
def q05_stream_usage(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key_id"), F.col("value").alias("inference_ms"), (F.col("user_id") % 5).alias("series"), "ts")
    path = scratch_path(spark, "usage")
    keyed.count_usage(staged(spark, log, "requests"), path, scratch_path(spark, "q05")).awaitTermination()
    u = keyed.usage_totals(spark, path)
    return u.select("key_id", "requests", F.round("inference_ms", 4).alias("inference_ms"), "series", pn.stamp("updated_at"))


DRIFT_BENCH = (
    OD + FOLDS_SQL.replace("range(0, 3)", "range(0, 2)") + ", tr AS (SELECT fold, p.*, train_end FROM panel p JOIN folds f ON p.series_id = f.series_id AND pos < train_end),"
    " df AS (SELECT *, y - lag(y) OVER (PARTITION BY fold, series_id ORDER BY pos) AS d FROM tr),"
    " st AS (SELECT fold, series_id, arg_max(y, pos) AS lv, avg(CASE WHEN pos > train_end - 512 THEN d END) AS m, avg(abs(d)) AS s FROM df GROUP BY 1, 2),"
    " ac AS (SELECT f.fold, t.series_id, pos - test_start + 1 AS step, y AS a FROM panel t JOIN folds f ON t.series_id = f.series_id AND pos >= test_start AND pos < test_end),"
    " e AS (SELECT model, fold, series_id, a - CASE model WHEN 'last_value' THEN lv ELSE lv + m * (1 - pow(0.9, step)) / (1 - 0.9) END AS e, s FROM ac JOIN st USING (fold, series_id), (VALUES ('last_value'), ('damped_drift')) AS v(model)),"
    " ps AS (SELECT model, fold, series_id, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e)) / max(s) AS mase FROM e GROUP BY 1, 2, 3),"
    " fm AS (SELECT model, fold, avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase FROM ps GROUP BY 1, 2)"
    " SELECT model, metric, round(avg(value), 3) AS value FROM (UNPIVOT fm ON mae, rmse, mase INTO NAME metric VALUE value) GROUP BY 1, 2"
)


@query("e01_user_forecaster", DRIFT_BENCH)
def e01_user_forecaster(spark, sf):
    """A user callable takes part in the benchmark next to a native model."""
    from tidepanel.operators import forecast as fc
    from tidepanel.plans.benchmark import run_benchmark
    from tidepanel.plans.q_accuracy import damped_drift

    r = run_benchmark(pn.orders_daily(spark, sf), ["last_value", fc.GroupedModel("damped_drift", damped_drift, 512)], 14, num_folds=2)
    return r["aggregate"].select("model", "metric", F.round("value", 3).alias("value"))
