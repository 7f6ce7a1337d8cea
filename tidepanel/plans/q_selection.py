"""Benchmarks, leaderboards, routing, recommendation and usage on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import registry
from tidepanel.operators import folds, forecast as fc, leaderboard as lb, selection as sel, windows as wn
from tidepanel.plans import benchmark as bm, panels as pn
from tidepanel.plans.catalog import query
from tidepanel.plans.q_accuracy import FOLDS_SQL, OD
from tidepanel.session import table

MODELS = ["last_value", "seasonal_naive", "linear_trend"]
# Scores of three native models on three folds of the daily orders.
BENCH = (
    OD + FOLDS_SQL + ", tr AS (SELECT fold, p.*, train_end FROM panel p JOIN folds f ON p.series_id = f.series_id AND pos < train_end),"
    " st AS (SELECT fold, series_id, max(train_end) AS te, arg_max(y, pos) AS lv, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM tr GROUP BY 1, 2),"
    " sc AS (SELECT fold, series_id, avg(abs(d)) AS s FROM (SELECT fold, series_id, y - lag(y) OVER (PARTITION BY fold, series_id ORDER BY pos) AS d FROM tr) GROUP BY 1, 2),"
    " ac AS (SELECT f.fold, t.series_id, pos - test_start + 1 AS step, y AS a FROM panel t JOIN folds f ON t.series_id = f.series_id AND pos >= test_start AND pos < test_end),"
    " pr AS (SELECT 'last_value' AS model, fold, series_id, step, lv AS p FROM st, range(1, 15) AS r(step)"
    " UNION ALL SELECT 'linear_trend', fold, series_id, step, my + b * (te - 1 + step - mx) FROM st, range(1, 15) AS r(step)"
    " UNION ALL SELECT 'seasonal_naive', tr.fold, tr.series_id, step, y FROM tr, range(1, 15) AS r(step) WHERE pos = train_end - 7 + ((step - 1) % 7)),"
    " ps AS (SELECT model, pr.fold, pr.series_id, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, avg(abs(a - p)) / max(s) AS mase FROM pr JOIN ac ON"
    " ac.fold = pr.fold AND ac.series_id = pr.series_id AND ac.step = pr.step JOIN sc ON sc.fold = pr.fold AND sc.series_id = pr.series_id GROUP BY 1, 2, 3),"
    " fm AS (SELECT model, fold, avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase FROM ps GROUP BY 1, 2),"
    " ag AS (SELECT model, avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase, count(*) AS folds_evaluated FROM fm GROUP BY 1),"
    " wt AS (SELECT model, round(1 / mase / sum(1 / mase) OVER (), 6) AS weight FROM ag),"
    # measured latency per model is an input; here the mean event value stands in for it
    " lt AS (SELECT CASE event_type WHEN 'click' THEN 'last_value' WHEN 'view' THEN 'seasonal_naive' ELSE 'linear_trend' END AS model, avg(value) AS latency_ms FROM events GROUP BY 1)"
)


def _bench(spark, sf):
    return bm.run_benchmark(pn.orders_daily(spark, sf), MODELS, 14)


def _latency(spark, sf):
    ev = table(spark, sf, "events")
    model = F.when(F.col("event_type") == "click", "last_value").when(F.col("event_type") == "view", "seasonal_naive").otherwise("linear_trend")
    return ev.groupBy(model.alias("model")).agg(F.avg("value").alias("latency_ms"))


def _summary(spark, sf):
    names = ["mase", "mae", "rmse"]
    return bm.summary_rows(_bench(spark, sf), _latency(spark, sf), names), names


@query("f13_walk_forward_benchmark", BENCH + " SELECT model, fold, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mase, 6) AS mase FROM fm")
def f13_walk_forward_benchmark(spark, sf):
    fm = _bench(spark, sf)["fold_metrics"].groupBy("model", "fold").pivot("metric", ["mae", "rmse", "mase"]).agg(F.first("value"))
    return fm.select("model", "fold", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mase", 6).alias("mase"))


def _measured(spark, sf):
    names = ["mase", "mae", "rmse"]
    return bm.summary_rows(bm.run_benchmark(pn.orders_daily(spark, sf), MODELS, 14, measure=True), None, names), names


# measured times differ from run to run: the twins check what must hold of them
@query("f13_benchmark_latency", BENCH + " SELECT model, count(*) AS calls, CAST(0 AS BIGINT) AS failed, true AS measured FROM ps GROUP BY 1")
def f13_benchmark_latency(spark, sf):
    """Every call is timed in its task; one per model, fold and series."""
    timed = bm.run_benchmark(pn.orders_daily(spark, sf), MODELS, 14, measure=True)["latency"]
    return timed.select("model", "calls", "failed", (F.col("latency_ms") > 0).alias("measured"))


@query(
    "w21_measured_rankings",
    BENCH + " SELECT model, CAST(row_number() OVER (ORDER BY mase, mae, rmse, model) AS INTEGER) AS quality_rank, round(mase, 6) AS mase, true AS latency_ranked, true AS balanced FROM ag",
)
def w21_measured_rankings(spark, sf):
    """Ranks by measured latency: in its order, and balanced as 0.7 quality + 0.3 latency."""
    s, names = _measured(spark, sf)
    r = lb.routing_ranks(s, names)
    order = r.agg(F.sort_array(F.collect_list(F.struct("latency_ms", "latency_rank"))).alias("o"))  # one row per model
    in_order = order.select(F.forall(F.transform("o", lambda e, i: e["latency_rank"] == i + 1), lambda x: x).alias("latency_ranked"))
    balanced = F.col("balanced_score") == F.round(0.7 * F.col("quality_rank") + 0.3 * F.col("latency_rank"), 4)
    rows = r.select("model", "quality_rank", F.round("mase", 6).alias("mase"), balanced.alias("balanced"), F.lit(1).alias("_j"))
    return rows.join(in_order.withColumn("_j", F.lit(1)), "_j").select("model", "quality_rank", "mase", "latency_ranked", "balanced")


@query("a12_fold_aggregate", BENCH + " SELECT model, 'mae' AS metric, round(mae, 2) AS value FROM ag UNION ALL SELECT model, 'rmse', round(rmse, 2) FROM ag UNION ALL SELECT model, 'mase', round(mase, 2) FROM ag")
def a12_fold_aggregate(spark, sf):
    return _bench(spark, sf)["aggregate"].withColumn("value", F.round("value", 2))


@query("a13_inverse_error_weights", BENCH + " SELECT * FROM wt")
def a13_inverse_error_weights(spark, sf):
    return _bench(spark, sf)["weights"]


@query("a14_dataset_fingerprint", OD + " s AS (SELECT series_id, count(*) AS c FROM panel GROUP BY 1) SELECT substr(sha256(string_agg(series_id || ':' || c || ':D', '|' ORDER BY series_id)), 1, 16) AS fingerprint FROM s")
def a14_dataset_fingerprint(spark, sf):
    s = pn.orders_daily(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("points")).withColumn("freq", F.lit("D"))
    return lb.dataset_fingerprint(s)


@query("a14_bucket_fingerprint", OD + " s AS (SELECT series_id, count(*) AS c FROM panel GROUP BY 1), b AS (SELECT substr(sha256(series_id), 1, 3) AS bucket, sha256(string_agg(series_id || ':' || c || ':D', '|' ORDER BY series_id || ':' || c || ':D')) AS hash FROM s GROUP BY 1) SELECT substr(sha256(string_agg(bucket || '=' || hash, '|' ORDER BY bucket || '=' || hash)), 1, 16) AS fingerprint FROM b")
def a14_bucket_fingerprint(spark, sf):
    """A fingerprint of another kind, for many series: no task sees more than the lines of a bucket."""
    s = pn.orders_daily(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("points")).withColumn("freq", F.lit("D"))
    return lb.bucket_fingerprint(s)


@query("s26_learned_weights", BENCH + " SELECT model, weight, 'orders' AS fingerprint FROM wt WHERE weight > 0")
def s26_learned_weights(spark, sf):
    """Weights are written to a table partitioned by fingerprint and looked up again."""
    from tidepanel.sources.sinks import load_weights, save_weights
    from tidepanel.session import scratch_path

    path = scratch_path(spark, "weights")
    save_weights(_bench(spark, sf)["weights"], "orders", path)
    return load_weights(spark, path, "orders").select("model", "weight", "fingerprint")


ROUTE = (
    BENCH + ", sm AS (SELECT ag.*, latency_ms, weight FROM ag JOIN lt USING (model) JOIN wt USING (model)),"
    " rk AS (SELECT *, row_number() OVER (ORDER BY mase, mae, rmse, latency_ms, model) AS quality_rank, row_number() OVER (ORDER BY latency_ms, mase, mae, rmse, model) AS latency_rank FROM sm),"
    " bl AS (SELECT *, round(0.7 * quality_rank + 0.3 * latency_rank, 4) AS balanced_score FROM rk),"
    " br AS (SELECT *, row_number() OVER (ORDER BY balanced_score, quality_rank, latency_rank, model) AS balanced_rank FROM bl)"
)


@query("w21_rankings", ROUTE + " SELECT model, CAST(quality_rank AS INTEGER) AS quality_rank, CAST(latency_rank AS INTEGER) AS latency_rank, CAST(balanced_score AS DOUBLE) AS balanced_score, CAST(balanced_rank AS INTEGER) AS balanced_rank FROM br")
def w21_rankings(spark, sf):
    s, names = _summary(spark, sf)
    return lb.routing_ranks(s, names).select("model", "quality_rank", "latency_rank", "balanced_score", "balanced_rank")


LANES = (
    ROUTE + ", ln AS (SELECT 'default' AS lane, 'Best balanced benchmark profile for general workloads.' AS reason, * FROM br WHERE balanced_rank = 1"
    " UNION ALL SELECT 'fast_path', 'Lowest observed latency among successful benchmark runs.', * FROM br WHERE latency_rank = 1"
    " UNION ALL SELECT 'high_accuracy', 'Best MASE among successful benchmark runs.', * FROM br WHERE quality_rank = 1)"
)


@query("f14_routing_lanes", LANES + " SELECT lane, model FROM ln")
def f14_routing_lanes(spark, sf):
    s, names = _summary(spark, sf)
    return lb.lanes(lb.routing_ranks(s, names)).select("lane", "model")


@query("f16_lane_rationale", LANES + " SELECT lane, model, reason, round(latency_ms, 4) AS latency_ms, 'mase' AS primary_metric, round(mase, 6) AS primary_value FROM ln")
def f16_lane_rationale(spark, sf):
    s, names = _summary(spark, sf)
    return lb.lanes(lb.routing_ranks(s, names)).select(
        "lane", "model", "reason", "latency_ms", "primary_metric", F.round("primary_value", 6).alias("primary_value")
    )


@query("s25_benchmark_bundle", ROUTE + " SELECT CAST(quality_rank AS INTEGER) AS rank, model, round(mase, 6) AS mase, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(latency_ms, 4) AS latency_ms, folds_evaluated, weight AS learned_weight FROM br")
def s25_benchmark_bundle(spark, sf):
    """The bundle is written (result, routing, leaderboard) and the leaderboard read back."""
    from tidepanel.sources.sinks import save_bundle
    from tidepanel.session import scratch_path

    s, names = _summary(spark, sf)
    path = scratch_path(spark, "bundle")
    save_bundle(s, names, path)
    board = spark.read.csv(f"{path}/leaderboard", header=True, schema="rank int, model string, mase double, mae double, rmse double, latency_ms double, folds_evaluated long, learned_weight double")
    return board.select("rank", "model", F.round("mase", 6).alias("mase"), F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("latency_ms", 4).alias("latency_ms"), "folds_evaluated", "learned_weight")


@query("f10_compare_ranking", BENCH + " SELECT model, 'metrics.aggregate.mae' AS criterion, round(mae, 2) AS score, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank FROM ag")
def f10_compare_ranking(spark, sf):
    return lb.compare_ranking(_bench(spark, sf)["aggregate"]).withColumn("score", F.round("score", 2))


# ---- run reports: every event is one model run -----------------------------------------------

RUNS_SQL = (
    "WITH runs AS (SELECT event_id AS run_id, ts, event_type AS model, 'd' || CAST(user_id % 7 AS VARCHAR) AS dataset,"
    " CASE event_id % 3 WHEN 0 THEN 'benchmark_target_only' WHEN 1 THEN 'contract_best_effort_covariates' ELSE 'contract_strict' END AS scenario,"
    " CASE WHEN event_id % 11 = 0 THEN 'fail' WHEN event_id % 13 = 0 THEN 'skip' ELSE 'pass' END AS status,"
    " CASE WHEN event_id % 22 = 0 THEN 503 WHEN event_id % 33 = 0 THEN 400 WHEN event_id % 55 = 0 THEN NULL ELSE 200 END AS http_status,"
    " CASE event_id % 6 WHEN 0 THEN 'DEPENDENCY_MISSING: x' WHEN 1 THEN 'No module named y' WHEN 2 THEN 'read timed out' WHEN 3 THEN 'payload_build_error' WHEN 4 THEN 'status mismatch' ELSE NULL END AS error,"
    " value AS latency_ms, value / 2 AS mae, value / 3 AS rmse, value / 4 AS smape, value / 5 AS mape, value / 100 AS mase FROM events),"
    " cl AS (SELECT *, CASE WHEN status <> 'fail' THEN NULL WHEN http_status = 400 THEN 'BAD_REQUEST' WHEN http_status IN (502, 503) THEN CASE WHEN lower(error) LIKE '%dependency_missing%' THEN 'DEPENDENCY_GATED' ELSE 'RUNNER_ERROR' END"
    " WHEN error IS NULL THEN 'EXECUTION_ERROR' WHEN lower(error) LIKE '%dependency_missing%' OR lower(error) LIKE '%no module named%' THEN 'DEPENDENCY_GATED' WHEN lower(error) LIKE '%timed out%' THEN 'TIMEOUT'"
    " WHEN lower(error) LIKE '%payload_build_error%' THEN 'PAYLOAD_BUILD_ERROR' WHEN lower(error) LIKE '%status mismatch%' THEN 'CONTRACT_MISMATCH' ELSE 'EXECUTION_ERROR' END AS klass FROM runs)"
)


def runs(spark, sf):
    k = F.col("event_id")
    v = F.col("value")
    return table(spark, sf, "events").select(
        k.alias("run_id"),
        "ts",
        F.col("event_type").alias("model"),
        F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("dataset"),
        F.when(k % 3 == 0, "benchmark_target_only").when(k % 3 == 1, "contract_best_effort_covariates").otherwise("contract_strict").alias("scenario"),
        F.when(k % 11 == 0, "fail").when(k % 13 == 0, "skip").otherwise("pass").alias("status"),
        F.when(k % 22 == 0, 503).when(k % 33 == 0, 400).when(k % 55 == 0, None).otherwise(200).alias("http_status"),
        F.when(k % 6 == 0, "DEPENDENCY_MISSING: x").when(k % 6 == 1, "No module named y").when(k % 6 == 2, "read timed out")
        .when(k % 6 == 3, "payload_build_error").when(k % 6 == 4, "status mismatch").alias("error"),
        v.alias("latency_ms"), (v / 2).alias("mae"), (v / 3).alias("rmse"), (v / 4).alias("smape"), (v / 5).alias("mape"), (v / 100).alias("mase"),
    )


@query("c04_classify_errors", RUNS_SQL + " SELECT klass AS error_class, count(*) AS runs, min(run_id) AS first_run FROM cl WHERE klass IS NOT NULL GROUP BY 1")
def c04_classify_errors(spark, sf):
    c = lb.classify_error(F.col("error"), F.col("status"), F.col("http_status"))
    r = runs(spark, sf).withColumn("error_class", c).where("error_class is not null")
    return r.groupBy("error_class").agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first_run"))


def _means(digits):
    return ", ".join(f"round(avg({m}) FILTER (WHERE status = 'pass'), {digits}) AS {m}" for m in lb.RUN_METRICS)


@query(
    "a17_model_leaderboard",
    RUNS_SQL + ", b AS (SELECT model, count(*) AS rows, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed,"
    " count(*) FILTER (WHERE status = 'skip') AS skipped, round(avg(latency_ms) FILTER (WHERE status = 'pass'), 6) AS mean_latency_ms,"
    " round(quantile_cont(latency_ms, 0.5) FILTER (WHERE status = 'pass'), 3) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95) FILTER (WHERE status = 'pass'), 3) AS latency_p95_ms,"
    " avg(smape) FILTER (WHERE status = 'pass') AS sm, " + _means(6) + " FROM runs GROUP BY 1)"
    " SELECT * EXCLUDE (sm), round(CAST(passed AS DOUBLE) / rows, 6) AS success_rate, CAST(row_number() OVER (ORDER BY sm, latency_p50_ms, model) AS INTEGER) AS rank FROM b",
)
def a17_model_leaderboard(spark, sf):
    l = lb.model_leaderboard(runs(spark, sf))
    return l.select(
        "model", "rows", "passed", "failed", "skipped", "success_rate", "rank", F.round("mean_latency_ms", 6).alias("mean_latency_ms"),
        F.round("latency_p50_ms", 3).alias("latency_p50_ms"), F.round("latency_p95_ms", 3).alias("latency_p95_ms"), *[F.round(m, 6).alias(m) for m in lb.RUN_METRICS],
    )


@query(
    "a18_dataset_breakdown",
    RUNS_SQL + " SELECT dataset, count(*) AS rows, string_agg(DISTINCT model, ',' ORDER BY model) AS models, round(CAST(count(*) FILTER (WHERE status = 'pass') AS DOUBLE) / count(*), 6) AS success_rate,"
    " count(*) FILTER (WHERE klass = 'TIMEOUT') AS timeouts, count(*) FILTER (WHERE klass = 'BAD_REQUEST') AS bad_requests, " + _means(6) + " FROM cl GROUP BY 1",
)
def a18_dataset_breakdown(spark, sf):
    d = lb.dataset_breakdown(runs(spark, sf))
    n = lambda k: F.coalesce(F.col("failures")[k], F.lit(0)).cast("long")
    return d.select(
        "dataset", "rows", F.array_join("models", ",").alias("models"), "success_rate", n("TIMEOUT").alias("timeouts"), n("BAD_REQUEST").alias("bad_requests"),
        *[F.round(m, 6).alias(m) for m in lb.RUN_METRICS],
    )


@query(
    "a19_failure_and_scenario_counts",
    RUNS_SQL + " SELECT 'error' AS kind, klass AS label, count(*) AS failed, CAST(0 AS BIGINT) AS passed, CAST(0 AS BIGINT) AS skipped FROM cl WHERE klass IS NOT NULL GROUP BY 2"
    " UNION ALL SELECT 'scenario', scenario, count(*) FILTER (WHERE status = 'fail'), count(*) FILTER (WHERE status = 'pass'), count(*) FILTER (WHERE status = 'skip') FROM runs GROUP BY 2",
)
def a19_failure_and_scenario_counts(spark, sf):
    r = runs(spark, sf)
    zero = F.lit(0).cast("long")
    a = lb.failure_summary(r).select(F.lit("error").alias("kind"), F.col("error_class").alias("label"), F.col("failures").alias("failed"), zero.alias("passed"), zero.alias("skipped"))
    b = lb.scenario_summary(r).select(F.lit("scenario").alias("kind"), F.col("scenario").alias("label"), F.col("fail").alias("failed"), F.col("pass").alias("passed"), F.col("skip").alias("skipped"))
    return a.unionByName(b)


@query(
    "a20_run_summary",
    RUNS_SQL + " SELECT coalesce(model, '__all__') AS model, count(*) AS rows, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'fail') = 0 AS gate_pass,"
    " round(avg(latency_ms) FILTER (WHERE status = 'pass'), 6) AS mean_latency_ms, round(avg(smape) FILTER (WHERE status = 'pass' AND scenario = 'benchmark_target_only'), 6) AS smape FROM runs GROUP BY ROLLUP (model)",
)
def a20_run_summary(spark, sf):
    s = lb.run_summary(runs(spark, sf))
    return s.select("model", "rows", "failed", "gate_pass", F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("smape", 6).alias("smape"))


@query(
    "p18_run_gate",
    RUNS_SQL + ", g AS (SELECT *, CASE WHEN http_status IS NULL AND error IS NOT NULL THEN 'request failed before status was returned: ' || error WHEN http_status IN (502, 503) THEN 'unhandled runner error status ' || http_status"
    " WHEN http_status IS NULL OR http_status <> 200 THEN 'status mismatch for ' || scenario || ': expected 200, got ' || coalesce(CAST(http_status AS VARCHAR), 'None')"
    " WHEN scenario = 'contract_best_effort_covariates' AND model = 'click' AND run_id % 2 = 0 THEN 'expected best_effort warnings for unsupported covariates but got none' END AS reason FROM runs)"
    " SELECT coalesce(reason, '') AS reason, reason IS NULL AS gate_pass, count(*) AS runs FROM g GROUP BY 1, 2",
)
def p18_run_gate(spark, sf):
    r = runs(spark, sf).withColumns({"problem": F.lit(None).cast("string"), "needs_warning": F.col("model") == "click", "warnings": F.col("run_id") % 2})
    return lb.gate(r).groupBy(F.coalesce("reason", F.lit("")).alias("reason"), "gate_pass").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "p18_forecast_shape",
    OD + " x AS (SELECT series_id, count(*) AS points FROM panel WHERE pos >= n - 14 AND NOT (series_id = '5-LOW' AND pos % 2 = 0) GROUP BY 1)"
    " SELECT series_id, points, CASE WHEN points <> 14 THEN printf('mean length mismatch: expected 14, got %d', points) ELSE '' END AS problem FROM x",
)
def p18_forecast_shape(spark, sf):
    p = pn.orders_daily(spark, sf).where((F.col("pos") >= F.col("n") - 14) & ~((F.col("series_id") == "5-LOW") & (F.col("pos") % 2 == 0)))
    rows = p.select(F.lit("m").alias("model"), "series_id", F.col("y").alias("mean"))
    return lb.forecast_shape(rows, 14).select("series_id", "points", F.coalesce("problem", F.lit("")).alias("problem"))


@query(
    "f15_blended_routing",
    RUNS_SQL + ", p AS (SELECT model, avg(smape + 10 * mase) AS q, avg(latency_ms / 1000) AS l FROM runs WHERE status = 'pass' GROUP BY 1)"
    " SELECT (SELECT model FROM p ORDER BY 0.7 * q + 0.3 * l, model LIMIT 1) AS \"default\", (SELECT model FROM p ORDER BY l, q, model LIMIT 1) AS fast_path, (SELECT model FROM p ORDER BY q, l, model LIMIT 1) AS high_accuracy",
)
def f15_blended_routing(spark, sf):
    return lb.blended_routing(runs(spark, sf))


@query(
    "a21_usage_metering",
    "SELECT coalesce(CAST(user_id AS VARCHAR), '__total__') AS key_id, count(*) AS requests, round(sum(greatest(value - 50, 0)), 4) AS inference_ms, CAST(sum(user_id % 5) AS BIGINT) AS series,"
    " strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY ROLLUP (user_id)",
)
def a21_usage_metering(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key_id"), (F.col("value") - 50).alias("inference_ms"), (F.col("user_id") % 5).alias("series"), "ts")
    return lb.usage(ev).select("key_id", "requests", F.round("inference_ms", 4).alias("inference_ms"), "series", pn.stamp("updated_at"))


@query(
    "a22_latency_histogram",
    RUNS_SQL + " SELECT model AS endpoint, CAST(http_status // 100 AS VARCHAR) || 'xx' AS status_class, le, count(*) FILTER (WHERE latency_ms <= le) AS count FROM runs,"
    " (VALUES (10.0::DOUBLE), (50.0::DOUBLE), (100.0::DOUBLE), ('inf'::DOUBLE)) AS v(le) WHERE http_status IS NOT NULL GROUP BY 1, 2, 3",
)
def a22_latency_histogram(spark, sf):
    return lb.latency_histogram(runs(spark, sf).where("http_status is not null").withColumnRenamed("model", "endpoint"), [10.0, 50.0, 100.0])


@query("w23_last_n_per_key", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def w23_last_n_per_key(spark, sf):
    return wn.last_n(table(spark, sf, "events"), 20, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("t07_history_limit", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def t07_history_limit(spark, sf):
    return wn.last_n(table(spark, sf, "events"), 50, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "event_id")


# ---- recommendation and selection, one row per user series -----------------------------------

REGISTRY_SQL = (
    "reg(name, family, license, needs_acceptance, max_horizon, forecast_ready, past_num, past_cat, fut_num, fut_cat, static) AS (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else (str(v) if isinstance(v, (bool, int)) else f"'{v}'") for v in r) + ")" for r in registry.MODELS)
    + ")"
)
# Users: odd ids carry past covariates, ids divisible by 3 future ones, by 5 static ones, by 4 categorical kinds.
PROFILE_SQL = (
    f"WITH {REGISTRY_SQL}, prof AS (SELECT 'u' || user_id AS series_id, count(*) AS points, CASE WHEN user_id % 2 = 0 THEN 'D' ELSE 'auto' END AS freq, user_id % 2 = 1 AS has_past,"
    " user_id % 3 = 0 AS has_future, user_id % 5 = 0 AS has_static, CASE WHEN user_id % 4 = 0 AND (user_id % 2 = 1 OR user_id % 3 = 0) THEN 'categorical' ELSE 'numeric' END AS kind FROM events GROUP BY user_id),"
    " x AS (SELECT *, name AS model, concat_ws(';', CASE WHEN NOT forecast_ready THEN 'forecast_not_ready' END, CASE WHEN needs_acceptance OR license LIKE '%-nc%' THEN 'restricted_license' END,"
    " CASE WHEN has_past AND NOT (CASE WHEN kind = 'numeric' THEN past_num ELSE past_cat END) THEN 'missing_past_covariates_' || kind END,"
    " CASE WHEN has_future AND NOT (CASE WHEN kind = 'numeric' THEN fut_num ELSE fut_cat END) THEN 'missing_future_covariates_' || kind END,"
    " CASE WHEN has_static AND NOT static THEN 'missing_static_covariates' END, CASE WHEN max_horizon < {h} THEN 'horizon_exceeds_limit:' || max_horizon END) AS reasons,"
    " 100 + CASE WHEN has_past THEN 10 ELSE 0 END + CASE WHEN has_future THEN 15 ELSE 0 END + CASE WHEN has_static THEN 10 ELSE 0 END + CASE WHEN max_horizon IS NULL THEN 4 WHEN max_horizon - {h} <= greatest(5, max_horizon // 10) THEN 12 ELSE 8 END"
    " + CASE WHEN freq <> 'auto' THEN 1 ELSE 0 END - CASE WHEN needs_acceptance THEN 2 ELSE 0 END - CASE WHEN family = 'mock' THEN 25 ELSE 0 END AS score FROM prof, reg)"
)


def profiles(spark, sf):
    ev = table(spark, sf, "events")
    u = F.col("user_id")
    sid = F.concat(F.lit("u"), u.cast("string"))
    panel = ev.select(sid.alias("series_id"))
    freq = ev.select(sid.alias("series_id"), F.when(u % 2 == 0, "D").otherwise("auto").alias("frequency")).distinct()
    cat = F.when(u % 4 == 0, "x")
    role = F.array_compact(F.array(F.when(u % 2 == 1, "past"), F.when(u % 3 == 0, "future"), F.when(u % 5 == 0, "static")))
    cov = ev.select(sid.alias("series_id"), F.explode(role).alias("role"), cat.alias("cat")).distinct()
    return sel.series_profile(panel, cov, freq)


@query(
    "a15_dataset_profile",
    PROFILE_SQL.format(h=48) + " SELECT count(*) AS series_count, CAST(sum(points) AS BIGINT) AS history_points, round(avg(points), 6) AS average_history_length, bool_or(has_past) AS has_past, bool_or(has_future) AS has_future,"
    " bool_or(has_static) AS has_static, CASE WHEN bool_or(kind = 'categorical') THEN 'categorical' ELSE 'numeric' END AS kind, 'D' AS freq_hint FROM prof",
)
def a15_dataset_profile(spark, sf):
    return sel.dataset_profile(profiles(spark, sf)).withColumn("average_history_length", F.round("average_history_length", 6))


@query("f17_recommend_models", PROFILE_SQL.format(h=48) + " SELECT series_id, model, reasons, CASE WHEN reasons = '' THEN CAST(score AS DOUBLE) END AS score FROM x")
def f17_recommend_models(spark, sf):
    r = sel.recommend(profiles(spark, sf), registry.MODELS, 48)
    return r.select("series_id", "model", F.array_join("reasons", ";").alias("reasons"), F.col("score").cast("double").alias("score"))


@query("t02_top_models", PROFILE_SQL.format(h=48) + " SELECT series_id, model, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, model) AS rank FROM x WHERE reasons = '') WHERE rank <= 3")
def t02_top_models(spark, sf):
    return sel.top_models(sel.recommend(profiles(spark, sf), registry.MODELS, 48)).select("series_id", "model", "rank")


def _case(table_, default):
    return "CASE family " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + f" ELSE {default} END"


AUTO_SQL = (
    PROFILE_SQL + ", bon AS (SELECT *, {spd} AS sb, coalesce(w * 30.0, {acc}) AS ab, CASE WHEN points <= 64 AND family IN ('timesfm', 'torch') THEN 3.0 ELSE 0 END + CASE WHEN {h}.0 / max_horizon >= 0.85 THEN -4.0 ELSE 0 END"
    " + CASE WHEN {h}.0 / max_horizon <= 0.35 THEN 2.0 ELSE 0 END + CASE WHEN has_future AND family IN ('timesfm', 'torch', 'uni2ts') THEN 2.0 ELSE 0 END AS pa,"
    " CASE WHEN points <= 64 AND family = 'mock' THEN 2.0 ELSE 0 END + CASE WHEN {h}.0 / max_horizon >= 0.85 THEN -2.0 ELSE 0 END + CASE WHEN {h}.0 / max_horizon <= 0.35 THEN 1.0 ELSE 0 END"
    " + CASE WHEN family IN ('timesfm', 'sundial', 'toto') THEN 2.0 ELSE 0 END AS psp FROM x LEFT JOIN wts USING (model) WHERE reasons = ''),"
    " au AS (SELECT series_id, model, st, CAST(round(score + CASE st WHEN 'fastest' THEN sb + psp WHEN 'best_accuracy' THEN ab + pa WHEN 'ensemble' THEN 0.75 * ab + 0.25 * sb + pa ELSE 0.55 * ab + 0.45 * sb + 0.6 * pa + 0.4 * psp END, 4) AS DOUBLE) AS score"
    " FROM bon, (VALUES ('fastest'), ('best_accuracy'), ('ensemble'), ('auto')) AS s(st)), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY st, series_id ORDER BY score DESC, model) AS INTEGER) AS rank FROM au)"
).replace("{spd}", _case(registry.SPEED, 0.0)).replace("{acc}", _case(registry.ACCURACY, 0.0))
NO_W = AUTO_SQL.replace("WITH reg", "WITH wts AS (SELECT CAST(NULL AS VARCHAR) AS model, CAST(NULL AS DOUBLE) AS w WHERE false), reg")
# Learned weights: users grouped by id modulo 3 lend their mean event value to three models.
W_SQL = AUTO_SQL.replace("WITH reg", "WITH wts AS (SELECT CASE user_id % 3 WHEN 0 THEN 'chronos2' WHEN 1 THEN 'lag-llama' ELSE 'tide' END AS model, round(avg(value) / 100, 3) AS w FROM events GROUP BY 1), reg")


def _weights(spark, sf):
    ev = table(spark, sf, "events")
    k = F.col("user_id") % 3
    return ev.groupBy(F.when(k == 0, "chronos2").when(k == 1, "lag-llama").otherwise("tide").alias("model")).agg(F.round(F.avg("value") / 100, 3).alias("weight"))


@query("f18_auto_select", NO_W.format(h=48) + " SELECT st AS strategy, series_id, model, score FROM rk WHERE rank = 1")
def f18_auto_select(spark, sf):
    p, m = profiles(spark, sf), registry.MODELS
    res = None
    for st in ("fastest", "best_accuracy", "ensemble", "auto"):
        one = sel.auto_rank(p, m, 48, st, series_count=4).where("rank = 1").select(F.lit(st).alias("strategy"), "series_id", "model", "score")
        res = one if res is None else res.unionByName(one)
    return res


@query("t03_ensemble_members", NO_W.format(h=48) + " SELECT series_id, model, rank FROM rk WHERE st = 'ensemble' AND rank <= 3")
def t03_ensemble_members(spark, sf):
    r = sel.auto_rank(profiles(spark, sf), registry.MODELS, 48, "ensemble", series_count=4)
    return sel.chosen(r, "ensemble", 3).select("series_id", "model", "rank")


@query("j11_learned_weight_join", W_SQL.format(h=48) + " SELECT series_id, model, score, rank FROM rk WHERE st = 'best_accuracy' AND rank <= 2")
def j11_learned_weight_join(spark, sf):
    r = sel.auto_rank(profiles(spark, sf), registry.MODELS, 48, "best_accuracy", series_count=4, weights=_weights(spark, sf))
    return r.where("rank <= 2").select("series_id", "model", "score", "rank")


@query(
    "f39_two_stage_plan",
    NO_W.format(h=48) + ", f AS (SELECT series_id, model FROM rk WHERE st = 'fastest' AND rank = 1), b AS (SELECT series_id, model FROM rk WHERE st = 'best_accuracy' AND rank = 1)"
    " SELECT series_id, 1 AS stage, 'fastest' AS strategy, model FROM f UNION ALL SELECT b.series_id, 2, 'best_accuracy', b.model FROM b JOIN f ON f.series_id = b.series_id AND f.model <> b.model",
)
def f39_two_stage_plan(spark, sf):
    return sel.two_stages(profiles(spark, sf), registry.MODELS, 48, series_count=4)


@query(
    "f19_fallback_forecast",
    OD + " s AS (SELECT series_id, max(n) AS n, arg_max(y, pos) AS lv FROM panel GROUP BY 1), r AS (SELECT CAST(h AS INTEGER) AS step FROM range(1, 8) AS x(h))"
    " SELECT 'last_value' AS model, 2 AS rank, series_id, step, lv AS mean, CAST(NULL AS VARCHAR) AS error FROM s, r WHERE n < 1700"
    " UNION ALL SELECT 'seasonal_naive', 1, p.series_id, step, y, NULL FROM panel p, r WHERE n >= 1700 AND pos = n - 7 + ((step - 1) % 7)",
)
def f19_fallback_forecast(spark, sf):
    """First choice fails for series shorter than 800 days; those fall through to their second."""
    history = pn.orders_daily(spark, sf)
    cands = history.select("series_id").distinct().select(
        "series_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("seasonal_naive").alias("model")), F.struct(F.lit(2).alias("rank"), F.lit("last_value").alias("model")))).alias("c")
    ).select("series_id", "c.*")
    runners = {"seasonal_naive": lambda h, k: fc.seasonal_naive(h.where("n >= 1700"), k), "last_value": fc.last_value}
    return sel.forecast_with_fallback(history, cands, runners, 7, [1, 2])


AUTO_CHAIN = (
    OD + " s AS (SELECT series_id, max(n) AS n, arg_max(y, pos) AS lv FROM panel GROUP BY 1), c AS (SELECT *, CASE WHEN n >= 1700 THEN 3 ELSE 4 END AS rank FROM s)"
)


@query(
    "f19_auto_forecast",
    AUTO_CHAIN + " SELECT series_id, CASE rank WHEN 3 THEN 'seasonal_naive' ELSE 'last_value' END AS model, 'ranked' AS stage, rank, CAST(step AS INTEGER) AS step,"
    " CASE rank WHEN 3 THEN (SELECT y FROM panel p WHERE p.series_id = c.series_id AND p.pos = c.n - 7 + ((step - 1) % 7)) ELSE lv END AS mean FROM c, range(1, 8) AS r(step)",
)
def f19_auto_forecast(spark, sf):
    """Lane, then the model asked for, then the ranked ones: the lane's model fails, the one asked for isn't there, and short
    series fall through to the last."""
    r = _auto(spark, sf)["forecast"]
    return r.select("series_id", "model", "stage", "rank", "step", "mean")


@query(
    "f19_attempts",
    AUTO_CHAIN + " SELECT series_id, 1 AS rank, 'lane' AS stage, 'broken' AS model, 'failed' AS outcome, 'RuntimeError: out of order' AS reason FROM c"
    " UNION ALL SELECT series_id, 2, 'explicit', 'unheard_of', 'failed', 'model is not available' FROM c"
    " UNION ALL SELECT series_id, 3, 'ranked', 'seasonal_naive', CASE rank WHEN 3 THEN 'ok' ELSE 'failed' END, CASE rank WHEN 3 THEN NULL ELSE 'no forecast' END FROM c"
    " UNION ALL SELECT series_id, 4, 'ranked', 'last_value', 'ok', NULL FROM c WHERE rank = 4",
)
def f19_attempts(spark, sf):
    return _auto(spark, sf)["attempts"]


def _auto(spark, sf):
    history = pn.orders_daily(spark, sf)

    def broken(y, horizon, levels):
        raise RuntimeError("out of order")

    slot = fc.GroupedModel("broken", broken)
    ranked = history.select("series_id").distinct().select(
        "series_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("seasonal_naive").alias("model")), F.struct(F.lit(2).alias("rank"), F.lit("last_value").alias("model")))).alias("c")
    ).select("series_id", "c.*")
    runners = {
        "broken": lambda h, k: fc.forecast(h, slot, k), "seasonal_naive": lambda h, k: fc.seasonal_naive(h.where("n >= 1700"), k), "last_value": fc.last_value,
    }
    return sel.auto_forecast(history, ranked, runners, 7, lane="broken", explicit="unheard_of")
