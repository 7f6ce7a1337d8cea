"""Aggregates over model runs: weights, leaderboards, breakdowns, routing, usage and latency reports."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import finite, ratio
from tidepanel.operators.blocks import exact_quantiles, number_rows

RUN_METRICS = ("mae", "rmse", "smape", "mape", "mase")
QUALITY_ORDER = ("mase", "smape", "mae", "rmse")  # priority of quality metrics in rankings (fixed values)
RANK_ORDER = ("smape", "mape", "mae", "rmse", "mase", "wape", "rmsse", "pinball")  # comparison priority (fixed values)


def aggregate_folds(fold_metrics: DataFrame) -> DataFrame:
    """(model, metric, value): mean of the finite fold values."""
    return fold_metrics.groupBy("model", "metric").agg(F.avg(finite("value")).alias("value")).where("value is not null")


def inverse_error_weights(aggregate: DataFrame, models: DataFrame, metric: str = "mase") -> DataFrame:
    """(model, weight): inverse error shares, or 1.0 for every model if any model's error is unusable."""
    err = aggregate.where(F.col("metric") == metric).select("model", finite("value").alias("e"))
    every = Window.partitionBy()
    joined = models.select("model").distinct().join(err, "model", "left")
    bad = F.max((F.col("e").isNull() | (F.col("e") <= 0)).cast("int")).over(every) == 1
    inv = F.when(F.col("e") > 0, 1 / F.col("e"))
    share = F.round(inv / F.sum(inv).over(every), 6)
    return joined.select("model", F.when(bad, F.lit(1.0)).otherwise(share).alias("weight"))


def _digest(batches):
    """Streaming hash of the lines in order: constant memory however many there are."""
    h, started = hashlib.sha256(), False
    for pdf in batches:
        for line in pdf["line"]:
            h.update(("|" + line if started else line).encode())
            started = True
    yield pd.DataFrame({"fingerprint": [h.hexdigest()[:16]]})


def dataset_fingerprint(series: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over `id:length:freq` joined by `|` in id order.

    One SHA-256 has to see all lines one after another: they are sorted and hashed by one task, as a stream of one short line
    per series in constant memory (the sort spills). bucket_fingerprint spreads that, at the price of another value.
    """
    line = F.concat_ws(":", "series_id", F.col("points").cast("string"), "freq").alias("line")
    return series.orderBy("series_id").select(line).coalesce(1).mapInPandas(_digest, "fingerprint string")


def bucket_fingerprint(series: DataFrame) -> DataFrame:
    """Not the reference's value: first 16 hex digits of a SHA-256 over hashes of the lines `id:length:freq` of all series.

    Lines are hashed, joined by `|` in order, per bucket (the first three hex digits of the id's SHA-256); the fingerprint is
    the SHA-256 of the `bucket=hash` texts, joined by `|` in order. No task sees more than the lines of a bucket or 4096 hashes.
    """
    line = F.concat_ws(":", "series_id", F.col("points").cast("string"), "freq")
    bucket = F.substring(F.sha2(F.coalesce("series_id", F.lit("")), 256), 1, 3)
    per = series.groupBy(bucket.alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "|"), 256).alias("hash"))
    joined = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "bucket", "hash"))), "|")
    return per.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def classify_error(error: Column, status: Column, http: Column) -> Column:
    """Failure class of a run (NULL unless it failed)."""
    text = F.lower(F.coalesce(error, F.lit("")))
    has = text.contains
    gated = has("dependency_missing") | has("missing optional")
    return F.when(
        status == "fail",
        F.when(http == 400, "BAD_REQUEST")
        .when(http.isin(502, 503), F.when(gated, "DEPENDENCY_GATED").otherwise("RUNNER_ERROR"))
        .when(text == "", "EXECUTION_ERROR")
        .when(gated | has("no module named") | has("not installed"), "DEPENDENCY_GATED")
        .when(has("timed out") | has("timeout"), "TIMEOUT")
        .when(has("payload_build_error"), "PAYLOAD_BUILD_ERROR")
        .when(has("status mismatch"), "CONTRACT_MISMATCH")
        .otherwise("EXECUTION_ERROR"),
    )


def _status_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))],
    ]


def _passed(c: str) -> Column:
    return F.when(F.col("status") == "pass", F.col(c))


def model_leaderboard(runs: DataFrame, order: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per model: status counts, success rate, latency mean / p50 / p95, mean metrics, rank by sMAPE."""
    base = runs.groupBy("model").agg(
        *_status_counts(), F.avg(_passed("latency_ms")).alias("mean_latency_ms"), *[F.avg(_passed(m)).alias(m) for m in RUN_METRICS]
    )
    timed = runs.where((F.col("status") == "pass") & F.col("latency_ms").isNotNull()).select("model", "ts", *order, "latency_ms")
    lat = exact_quantiles(
        number_rows(timed, ("ts", *order), ["model"]), "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}, ["model"]
    ).drop("n")
    out = base.withColumn("success_rate", F.round(F.col("passed") / F.col("rows"), 6)).join(lat, "model", "left")
    w = Window.partitionBy(F.col("smape").isNull()).orderBy("smape", F.col("latency_p50_ms").asc_nulls_last(), "model")
    return out.withColumn("rank", F.when(F.col("smape").isNotNull(), F.row_number().over(w)))


def dataset_breakdown(runs: DataFrame) -> DataFrame:
    """Per dataset: rows, participating models, success rate, mean metrics and failure classes."""
    failed = classify_error(F.col("error"), F.col("status"), F.col("http_status"))
    base = runs.groupBy("dataset").agg(
        *_status_counts(),
        F.array_sort(F.collect_set("model")).alias("models"),
        F.avg(_passed("latency_ms")).alias("mean_latency_ms"),
        *[F.avg(_passed(m)).alias(m) for m in RUN_METRICS],
    )
    classes = (
        runs.withColumn("_c", failed)
        .where(F.col("_c").isNotNull())
        .groupBy("dataset", "_c")
        .agg(F.count(F.lit(1)).alias("k"))
        .groupBy("dataset")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "k")))).alias("failures"))
    )
    return base.withColumn("success_rate", F.round(F.col("passed") / F.col("rows"), 6)).join(classes, "dataset", "left")


def failure_summary(runs: DataFrame) -> DataFrame:
    """Failures by class over all runs."""
    c = classify_error(F.col("error"), F.col("status"), F.col("http_status"))
    return runs.where(c.isNotNull()).groupBy(c.alias("error_class")).agg(F.count(F.lit(1)).alias("failures"))


def scenario_summary(runs: DataFrame) -> DataFrame:
    """Counts of pass / fail / skip by scenario; an unknown status counts as fail."""
    s = F.when(F.col("status").isin("pass", "skip"), F.col("status")).otherwise("fail")
    out = runs.withColumn("_s", s).groupBy("scenario").pivot("_s", ["pass", "fail", "skip"]).count().na.fill(0)
    return out.withColumn("total", F.col("pass") + F.col("fail") + F.col("skip"))


def run_summary(runs: DataFrame, benchmark: str = "benchmark_target_only") -> DataFrame:
    """Per model and overall (`__all__`): counts, mean latency, benchmark metrics, gate_pass."""
    scored = lambda m: F.avg(F.when((F.col("status") == "pass") & (F.col("scenario") == benchmark), F.col(m))).alias(m)
    out = runs.rollup("model").agg(
        F.grouping("model").alias("_g"), *_status_counts(), F.avg(_passed("latency_ms")).alias("mean_latency_ms"), *[scored(m) for m in RUN_METRICS]
    )
    return out.withColumns(
        {"model": F.when(F.col("_g") == 1, "__all__").otherwise(F.col("model")), "gate_pass": F.col("failed") == 0}
    ).drop("_g")


def forecast_shape(forecast: DataFrame, horizon: int) -> DataFrame:
    """(model, series_id, points, problem): NULL problem where the mean has `horizon` values."""
    per = forecast.groupBy("model", "series_id").agg(F.count("mean").alias("points"))
    text = F.format_string(f"mean length mismatch: expected {horizon}, got %d", F.col("points"))
    return per.withColumn("problem", F.when(F.col("points") != horizon, text))


def gate(runs: DataFrame, expected_status: int = 200) -> DataFrame:
    """Pass / reason of each run: lost request, runner error status, status mismatch, shape, warnings."""
    http = F.col("http_status")
    reason = (
        F.when(http.isNull() & F.col("error").isNotNull(), F.concat(F.lit("request failed before status was returned: "), "error"))
        .when(http.isin(502, 503), F.concat(F.lit("unhandled runner error status "), http.cast("string")))
        .when(
            ~http.eqNullSafe(F.lit(expected_status)),
            F.concat(F.lit("status mismatch for "), "scenario", F.lit(f": expected {expected_status}, got "), F.coalesce(http.cast("string"), F.lit("None"))),
        )
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(
            (F.col("scenario") == "contract_best_effort_covariates") & F.col("needs_warning") & (F.col("warnings") == 0),
            F.lit("expected best_effort warnings for unsupported covariates but got none"),
        )
    )
    return runs.withColumns({"reason": reason, "gate_pass": reason.isNull()})


# ---- comparison and routing ------------------------------------------------------------------


def compare_ranking(metrics: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """(model, criterion, score, rank) by the first metric in priority order any model has, else timing."""
    order = F.create_map(*[F.lit(x) for i, m in enumerate(RANK_ORDER) for x in (m, i)])
    scored = metrics.where(F.col("metric").isin(*RANK_ORDER) & F.col("value").isNotNull()).select(
        "model", F.concat(F.lit("metrics.aggregate."), "metric").alias("criterion"), F.col("value").alias("score"), order[F.col("metric")].alias("_o")
    )
    if timing is not None:
        scored = scored.unionByName(
            timing.select("model", F.lit("timing.total_ms").alias("criterion"), F.col("latency_ms").alias("score"), F.lit(len(RANK_ORDER)).alias("_o"))
        )
    best = F.min("_o").over(Window.partitionBy())  # a few rows per model
    picked = scored.withColumn("_b", best).where(F.col("_o") == F.col("_b")).drop("_o", "_b")
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy("criterion").orderBy("score", "model")))


def routing_ranks(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Quality, latency and balanced (0.7 / 0.3) ranks of models with any quality metric.

    `summary` has one row per model: the metrics as columns and latency_ms.
    """
    ordered = [m for m in QUALITY_ORDER if m in metrics] + [m for m in metrics if m not in QUALITY_ORDER]
    key = [F.coalesce(finite(m), F.lit(float("inf"))) for m in ordered]
    ok = summary.where(F.coalesce(*[finite(m) for m in ordered]).isNotNull())
    one = Window.partitionBy()  # one row per model
    out = ok.withColumns(
        {
            "quality_rank": F.row_number().over(one.orderBy(*key, "latency_ms", "model")),
            "latency_rank": F.row_number().over(one.orderBy("latency_ms", *key, "model")),
        }
    ).withColumn("balanced_score", F.round(0.7 * F.col("quality_rank") + 0.3 * F.col("latency_rank"), 4))
    rank = F.row_number().over(one.orderBy("balanced_score", "quality_rank", "latency_rank", "model"))
    return out.withColumns({"balanced_rank": rank, "primary_metric": F.lit(ordered[0]), "primary_value": F.col(ordered[0])})


def leaderboard(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Quality-first rank of every model, metrics missing counting as infinite."""
    ordered = [m for m in QUALITY_ORDER if m in metrics] + [m for m in metrics if m not in QUALITY_ORDER]
    key = [F.coalesce(finite(m), F.lit(float("inf"))) for m in ordered]
    return summary.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*key, "latency_ms", "model")))


# Reasons per lane (fixed values).
LANE_REASON = {
    "default": "Best balanced benchmark profile for general workloads.",
    "fast_path": "Lowest observed latency among successful benchmark runs.",
}


def lanes(ranks: DataFrame) -> DataFrame:
    """(lane, model, reason, latency_ms, primary_metric, primary_value, quality_rank, latency_rank)."""
    best = F.concat(F.lit("Best "), F.upper("primary_metric"), F.lit(" among successful benchmark runs."))
    options = F.array_compact(
        F.array(
            F.when(F.col("balanced_rank") == 1, F.struct(F.lit("default").alias("lane"), F.lit(LANE_REASON["default"]).alias("reason"))),
            F.when(F.col("latency_rank") == 1, F.struct(F.lit("fast_path").alias("lane"), F.lit(LANE_REASON["fast_path"]).alias("reason"))),
            F.when(F.col("quality_rank") == 1, F.struct(F.lit("high_accuracy").alias("lane"), best.alias("reason"))),
        )
    )
    return ranks.select("*", F.explode(options).alias("l")).select(
        "l.lane", "model", "l.reason", F.round("latency_ms", 4).alias("latency_ms"), "primary_metric", "primary_value", "quality_rank", "latency_rank"
    )


def blended_routing(runs: DataFrame) -> DataFrame:
    """Routing over datasets: quality = sMAPE + 10 MASE, latency = p50 / 1000, 0.7 / 0.3 blend of values."""
    per = runs.where(F.col("status") == "pass").groupBy("model").agg(
        F.avg(F.col("smape") + 10 * F.col("mase")).alias("quality_score"), F.avg(F.col("latency_ms") / 1000).alias("latency_score")
    )
    blend = 0.7 * F.col("quality_score") + 0.3 * F.col("latency_score")
    return per.agg(
        F.min_by("model", F.struct(blend, "model")).alias("default"),
        F.min_by("model", F.struct("latency_score", "quality_score", "model")).alias("fast_path"),
        F.min_by("model", F.struct("quality_score", "latency_score", "model")).alias("high_accuracy"),
    )


# ---- usage -----------------------------------------------------------------------------------


def usage(events: DataFrame) -> DataFrame:
    """Requests, non-negative inference time, series and last update per key, and in total (`__total__`)."""
    out = events.rollup("key_id").agg(
        F.grouping("key_id").alias("_g"),
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.greatest("inference_ms", F.lit(0.0))).alias("inference_ms"),
        F.sum(F.greatest("series", F.lit(0))).alias("series"),
        F.max("ts").alias("updated_at"),
    )
    return out.withColumn("key_id", F.when(F.col("_g") == 1, "__total__").otherwise(F.col("key_id"))).drop("_g")


def latency_histogram(requests: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Cumulative request counts per endpoint, status class and latency bound (the last bound is infinite)."""
    limits = F.array(*[F.lit(float(b)) for b in (*bounds, float("inf"))])
    per = requests.groupBy("endpoint", F.concat(F.floor(F.col("http_status") / 100).cast("string"), F.lit("xx")).alias("status_class")).agg(
        *[F.count_if(F.col("latency_ms") <= b).alias(f"b{i}") for i, b in enumerate((*bounds, float("inf")))]
    )
    cells = F.arrays_zip(limits.alias("le"), F.array(*[F.col(f"b{i}") for i in range(len(bounds) + 1)]).alias("count"))
    return per.select("endpoint", "status_class", F.explode(cells).alias("c")).select("endpoint", "status_class", "c.le", "c.count")


def weight_ratio(weights: DataFrame) -> DataFrame:
    """Weights as shares of their sum."""
    return weights.withColumn("share", ratio("weight", F.sum("weight").over(Window.partitionBy())))
