"""Walk-forward benchmark: models x folds x series as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators import folds, forecast as fc, leaderboard as lb, metrics as mt
from tidepanel.session import cut_lineage


def run_benchmark(
    panel: DataFrame,
    models: Sequence[str | fc.GroupedModel],
    horizon: int,
    num_folds: int = 3,
    metric_names: Sequence[str] = ("mase", "mae", "rmse"),
    quantiles: Sequence[float] = (),
    season: int = 1,
    min_train_length: int | None = None,
    measure: bool = False,
) -> dict[str, DataFrame]:
    """`fold_metrics` (model, fold, metric, value), `aggregate` (model, metric, value), `weights`, `errors`.

    With `measure`, every model is called series by series and fold by fold, the calls are timed inside the tasks, and `latency`
    (model, latency_ms: mean of a call, calls, failed) is there as well.

    The fold metrics, a few rows per model, are written once; everything after them starts from there.
    """
    spark = panel.sparkSession
    rows = folds.fold_rows(panel, horizon, num_folds, min_train_length)
    history, actuals = folds.fold_history(rows), folds.fold_actuals(rows)
    keys = ["fold", "series_id"]
    stacked = None
    for m in models:
        one = (fc.timed_forecast if measure else fc.forecast)(history, m, horizon, quantiles, keys)
        stacked = one if stacked is None else stacked.unionByName(one)
    if measure:  # metrics and latency come from the same calls
        stacked = cut_lineage(spark, stacked, "timed-forecasts")
    good = stacked.where(F.col("error").isNull()).withColumnRenamed("mean", "p")
    pairs = good.join(actuals, [*keys, "step"])
    scale = mt.naive_scale(history, season, keys) if mt.NEEDS_SCALE & set(metric_names) else None
    per_series = mt.evaluate(pairs, metric_names, ["model", *keys], scale)
    fold_metrics = mt.macro(mt.to_long(per_series, metric_names, ["model", *keys]), ["model", "fold"])
    fold_metrics = cut_lineage(spark, fold_metrics, "fold-metrics")
    aggregate = lb.aggregate_folds(fold_metrics)
    names = spark.createDataFrame([(m.name if isinstance(m, fc.GroupedModel) else m,) for m in models], "model string")
    timed = {}
    if measure:
        calls = stacked.groupBy("model", *keys).agg(F.max("elapsed_ms").alias("ms"), F.count("error").alias("errors"))
        timed = {"latency": calls.groupBy("model").agg(F.avg("ms").alias("latency_ms"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("errors") > 0).alias("failed"))}
    return {
        **timed,
        "fold_metrics": fold_metrics,
        "aggregate": aggregate,
        "weights": lb.inverse_error_weights(aggregate, names),
        "errors": stacked.where(F.col("error").isNotNull()).select("model", *keys, "error"),
    }


def summary_rows(result: dict[str, DataFrame], latency: DataFrame | None, metric_names: Sequence[str]) -> DataFrame:
    """One row per model: metrics as columns, latency_ms, folds_evaluated, learned_weight. `latency` (model, latency_ms) is the
    measured one of the result, or comes from elsewhere."""
    latency = (result["latency"] if latency is None else latency).select("model", "latency_ms")
    wide = result["aggregate"].groupBy("model").pivot("metric", list(metric_names)).agg(F.first("value"))
    evaluated = result["fold_metrics"].groupBy("model").agg(F.count_distinct("fold").alias("folds_evaluated"))
    return (
        wide.join(evaluated, "model")
        .join(result["weights"].withColumnRenamed("weight", "learned_weight"), "model")
        .join(latency, "model", "left")
    )
