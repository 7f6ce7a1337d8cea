"""Result writers: forecasts, benchmark bundles and learned weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.operators import leaderboard as lb
from tidepanel.session import cut_lineage


def flatten_forecast(forecast: DataFrame, levels: Sequence[float] = ()) -> DataFrame:
    """Forecast rows with one column q<level> per level, instead of the quantile map."""
    bands = [F.col("quantiles")[f"{q:g}"].alias(f"q{q:g}") for q in levels]
    keep = [c for c in ("series_id", "freq", "start_ts", "step", "ts", "mean") if c in forecast.columns]
    return forecast.select(*keep, *bands)


def save_weights(weights: DataFrame, fingerprint: str, path: str) -> None:
    """Replace the weights of one dataset in a table partitioned by fingerprint."""
    rows = weights.withColumn("fingerprint", F.lit(fingerprint))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(path)


def load_weights(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Weights of one dataset (empty if there are none); only its partition is read."""
    return spark.read.parquet(path).where(F.col("fingerprint") == fingerprint)


def save_bundle(summary: DataFrame, metrics: Sequence[str], path: str) -> None:
    """Write `result` and `routing` as JSON and `leaderboard` as CSV below `path`.

    `summary` has one row per model; it is evaluated once.
    """
    summary = cut_lineage(summary.sparkSession, summary, "bundle-summary")
    ranks = lb.routing_ranks(summary, metrics)
    summary.write.mode("overwrite").json(f"{path}/result")
    lb.lanes(ranks).write.mode("overwrite").json(f"{path}/routing")
    cols = ["rank", "model", *metrics, "latency_ms", "folds_evaluated", "learned_weight"]
    lb.leaderboard(summary, metrics).select(*cols).write.mode("overwrite").csv(f"{path}/leaderboard", header=True)
