"""Combining forecasts of several models, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.numeric import ratio

TRIM = 0.1  # fraction cut or clipped at each end
METHODS = ("mean", "median", "trimmed_mean", "winsorized_mean")


def incomplete_members(forecasts: DataFrame, horizon: int) -> DataFrame:
    """(model, series_id, warning) of members whose horizon differs."""
    per = forecasts.groupBy("model", "series_id").agg(F.count("mean").alias("k"))
    text = F.format_string(f"%s: horizon mismatch (%d vs {horizon}), skipped", F.col("model"), F.col("k"))
    return per.where(F.col("k") != horizon).select("model", "series_id", text.alias("warning"))


def merge(
    forecasts: DataFrame,
    method: str = "mean",
    weights: DataFrame | None = None,
    horizon: int | None = None,
    min_models: int = 1,
) -> DataFrame:
    """(series_id, step, mean, models) from (model, series_id, step, mean).

    With `horizon`, members of a different length are left out. Missing or non-positive weights count
    as 1. Fewer than three values fall back to the weighted mean. Steps with fewer than `min_models`
    members are dropped.
    """
    if method not in METHODS:
        raise ValueError(f"unknown ensemble method {method!r}")
    rows = forecasts.where(F.col("mean").isNotNull()).select("model", "series_id", "step", "mean")
    if horizon is not None:
        rows = rows.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("series_id", "model"))).where(F.col("_k") == horizon)
    w = F.lit(1.0)
    if weights is not None:
        rows = rows.join(weights.select("model", F.col("weight").alias("_w")), "model", "left")
        w = F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)
    rows = rows.select("model", "series_id", "step", F.col("mean").alias("v"), w.alias("w"))
    cell = Window.partitionBy("series_id", "step")  # one row per model
    by_value = cell.orderBy("v", "model")
    r = rows.withColumns(
        {
            "i": F.row_number().over(by_value) - 1,
            "k": F.count(F.lit(1)).over(cell),
            "cum": F.sum("w").over(by_value.rowsBetween(Window.unboundedPreceding, 0)),
            "tot": F.sum("w").over(cell),
        }
    ).withColumn("cut", F.greatest(F.lit(1), F.floor(F.col("k") * TRIM)))
    plain = ratio(F.sum(F.col("v") * F.col("w")), F.sum("w"))
    few = F.max("k") < 3
    if method == "mean":
        value = plain
    elif method == "median":
        value = F.min(F.when(F.col("cum") >= F.col("tot") / 2, F.col("v")))
    elif method == "trimmed_mean":
        kept = (F.col("i") >= F.col("cut")) & (F.col("i") < F.col("k") - F.col("cut"))
        inner = ratio(F.sum(F.when(kept, F.col("v") * F.col("w"))), F.sum(F.when(kept, F.col("w"))))
        value = F.when(few, plain).otherwise(inner)
    else:
        r = r.withColumns(
            {
                "lo": F.max(F.when(F.col("i") == F.col("cut"), F.col("v"))).over(cell),
                "hi": F.max(F.when(F.col("i") == F.col("k") - F.col("cut") - 1, F.col("v"))).over(cell),
            }
        )
        clipped = F.greatest("lo", F.least("hi", "v"))
        value = F.when(few, plain).otherwise(ratio(F.sum(clipped * F.col("w")), F.sum("w")))
    return (
        r.groupBy("series_id", "step")
        .agg(F.round(value, 8).alias("mean"), F.count(F.lit(1)).alias("models"))
        .where(F.col("models") >= min_models)
    )


def union_outputs(*forecasts: DataFrame) -> DataFrame:
    """Stack outputs of several models by column name."""
    out = forecasts[0]
    for f in forecasts[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
