"""Preparation chain: validate, fill, smooth, split, scale on the training part, window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators import clean, scale, spline, windows as wn
from tidepanel.operators.blocks import attach
from tidepanel.operators.smoothing import smoothing_spline


def prepare_panel(
    panel: DataFrame,
    fill: str = "cubic",
    smoothing_window: int = 5,
    smoothing: str = "legacy",
    scaling: str = "standard",
    lookback: int = 24,
    horizon: int = 1,
    train_ratio: float = 0.7,
    val_ratio: float = 0.15,
    **limits,
) -> dict[str, DataFrame]:
    """Returns `checks`, `panel` (y, interpolated, smooth, scaled, part), `params` and `windows`.

    Series that fail validation stay out of everything but `checks`.
    """
    checks = clean.validate_series(panel, **limits)
    good = checks.where("ok").select("series_id")
    kept = attach(panel, good.join(panel.groupBy("series_id").agg(F.max("n").alias("n")), "series_id"))
    filled = clean.impute(kept, fill)
    if smoothing == "pspline":
        smooth = spline.evaluate(attach(filled, spline.fit(filled, strategy="pspline")), out="smooth").drop("breaks", "pieces")
    elif smoothing == "smoothing_spline":
        smooth = smoothing_spline(filled).withColumnRenamed("fitted", "smooth").drop("residual", "lam")
    elif smoothing == "legacy":
        smooth = wn.savgol(filled, smoothing_window)
    else:
        raise ValueError("smoothing must be legacy, pspline or smoothing_spline")
    base = smooth.withColumnRenamed("y", "interpolated").withColumnRenamed("smooth", "y").withColumn(
        "part", wn.split_label(train_ratio, val_ratio)
    )
    scaler = scale.build(scaling)
    if scaler is None:
        params, scaled = None, base.withColumn("scaled", F.col("y"))
    else:
        params = scale.fit(base, scaler, F.col("part") == "train")
        scaled = scale.apply(base, scaler, params)
    made = wn.supervised_windows(scaled.select("series_id", "pos", "n", F.col("scaled").alias("y")), lookback, horizon)
    return {"checks": checks, "panel": scaled.withColumnRenamed("y", "smooth"), "params": params, "windows": made}
