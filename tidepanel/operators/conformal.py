"""Split and adaptive conformal intervals from a calibration set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators.blocks import KEY, exact_quantiles

EPSILON = 1e-8


def calibrate(pairs: DataFrame, coverage: float = 0.9, method: str = "split", keys: Sequence[str] = KEY) -> DataFrame:
    """(keys, n, q_hat): the conformal quantile of |a - p| (relative to |p| when adaptive).

    `pairs` carries a, p and pos / n within keys.
    """
    if not 0 < coverage < 1:
        raise ValueError(f"coverage must be in (0, 1), got {coverage}")
    gap = F.abs(F.col("a") - F.col("p"))
    score = gap / (F.abs("p") + EPSILON) if method == "adaptive" else gap
    level = 1.0 - (1.0 - coverage)

    def rank(cnt):
        return F.least(F.ceil((cnt + 1) * F.lit(level)) / cnt, F.lit(1.0)) * (cnt - 1)

    return exact_quantiles(pairs.withColumn("_score", score), "_score", {"q_hat": (level, rank)}, keys)


def band_labels(coverage: float) -> tuple[str, str]:
    """Quantile labels of the bounds: two decimals, more where two would collide."""
    alpha = 1.0 - coverage
    digits = 2 if coverage <= 0.98 else 4
    return f"{alpha / 2:.{digits}f}", f"{1 - alpha / 2:.{digits}f}"


def intervals(forecast: DataFrame, calibration: DataFrame, coverage: float = 0.9, method: str = "split", keys: Sequence[str] = KEY) -> DataFrame:
    """Forecast with the bounds merged into its quantile map (the new ones win)."""
    low, high = band_labels(coverage)
    width = F.col("q_hat") * (F.abs("mean") + EPSILON) if method == "adaptive" else F.col("q_hat")
    bands = F.create_map(F.lit(low), F.col("mean") - width, F.lit(high), F.col("mean") + width)
    old = F.map_filter(F.coalesce("quantiles", F.create_map().cast("map<string,double>")), lambda k, _: ~k.isin(low, high))
    return forecast.join(calibration.select(*keys, "q_hat"), list(keys)).withColumn("quantiles", F.map_concat(old, bands)).drop("q_hat")


def horizon_warnings(forecast: DataFrame, calibration_horizon: int) -> DataFrame:
    """Series whose forecast length differs from the calibration horizon."""
    per = forecast.groupBy("series_id").agg(F.count(F.lit(1)).alias("k"))
    text = F.format_string(
        f"Series '%s': calibration horizon ({calibration_horizon}) differs from forecast horizon (%d); intervals may be approximate",
        F.col("series_id"),
        F.col("k"),
    )
    return per.where((F.lit(calibration_horizon) > 1) & (F.col("k") != calibration_horizon)).select("series_id", text.alias("warning"))
