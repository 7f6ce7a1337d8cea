"""Forecast accuracy metrics as aggregate columns over (actual `a`, prediction `p`) pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.numeric import ratio
from tidepanel.operators.blocks import KEY, framed

EPS = 1e-9  # floor of denominators under zero_policy="epsilon"


def _ap() -> tuple[Column, Column]:
    return F.col("a"), F.col("p")


def _mape(zero_policy: str) -> Column:
    a, p = _ap()
    if zero_policy == "epsilon":
        return F.avg(F.abs((a - p) / F.greatest(F.abs(a), F.lit(EPS)))) * 100
    return F.avg(F.when(a != 0, F.abs((a - p) / a))) * 100


def _smape(zero_policy: str) -> Column:
    a, p = _ap()
    den = F.abs(a) + F.abs(p)
    if zero_policy == "epsilon":
        return F.avg(2 * F.abs(a - p) / F.greatest(den, F.lit(EPS))) * 100
    return F.avg(F.when(den > 0, 200 * F.abs(a - p) / den))


def _mae(_: str) -> Column:
    a, p = _ap()
    return F.avg(F.abs(a - p))


def _rmse(_: str) -> Column:
    a, p = _ap()
    return F.sqrt(F.avg((a - p) * (a - p)))


def _wape(_: str) -> Column:
    a, p = _ap()
    return ratio(F.sum(F.abs(a - p)), F.sum(F.abs(a))) * 100


def _mase(_: str) -> Column:
    a, p = _ap()
    return ratio(F.avg(F.abs(a - p)), F.max("scale_abs"))


def _rmsse(_: str) -> Column:
    a, p = _ap()
    return F.sqrt(ratio(F.avg((a - p) * (a - p)), F.max("scale_sq")))


def _pinball(_: str) -> Column:
    """Losses of the row's quantile map are summed per row, so one aggregate serves all levels."""
    return ratio(F.sum("q_loss"), F.sum("q_count"))


# Metric name -> aggregate builder. Callers may add their own entries.
REGISTRY: dict[str, Callable[[str], Column]] = {
    "mape": _mape,
    "mase": _mase,
    "mae": _mae,
    "rmse": _rmse,
    "smape": _smape,
    "wape": _wape,
    "rmsse": _rmsse,
    "pinball": _pinball,
}
NEEDS_SCALE = {"mase", "rmsse"}


def naive_scale(history: DataFrame, season: int = 1, keys: Sequence[str] = KEY) -> DataFrame:
    """In-sample scale per series: mean |y - lag(y, season)| and its square; NULL if n <= season."""
    diffs = framed(
        history.select(*keys, "pos", "n", "y"),
        lambda w: {"_d": F.col("y") - F.lag("y", season).over(w)},
        back=season,
        keys=keys,
    )
    return diffs.groupBy(*keys).agg(
        F.avg(F.abs("_d")).alias("scale_abs"), F.avg(F.col("_d") * F.col("_d")).alias("scale_sq")
    )


def pinball_terms(pairs: DataFrame, quantiles: str = "quantiles") -> DataFrame:
    """Add the summed quantile loss and level count of each row's {level: value} map.

    Levels that are not numbers in (0, 1) are skipped.
    """
    entries = F.filter(
        F.map_entries(quantiles), lambda e: (e.key.try_cast("double") > 0) & (e.key.try_cast("double") < 1)
    )

    def loss(e: Column) -> Column:
        q, err = e.key.try_cast("double"), F.col("a") - e.value
        return F.when(err >= 0, q * err).otherwise((q - 1) * err)

    return pairs.withColumns(
        {
            "q_loss": F.aggregate(F.transform(entries, loss), F.lit(0.0), lambda acc, x: acc + x),
            "q_count": F.size(entries),
        }
    )


def evaluate(
    pairs: DataFrame,
    names: Sequence[str],
    keys: Sequence[str] = KEY,
    scale: DataFrame | None = None,
    zero_policy: str = "skip",
) -> DataFrame:
    """Metrics per key, one column each. NULL marks an undefined metric."""
    unknown = [m for m in names if m not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    per_row = pairs
    if NEEDS_SCALE & set(names):
        if scale is None:
            raise ValueError("mase and rmsse need the in-sample scale")
        on = [k for k in keys if k in scale.columns]
        per_row = pairs.join(scale, on, "left")
    if "pinball" in names:
        per_row = pinball_terms(per_row)
    return per_row.groupBy(*keys).agg(*[REGISTRY[m](zero_policy).alias(m) for m in names])


def to_long(wide: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value) rows; undefined metrics are dropped."""
    return wide.unpivot(list(keys), list(names), "metric", "value").where(F.col("value").isNotNull())


def macro(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the defined per-series values."""
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("value"))


def with_macro_row(wide: DataFrame, names: Sequence[str], label: str = "__macro__") -> DataFrame:
    """Per-series metric rows plus one macro row, from one evaluation of the metrics.

    Every row counts for its own series (a mean of one value) and for the macro row.
    """
    both = wide.select(F.explode(F.array("series_id", F.lit(label))).alias("series_id"), *names)
    return both.groupBy("series_id").agg(*[F.avg(m).alias(m) for m in names])


def match_forecasts(actuals: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Actual/prediction pairs by (keys, step); steps present on one side only fall away."""
    return actuals.join(forecast, [*keys, "step"])


def unmatched_series(actuals: DataFrame, forecast: DataFrame) -> DataFrame:
    """Warnings for series without any forecast row, and for horizons that differ."""
    have = forecast.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_forecast"))
    want = actuals.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_actual"))
    missing = F.concat(F.lit("metrics skipped for series '"), "series_id", F.lit("': missing matching forecast output"))
    trimmed = F.format_string(
        "metrics evaluation for series '%s' uses %d points because forecast mean length (%d) != actuals length (%d)",
        F.col("series_id"),
        F.least("n_forecast", "n_actual"),
        F.col("n_forecast"),
        F.col("n_actual"),
    )
    return (
        want.join(have, "series_id", "left")
        .withColumn(
            "warning",
            F.when(F.col("n_forecast").isNull(), missing).when(F.col("n_forecast") != F.col("n_actual"), trimmed),
        )
        .where(F.col("warning").isNotNull())
        .select("series_id", "warning")
    )
