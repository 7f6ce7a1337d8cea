"""What in a history drives its forecast: lag correlation, importance of points, occlusion, permutation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import clip, ratio
from tidepanel.operators.analysis import autocorrelation
from tidepanel.operators.blocks import attach, framed, per_series
from tidepanel.operators.forecast import NATIVE, GroupedModel, local_model
from tidepanel.operators.windows import truncate_context

SEASON_LAGS = (7, 12, 24, 30)


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """First k rows per series in the given order."""
    w = Window.partitionBy("series_id").orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _own_lags(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of products per lag of one centred series that fits a block."""
    d = pdf.sort_values("pos")["d"].to_numpy(float)
    n = len(d)
    power = np.abs(np.fft.rfft(d, 2 * n)) ** 2
    lag = np.arange(1, min(n - 1, n // 2))
    return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "n": n, "lag": lag, "s": np.fft.irfft(power, 2 * n)[lag]})


def lag_correlation(panel: DataFrame, tile_bits: int | None = None) -> DataFrame:
    """(series_id, lag, pos, strength, importance): |unbiased ACF| for all lags below half the length.

    The sums of products of all lags are the inverse transform of the power spectrum of the zero-padded series: in one task for
    a series of up to BLOCK_ROWS rows, by distributed transforms for longer ones. Exchanges carry a few values per row.
    """
    from tidepanel.operators import blocks as bl, fourier

    stats = per_series(panel, F.avg("y").alias("_m"), F.var_pop("y").alias("_v")).where((F.col("n") >= 4) & (F.col("_v") > 0))
    d = attach(panel.select("series_id", "pos", "n", "y"), stats).withColumn("d", F.col("y") - F.col("_m"))
    short = d.where(F.col("n") <= bl.BLOCK_ROWS).groupBy("series_id").applyInPandas(_own_lags, "series_id string, n long, lag long, s double")
    long = d.where(F.col("n") > bl.BLOCK_ROWS)
    sums = short if long.isEmpty() else short.unionByName(fourier.lag_sums(long, "d", tile_bits))
    acf = sums.drop("n").join(stats.select("series_id", "n", "_v"), "series_id").select(
        "series_id", "n", "lag", F.abs(F.col("s") / (F.col("_v") * (F.col("n") - F.col("lag")))).alias("strength")
    )
    total = acf.groupBy("series_id").agg(F.sum("strength").alias("_t"))
    return acf.join(total, "series_id").select(
        "series_id",
        "lag",
        (F.col("n") - 1 - F.col("lag")).alias("pos"),
        "strength",
        F.coalesce(ratio("strength", "_t"), F.lit(0.0)).alias("importance"),
    )


def top_lags(correlations: DataFrame, k: int = 5) -> DataFrame:
    return top(correlations, k, F.col("strength").desc(), F.col("lag"))


def temporal_importance(panel: DataFrame, top_k: int = 8) -> DataFrame:
    """The most influential points: 0.45 recency + 0.35 change + 0.20 deviation, each scaled by its maximum."""
    base = framed(panel, lambda w: {"_delta": F.coalesce(F.col("y") - F.lag("y", 1).over(w), F.lit(0.0))}, back=1)
    base = attach(base, per_series(base, F.avg("y").alias("_m"))).withColumn("_mag", F.abs(F.col("y") - F.col("_m")))
    peaks = per_series(base, F.max(F.abs("_delta")).alias("_md"), F.max("_mag").alias("_mm"))
    n, pos = F.col("n"), F.col("pos")
    norm = lambda v, m: F.coalesce(ratio(v, m), F.lit(0.0))
    scored = attach(base, peaks).withColumn(
        "_s", 0.45 * (pos + 1) / n + 0.35 * norm(F.abs("_delta"), F.col("_md")) + 0.20 * norm(F.col("_mag"), F.col("_mm"))
    )
    scored = attach(scored, per_series(scored, F.max("_s").alias("_ms")))
    best = top(scored.withColumn("importance", F.col("_s") / F.col("_ms")), top_k, F.col("importance").desc(), F.col("pos"))
    reason = (
        F.when(pos == n - 1, "most recent observation anchors the near-term forecast")
        .when(F.col("importance") > 0.75, "large local change and recency made this point influential")
        .otherwise("point contributed through recency and deviation from baseline")
    )
    direction = F.when(F.col("_delta") > 0, "positive").when(F.col("_delta") < 0, "negative").otherwise("neutral")
    return best.select(
        "series_id", (n - pos).alias("lag"), "ts", F.col("y").alias("value"), F.round("importance", 4).alias("importance"),
        direction.alias("direction"), reason.alias("reason"),
    )


def history_shares(panel: DataFrame, forecast: DataFrame) -> DataFrame:
    """Shares of forecast drift, best seasonal correlation and volatility of differences, and the driver."""
    ends = per_series(panel, F.max_by("y", "pos").alias("_last"))
    fc = forecast.groupBy("series_id").agg(F.max_by("mean", "step").alias("_fc"))
    season = autocorrelation(panel, SEASON_LAGS)
    best = F.greatest(
        F.lit(0.0), *[F.when(F.col("n") >= 2 * k, clip(F.col(f"corr_{k}"))).otherwise(0.0) for k in SEASON_LAGS]
    )
    steps = framed(panel, lambda w: {"_d": F.col("y") - F.lag("y", 1).over(w)}, back=1)
    vol = steps.groupBy("series_id").agg(F.stddev_pop("_d").alias("_vol"))
    j = ends.join(fc, "series_id").join(season, "series_id").join(vol, "series_id")
    j = j.select(
        "series_id",
        F.abs(F.col("_fc") - F.col("_last")).alias("t"),
        F.when(F.col("n") >= 6, best).otherwise(0.0).alias("s"),
        F.when(F.col("n") >= 3, F.coalesce("_vol", F.lit(0.0))).otherwise(0.0).alias("r"),
    )
    total = F.col("t") + F.col("s") + F.col("r")
    share = lambda c, d: F.round(F.coalesce(ratio(F.col(c), total), F.lit(d)), 4)
    driver = F.when(total <= 0, "trend").when((F.col("t") >= F.col("s")) & (F.col("t") >= F.col("r")), "trend").when(
        F.col("s") >= F.col("r"), "seasonal"
    ).otherwise("residual")
    return j.select(
        "series_id", share("t", 0.34).alias("trend"), share("s", 0.33).alias("seasonal"), share("r", 0.33).alias("residual"),
        driver.alias("dominant_driver"),
    )


# ---- occlusion and permutation ------------------------------------------------------------------
#
# The mean forecast of a native model is a weighted sum of the history, so changing some points moves it by the sum of their
# weights times the changes: no variant is ever forecast. Any other model is asked inside the task that holds the series.


def _last_value_weight(horizon: int) -> Column:
    return (F.col("pos") == F.col("n") - 1).cast("double")


def _seasonal_naive_weight(horizon: int, season: int = 7) -> Column:
    m = F.when(F.col("n") >= season, F.lit(season)).otherwise(F.lit(1))
    first = F.col("pos") - (F.col("n") - m) + 1
    times = F.when((first >= 1) & (first <= horizon), F.floor((horizon - first) / m) + 1).otherwise(0)
    return times / F.lit(float(horizon))


def _linear_trend_weight(horizon: int) -> Column:
    n = F.col("n").cast("double")
    spread = n * (n * n - 1) / 12
    ahead = n - 1 + (horizon + 1) / 2 - (n - 1) / 2
    return F.when(n == 1, 1.0).otherwise(1 / n + ahead * (F.col("pos") - (n - 1) / 2) / spread)


WEIGHTS: dict[str, Callable[[int], Column]] = {
    "last_value": _last_value_weight,
    "seasonal_naive": _seasonal_naive_weight,
    "linear_trend": _linear_trend_weight,
}


def _named(predict: str | GroupedModel | Callable) -> str | GroupedModel:
    """A native forecaster by its name; names and per-series models as they are."""
    if isinstance(predict, str | GroupedModel):
        return predict
    for name, fn in NATIVE.items():
        if fn is predict:
            return name
    raise TypeError("predict must be a native model or a per-series model (GroupedModel)")


def _asked(panel: DataFrame, model: str | GroupedModel, horizon: int, variants: Callable) -> DataFrame:
    """(series_id, pos, _raw): variants(series, y) yields (positions, copies of y with changes, share); the mean change of a model's
    mean forecast goes to those positions. Each series travels once and its variants live inside the task."""
    model = local_model(model) if isinstance(model, str) else model
    call, fn = type(model)._call, model.fn

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        series, y, pos = pdf["series_id"].iloc[0], pdf["y"].to_numpy(float), pdf["pos"].to_numpy()
        stamps = pdf["ts"].to_numpy()
        raw = np.zeros(len(y))

        def mean(values: np.ndarray) -> float:
            request = {
                "keys": {"series_id": series}, "freq": None, "timestamps": stamps, "target": values, "past_covariates": {}, "future_covariates": {},
                "static": {}, "horizon": horizon, "quantiles": [],
            }
            return float(np.mean(np.asarray(call(fn, request)["mean"], float)))

        base = mean(y)
        for at, changed, share in variants(series, y):
            raw[at] += abs(mean(changed) - base) * share
        return pd.DataFrame({"series_id": series, "pos": pos, "n": len(y), "_raw": raw})

    ts = F.col("ts") if "ts" in panel.columns else F.lit(None).cast("timestamp")
    rows = panel.select("series_id", "pos", "y", ts.alias("ts"))
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, pos long, n long, _raw double")


def occlusion(panel: DataFrame, window: int = 5, horizon: int = 1, predict: str | GroupedModel = "last_value", context: int | None = None) -> DataFrame:
    """(series_id, pos, importance): change of the mean forecast when a window is set to the mean of the series.

    `predict` is a native model's name or a per-series model. `context` keeps the last points only; `pos` counts from its start.
    """
    panel, predict = truncate_context(panel, context) if context else panel, _named(predict)
    if isinstance(predict, str) and predict in WEIGHTS:
        base = attach(panel.select("series_id", "pos", "n", "y"), per_series(panel, F.avg("y").alias("_m")))
        moved = base.withColumn("_d", WEIGHTS[predict](horizon) * (F.col("_m") - F.col("y"))).withColumn("_w", F.floor(F.col("pos") / window))
        change = moved.groupBy("series_id", "_w").agg(F.max("n").alias("n"), F.abs(F.sum("_d")).alias("_c"), F.count(F.lit(1)).alias("_k"))
        rows = change.select("series_id", "n", (F.col("_c") / F.col("_k")).alias("_raw"), F.explode(F.sequence(F.col("_w") * window, F.col("_w") * window + F.col("_k") - 1)).alias("pos"))
        return _normalised(rows)

    def variants(series: str, y: np.ndarray):
        for a in range(0, len(y), window):
            changed = y.copy()
            changed[a : a + window] = y.mean()
            yield slice(a, a + window), changed, 1 / len(changed[a : a + window])

    return _normalised(_asked(panel, predict, horizon, variants))


def drawn(seed: int, size: Column, *parts: Column | str) -> Column:
    """A whole number from 0 to size - 1 drawn by hashing seed and parts; any engine with MD5 draws the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), size)


def permutation(
    panel: DataFrame, repeats: int = 5, horizon: int = 1, seed: int = 42, predict: str | GroupedModel = "last_value", context: int | None = None
) -> DataFrame:
    """(series_id, pos, importance): mean change of the mean forecast when a point is replaced by a random value of its series,
    `repeats` times. Draws are hashed from (seed, series, point, repeat). `predict` and `context` as in occlusion."""
    panel, predict = truncate_context(panel, context) if context else panel, _named(predict)
    if isinstance(predict, str) and predict in WEIGHTS:
        base = panel.select("series_id", "pos", "n", "y")
        plan = base.select("series_id", "n", F.col("pos").alias("at"), (WEIGHTS[predict](horizon)).alias("_c"), F.col("y").alias("_old"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
        plan = plan.where("_c <> 0").withColumn("pos", drawn(seed, F.col("n"), "series_id", "at", "rep"))
        new = plan.join(base.select("series_id", "pos", "y"), ["series_id", "pos"])
        raw = new.groupBy("series_id", F.col("at").alias("pos")).agg((F.sum(F.abs(F.col("_c") * (F.col("y") - F.col("_old")))) / repeats).alias("_raw"))
        return _normalised(base.join(raw, ["series_id", "pos"], "left").withColumn("_raw", F.coalesce("_raw", F.lit(0.0))))

    def variants(series: str, y: np.ndarray):
        for i in range(len(y)):
            for rep in range(1, repeats + 1):
                digits = hashlib.md5(f"{seed}:{series}:{i}:{rep}".encode()).hexdigest()[:15]
                changed = y.copy()
                changed[i] = y[int(digits, 16) % len(y)]
                yield i, changed, 1 / repeats

    return _normalised(_asked(panel, predict, horizon, variants))


def _normalised(rows: DataFrame) -> DataFrame:
    total = per_series(rows, F.sum("_raw").alias("_t"))
    return attach(rows, total).select(
        "series_id", "pos", F.coalesce(ratio("_raw", "_t"), F.lit(0.0)).alias("importance")
    )
