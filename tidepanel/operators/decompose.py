"""Trend / seasonal / residual decomposition and variance shares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.numeric import ratio
from tidepanel.operators import blocks as bl
from tidepanel.operators.blocks import attach, exact_quantiles, framed, halo, per_series
from tidepanel.operators.windows import moving_average_parts
from tidepanel.session import cut_lineage

SEASONAL = 7  # cycles that smooth a season


def moving_average(panel: DataFrame, period: int) -> DataFrame:
    """Moving-average parts; a series shorter than the period has its mean as trend."""
    p = max(period, 2)
    long = moving_average_parts(panel.where(F.col("n") >= p), p)
    short = panel.where(F.col("n") < p)
    short = attach(short, per_series(short, F.avg("y").alias("trend"))).withColumn("seasonal", F.col("y") - F.col("trend"))
    return long.unionByName(short.withColumn("resid", F.lit(0.0)))


def classical(panel: DataFrame, period: int, model: str = "additive") -> DataFrame:
    """Centred moving average with half weights for even periods, centred phase means, rest.

    Needs two full cycles; edges without a full window count as 0 in trend and residual.
    """
    p = max(period, 2)
    half = p // 2

    def build(w):
        if p % 2:
            total = F.sum("y").over(w.rowsBetween(-half, half))
        else:
            inner = F.sum("y").over(w.rowsBetween(-(half - 1), half - 1))
            total = inner + (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2
        full = (F.col("pos") >= half) & (F.col("pos") < F.col("n") - half)
        return {"_t": F.when(full, total / p)}

    t = framed(panel.where(F.col("n") >= 2 * p), build, back=half, fwd=half).withColumn("phase", F.col("pos") % p)
    d = F.col("y") / F.col("_t") if model == "multiplicative" else F.col("y") - F.col("_t")
    means = t.groupBy("series_id", "phase").agg(F.max("n").alias("n"), F.avg(d).alias("_m"))
    centre = means.groupBy("series_id").agg(F.avg("_m").alias("_c"))  # over phases
    s = F.col("_m") / F.col("_c") if model == "multiplicative" else F.col("_m") - F.col("_c")
    season = means.join(centre, "series_id").select("series_id", "n", "phase", s.alias("seasonal"))
    rows = attach(t, season, extra=["phase"])
    resid = (
        F.col("y") / F.col("_t") / F.col("seasonal") if model == "multiplicative" else F.col("y") - F.col("_t") - F.col("seasonal")
    )
    return rows.withColumns({"trend": F.coalesce("_t", F.lit(0.0)), "resid": F.coalesce(resid, F.lit(0.0))}).drop("_t", "phase")


def _loess(y: np.ndarray, width: int, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Degree-1 LOESS of y on 0..n-1 at the points `at`, tricube weights over the `width` nearest points."""
    n = len(y)
    x = np.arange(n, dtype=float)
    q = min(width, n)
    left = np.clip(np.floor(at - (q - 1) / 2), 0, n - q).astype(int)
    idx = left[:, None] + np.arange(q)
    dist = np.abs(x[idx] - at[:, None])
    span = dist.max(axis=1) + (max(width - n, 0) // 2)
    span = np.where(span > 0, span, 1.0)[:, None]
    w = np.where(dist <= 0.999 * span, (1 - np.clip(dist / span, 0, 1) ** 3) ** 3, 0.0) * weight[idx]
    total = w.sum(axis=1, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1.0), 1.0 / q)
    centre = (w * x[idx]).sum(axis=1)
    var = (w * (x[idx] - centre[:, None]) ** 2).sum(axis=1)
    tilt = np.where(var > 1e-9, (at - centre) / np.where(var > 1e-9, var, 1.0), 0.0)
    return (w * (1 + tilt[:, None] * (x[idx] - centre[:, None])) * y[idx]).sum(axis=1)


def _odd_above(v: float) -> int:
    k = int(np.ceil(v))
    return k if k % 2 else k + 1


def _widths(period: int) -> tuple[int, int]:
    """Windows of the trend and of the low-pass filter."""
    return _odd_above(1.5 * period / (1 - 1.5 / SEASONAL)), _odd_above(period + 1)


def _inner(y: np.ndarray, trend: np.ndarray, weight: np.ndarray, period: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) after some inner rounds of the published seasonal-trend LOESS procedure."""
    n, p = len(y), period
    trend_w, low_w = _widths(p)
    x, season = np.arange(n, dtype=float), np.zeros(n)
    for _ in range(times):
        detrended = y - trend
        cycle = np.empty(n + 2 * p)
        for k in range(p):
            sub, sw = detrended[k::p], weight[k::p]
            cycle[k::p][: len(sub) + 2] = _loess(sub, SEASONAL, np.arange(-1, len(sub) + 1, dtype=float), sw)
        low = cycle
        for width in (p, p, 3):
            low = np.convolve(low, np.ones(width) / width, mode="valid")
        low = _loess(low, low_w, x, np.ones(n))
        season = cycle[p : p + n] - low
        trend = _loess(y - season, trend_w, x, weight)
    return trend, season


def _rounds(robust: bool) -> tuple[int, int]:
    """Inner rounds, and how often weights are drawn from the residuals."""
    return (2, 15) if robust else (5, 0)


def _robust_weight(gap: np.ndarray, median: float) -> np.ndarray:
    u = gap / (6 * median) if median > 0 else np.zeros(len(gap))
    return np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1 - u**2) ** 2, 0.0))


def stl_parts(y: np.ndarray, period: int, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal) of a whole series."""
    inner, outer = _rounds(robust)
    trend, weight = np.zeros(len(y)), np.ones(len(y))
    for step in range(outer + 1):
        trend, season = _inner(y, trend, weight, max(period, 2), inner)
        if step < outer:
            gap = np.abs(y - season - trend)
            weight = _robust_weight(gap, float(np.median(gap)))
    return trend, season


def border(period: int, inner: int) -> int:
    """Rows beyond a block on which its trend and season depend: seasons are smoothed over three cycles on each side (and the
    next one, where a cut moves the window), then filtered over a cycle, smoothed, and the trend over its own window."""
    trend_w, low_w = _widths(period)
    return inner * ((SEASONAL // 2 + 2) * period + 2 + low_w // 2 + 1 + trend_w // 2 + 1)


def _stl_blocks(panel: DataFrame, period: int, robust: bool, size: int | None) -> DataFrame:
    """Long series: every round runs on blocks of positions with a border as wide as it looks; what is residual gives the
    weights of the next round by the exact median of the series. Rounds are written, so none is replayed."""
    inner, outer = _rounds(robust)
    wide = border(period, inner)
    schema = "series_id string, pos long, n long, y double, trend double, weight double, seasonal double, gap double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        y = pdf["y"].to_numpy(float)
        gap = pdf["gap"].to_numpy(float)
        weight = np.ones(len(y)) if np.isnan(gap).all() else _robust_weight(gap, float(pdf["median"].iloc[0]))
        trend, season = _inner(y, pdf["trend"].to_numpy(float), weight, period, inner)
        out = pdf.assign(trend=trend, weight=weight, seasonal=season, gap=np.abs(y - season - trend))
        return out[pdf["_own"].to_numpy(bool)][["series_id", "pos", "n", "y", "trend", "weight", "seasonal", "gap"]]

    state = panel.select("series_id", "pos", "n", "y", F.lit(0.0).alias("trend"), F.lit(None).cast("double").alias("gap"), F.lit(None).cast("double").alias("median"))
    for step in range(outer + 1):
        spread = halo(state, wide, wide, size=size)
        state = cut_lineage(panel.sparkSession, spread.groupBy("series_id", "_blk").applyInPandas(run, schema), "stl")
        if step < outer:
            state = attach(state, exact_quantiles(state, "gap", {"median": 0.5}))
    return state.select("series_id", "pos", "n", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid"))


def stl(panel: DataFrame, period: int, robust: bool = True, rows: int | None = None) -> DataFrame:
    """Seasonal-trend LOESS per series of two cycles or more; shorter ones by moving average.

    Series of up to `rows` (a block) are solved in one task, longer ones in blocks of that many positions with borders; the
    results are the same.
    """
    p, rows = max(period, 2), rows or bl.BLOCK_ROWS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t, s = stl_parts(pdf["y"].to_numpy(float), p, robust)
        return pdf.assign(trend=t, seasonal=s, resid=pdf["y"] - t - s)

    cols = ["series_id", "pos", "n", "y"]
    base = panel.select(*cols)
    enough = F.col("n") >= 2 * p
    whole = base.where(enough & (F.col("n") <= rows)).groupBy("series_id").applyInPandas(
        run, "series_id string, pos long, n long, y double, trend double, seasonal double, resid double"
    )
    long = base.where(enough & (F.col("n") > rows))
    if not long.isEmpty():
        whole = whole.unionByName(_stl_blocks(long, p, robust, rows))
    rest = moving_average(base.where(~enough), period).select(*cols, "trend", "seasonal", "resid")
    return whole.withColumn("method", F.lit("stl")).unionByName(rest.withColumn("method", F.lit("moving_average")))


METHODS = {
    "moving_average": moving_average,
    "classical_additive": lambda p, k: classical(p, k, "additive"),
    "classical_multiplicative": lambda p, k: classical(p, k, "multiplicative"),
    "stl": stl,
}


def strengths(parts: DataFrame) -> DataFrame:
    """Variance of each part over the total variance, their proportions, and the dominant one."""
    v = per_series(parts, *[F.var_pop(c).alias(f"_{c}") for c in ("y", "trend", "seasonal", "resid")])
    total = F.when(F.col("_y") == 0, 1.0).otherwise(F.col("_y"))
    out = v.select(
        "series_id",
        (F.col("_trend") / total).alias("trend_strength"),
        (F.col("_seasonal") / total).alias("seasonal_strength"),
        (F.col("_resid") / total).alias("residual_ratio"),
    )
    names = {"trend": "trend_strength", "seasonal": "seasonal_strength", "residual": "residual_ratio"}
    whole = F.col("trend_strength") + F.col("seasonal_strength") + F.col("residual_ratio")
    shares = {f"{k}_share": F.coalesce(F.round(ratio(F.col(c), whole), 4), F.lit(0.0)) for k, c in names.items()}
    out = out.withColumns(shares)
    dominant = (
        F.when((F.col("trend_share") >= F.col("seasonal_share")) & (F.col("trend_share") >= F.col("residual_share")), "trend")
        .when(F.col("seasonal_share") >= F.col("residual_share"), "seasonal")
        .otherwise("residual")
    )
    return out.withColumn("dominant", dominant)
