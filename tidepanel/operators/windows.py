"""Window features, supervised windows, splits, segments and smoothing along a panel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.operators.blocks import KEY, attach, framed, per_series, running_sum

# Default feature settings (fixed values).
AUTO_LAGS = (1, 2, 3, 7, 14, 28)
AUTO_WINDOWS = (7, 14, 28)
FOURIER_PERIODS = (7.0, 30.44, 365.25)
CALENDAR_DIVISORS = {
    "hour_of_day": 23.0,
    "day_of_week": 6.0,
    "day_of_month": 31.0,
    "month": 12.0,
    "quarter": 4.0,
    "week_of_year": 53.0,
    "is_weekend": 1.0,
}


def _lag_columns(w, lags: Sequence[int], auto: bool) -> dict[str, Column]:
    third = F.floor(F.col("n") / 3)
    out = {}
    for k in lags:
        col = F.lag("y", k).over(w)
        out[f"lag_{k}"] = F.when(F.lit(k) < third, col) if auto else F.when(F.lit(k) < F.col("n"), col)
    return out


def _rolling_columns(w, sizes: Sequence[int], auto: bool) -> dict[str, Column]:
    third = F.floor(F.col("n") / 3)
    out = {}
    for s in sizes:
        frame = w.rowsBetween(-(s - 1), 0)
        full = (F.col("pos") >= s - 1) & ((F.lit(s) < third) if auto else (F.lit(s) < F.col("n")))
        out[f"rolling_mean_{s}"] = F.when(full, F.avg("y").over(frame))
        out[f"rolling_std_{s}"] = F.when(full, F.stddev_pop("y").over(frame))
    return out


def lag_features(panel: DataFrame, lags: Sequence[int] | None = None) -> DataFrame:
    """lag_k columns; the automatic set keeps lags below a third of the series."""
    use = tuple(lags or AUTO_LAGS)
    return framed(panel, lambda w: _lag_columns(w, use, lags is None), back=max(use))


def rolling_features(panel: DataFrame, windows: Sequence[int] | None = None) -> DataFrame:
    """Full-window rolling mean and population deviation."""
    use = tuple(windows or AUTO_WINDOWS)
    return framed(panel, lambda w: _rolling_columns(w, use, windows is None), back=max(use) - 1)


def first_difference(panel: DataFrame) -> DataFrame:
    return framed(panel, lambda w: {"diff_1": F.col("y") - F.lag("y", 1).over(w)}, back=1)


def calendar_parts(ts: Column) -> dict[str, Column]:
    dow = F.weekday(ts)
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "week_of_year": F.weekofyear(ts),
        "is_weekend": F.when(dow >= 5, 1).otherwise(0),
    }


def calendar_features(panel: DataFrame) -> DataFrame:
    """Calendar parts scaled to [0, 1]; a part that is constant within a series is NULL there."""
    parts = calendar_parts(F.col("ts"))
    varies = per_series(panel, *[(F.min(c) < F.max(c)).alias(f"_{k}") for k, c in parts.items()])
    scaled = {k: F.when(F.col(f"_{k}"), c / F.lit(CALENDAR_DIVISORS[k])) for k, c in parts.items()}
    return attach(panel, varies).withColumns(scaled).drop(*[f"_{k}" for k in parts])


def fourier_columns(periods: Sequence[float] = FOURIER_PERIODS, pairs: int = 3) -> dict[str, Column]:
    out = {}
    for p in periods:
        for k in range(1, pairs + 1):
            angle = F.lit(2.0) * F.pi() * k * F.col("pos") / F.lit(float(p))
            out[f"sin_{p}_{k}"], out[f"cos_{p}_{k}"] = F.sin(angle), F.cos(angle)
    return out


def feature_bundle(
    panel: DataFrame,
    lags: Sequence[int] | None = None,
    windows: Sequence[int] | None = None,
    fourier_pairs: int = 3,
    calendar: bool = True,
    differences: bool = True,
) -> DataFrame:
    """Calendar, lag, rolling, Fourier and difference features in one pass over one window."""
    use_lags, use_windows = tuple(lags or AUTO_LAGS), tuple(windows or AUTO_WINDOWS)

    def build(w):
        cols = {**_lag_columns(w, use_lags, lags is None), **_rolling_columns(w, use_windows, windows is None)}
        if differences:
            cols["diff_1"] = F.col("y") - F.lag("y", 1).over(w)
        return cols

    out = framed(panel, build, back=max(*use_lags, *use_windows)).withColumns(fourier_columns(pairs=fourier_pairs))
    return calendar_features(out) if calendar else out


def supervised_windows(panel: DataFrame, lookback: int, horizon: int = 1) -> DataFrame:
    """(series_id, start, x, label): `lookback` inputs and `horizon` labels, complete windows only.

    A window holding a NULL, NaN or infinite value is dropped.
    """

    def build(w):
        return {
            "x": F.collect_list("y").over(w.rowsBetween(-(lookback - 1), 0)),
            "label": F.collect_list("y").over(w.rowsBetween(1, horizon)),
        }

    clean = panel.withColumn("y", F.when(~F.isnan("y") & (F.abs("y") < float("inf")), F.col("y")))
    out = framed(clean, build, back=lookback - 1, fwd=horizon)
    full = (F.size("x") == lookback) & (F.size("label") == horizon)
    return out.where(full).select("series_id", (F.col("pos") - lookback + 1).alias("start"), "x", "label")


def multivariate_windows(
    panel: DataFrame, features: Sequence[str], target: str, lookback: int, horizon: int = 1, future: Sequence[str] = ()
) -> DataFrame:
    """Windows of feature rows, target-only labels, and optionally future feature rows."""
    row = F.array(*[F.col(c).cast("double") for c in features])
    ahead = F.array(*[F.col(c).cast("double") for c in future]) if future else None

    def build(w):
        cols = {
            "x": F.collect_list(row).over(w.rowsBetween(-(lookback - 1), 0)),
            "label": F.collect_list(target).over(w.rowsBetween(1, horizon)),
        }
        if ahead is not None:
            cols["future_x"] = F.collect_list(ahead).over(w.rowsBetween(1, horizon))
        return cols

    out = framed(panel, build, back=lookback - 1, fwd=horizon)
    cols = ["x", "label"] + (["future_x"] if future else [])
    full = (F.size("x") == lookback) & (F.size("label") == horizon)
    return out.where(full).select("series_id", (F.col("pos") - lookback + 1).alias("start"), *cols)


def split_label(train_ratio: float = 0.7, val_ratio: float = 0.15) -> Column:
    """train / val / test by position in the series."""
    train_end = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train_ratio)))
    val_end = F.least(
        F.greatest(train_end + 1, F.floor(F.col("n") * F.lit(train_ratio + val_ratio))), F.col("n") - 1
    )
    return F.when(F.col("pos") < train_end, "train").when(F.col("pos") < val_end, "val").otherwise("test")


def segments(panel: DataFrame, step_seconds: float) -> DataFrame:
    """Contiguous segments: a new one starts where the step is off by more than max(half a step, 1 s)."""
    tol = max(0.5 * step_seconds, 1.0)
    delta = (F.unix_micros("ts") - F.unix_micros("_prev")) / 1e6
    marked = framed(panel, lambda w: {"_prev": F.lag("ts", 1).over(w)}, back=1).withColumn(
        "_brk", F.when(F.col("_prev").isNull(), 0).otherwise((F.abs(delta - step_seconds) > tol).cast("int"))
    )
    return running_sum(marked, "_brk", "segment").drop("_prev", "_brk")


def segment_chunks(panel: DataFrame, step_seconds: float, context: int, horizon: int) -> DataFrame:
    """Non-overlapping chunks of context + horizon rows inside segments.

    A series without any full chunk is chunked as a whole, if it is long enough.
    """
    size = context + horizon
    seg = segments(panel, step_seconds)
    starts = seg.groupBy("series_id", "segment").agg(F.max("n").alias("n"), F.min("pos").alias("_s"), F.count(F.lit(1)).alias("_len"))
    good = starts.where(F.col("_len") >= size)
    whole = (
        starts.groupBy("series_id")
        .agg(F.max("n").alias("n"), F.max((F.col("_len") >= size).cast("int")).alias("_any"))
        .where((F.col("_any") == 0) & (F.col("n") >= size))
        .select("series_id", F.col("n"))
    )
    inside = attach(seg, good, extra=["segment"])
    fallback = attach(seg, whole).withColumns({"segment": F.lit(-1).cast("long"), "_s": F.lit(0).cast("long"), "_len": F.col("n")})
    rows = inside.withColumn("segment", F.col("segment").cast("long")).unionByName(fallback)
    off = F.col("pos") - F.col("_s")
    chunk = F.floor(off / size)
    return rows.where((chunk + 1) * size <= F.col("_len")).select(
        "series_id", "segment", chunk.alias("chunk"), "pos", "ts", "y",
        F.when(off % size < context, "context").otherwise("horizon").alias("role"),
    )


def downsample(panel: DataFrame, max_points: int) -> DataFrame:
    """Every stride-th point plus the last, at most `max_points`; adds the new index `k` and size `m`."""
    n, pos = F.col("n"), F.col("pos")
    stride = F.greatest(F.lit(1), F.ceil(n / max_points)).cast("long")
    regular = F.floor((n - 1) / stride) + 1  # points on the stride
    on_end = (n - 1) % stride == 0
    total = F.when(on_end, regular).otherwise(regular + 1)
    over = total > max_points  # then the last strided point gives way to the final one
    m = F.when(over, total - 1).otherwise(total)
    is_last = pos == n - 1
    strided = (pos % stride == 0) & (F.floor(pos / stride) < F.when(over, m - 1).otherwise(regular))
    k = F.when(is_last, m - 1).otherwise(F.floor(pos / stride))
    return panel.where(strided | is_last).withColumns({"k": k.cast("long"), "m": m.cast("long")})


def savgol_weights(window: int, poly: int = 2) -> np.ndarray:
    """Row i gives the weights of the window's points for the fitted value at point i."""
    x = np.arange(window) - window // 2
    design = np.vander(x, poly + 1, increasing=True).astype(float)
    return design @ np.linalg.pinv(design)


def savgol(panel: DataFrame, window: int = 5, poly: int = 2) -> DataFrame:
    """Savitzky-Golay smoothing into `smooth`; edges take the polynomial of the outermost full window.

    Even windows shrink by one; a series shorter than the window uses its largest odd window.
    """
    window = window if window % 2 else max(3, window - 1)
    sizes = [w for w in range(3, window + 1, 2)]

    def smooth_of(w, size: int) -> Column:
        weights, half = savgol_weights(size, min(poly, size - 1)), size // 2

        def combo(row: np.ndarray, first: int) -> Column:
            """Weighted sum over the points first .. first+size-1 relative to the current row."""
            total = F.lit(0.0)
            for j, c in enumerate(row):
                off = first + j
                val = F.col("y") if off == 0 else (F.lead("y", off).over(w) if off > 0 else F.lag("y", -off).over(w))
                total = total + F.lit(float(c)) * val
            return total

        out = None
        for p in range(half):
            head = combo(weights[p], -p)
            out = F.when(F.col("pos") == p, head) if out is None else out.when(F.col("pos") == p, head)
            r = size - 1 - p
            out = out.when(F.col("n") - 1 - F.col("pos") == p, combo(weights[r], -r))
        return out.otherwise(combo(weights[half], -half))

    def build(w):
        col = None
        for size in sizes:
            fits = (F.col("n") >= size) if size == sizes[-1] else ((F.col("n") >= size) & (F.col("n") < size + 2))
            col = F.when(fits, smooth_of(w, size)) if col is None else col.when(fits, smooth_of(w, size))
        return {"smooth": col.otherwise(F.col("y"))}

    return framed(panel, build, back=window - 1, fwd=window - 1)


def moving_average_parts(panel: DataFrame, period: int) -> DataFrame:
    """Centred moving-average trend with zero padding, phase means of the rest, residual."""
    trended = framed(
        panel,
        lambda w: {"trend": F.sum("y").over(w.rowsBetween(-(period // 2), (period - 1) // 2)) / period},
        back=period // 2,
        fwd=max(1, (period - 1) // 2),
    )
    phased = trended.withColumns({"phase": F.col("pos") % period, "_d": F.col("y") - F.col("trend")})
    means = phased.groupBy("series_id", "phase").agg(F.max("n").alias("n"), F.avg("_d").alias("seasonal"))
    return (
        attach(phased, means, extra=["phase"])
        .withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
        .drop("_d", "phase")
    )


def last_n(df: DataFrame, count: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest `count` rows per key. Spark prunes per partition before the exchange (rank limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= count).drop("_rn")


def truncate_context(panel: DataFrame, count: int) -> DataFrame:
    """Keep the last `count` points; positions and length restart."""
    drop = F.greatest(F.col("n") - count, F.lit(0))
    return panel.where(F.col("pos") >= drop).withColumns({"pos": F.col("pos") - drop, "n": F.col("n") - drop})
