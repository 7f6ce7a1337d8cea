"""Cubic gap interpolation and least-squares spline fits.

Only the small linear solves run in numpy; evaluation stays in column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.blocks import BLOCK_ROWS, attach, halo, nearest_valid, number_rows, per_series
from tidepanel.operators.smoothing import smooth_points, solve_bands

KNOTS_PER_SOLVE = 4096
# The influence of a knot on the curvature of another falls by at least half per knot in between,
# so 80 neighbours on each side determine a block's curvatures to double precision.
HALO = 80


def curvatures(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline through at least four points."""
    h, n = np.diff(x), len(x)
    slope = np.diff(y) / h
    rhs = 6 * np.diff(slope)
    bands = np.zeros((3, n - 2))
    bands[1] = 2 * (h[:-1] + h[1:])
    bands[2, :-1] = bands[0, 1:] = h[1:-1]
    a, b = h[0] / h[1], h[-1] / h[-2]
    bands[1, 0] += h[0] * (1 + a)
    bands[1, -1] += h[-1] * (1 + b)
    if n > 3:
        bands[2, 0] -= h[0] * a
        bands[0, -1] -= h[-1] * b
    m = np.empty(n)
    m[1:-1] = solve_bands(bands, rhs[:, None])[:, 0]
    m[0] = m[1] * (1 + a) - m[2] * a
    m[-1] = m[-2] * (1 + b) - m[-3] * b
    return m


def _solve_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vpos")
    x, y = pdf["pos"].to_numpy(float), pdf["y"].to_numpy(float)
    m = curvatures(x, y) if len(x) >= 4 else np.zeros(len(x))
    out = pdf.loc[:, ["series_id", "pos", "vpos", "vn", "y"]].assign(m=m)
    return out[pdf["own"].to_numpy(bool)]


def spline_knots(panel: DataFrame) -> DataFrame:
    """Valid points with their curvature `m` (0 for series with fewer than 4) and their rank vpos of vn."""
    valid = number_rows(
        panel.where(F.col("y").isNotNull()).select("series_id", "ts", F.col("pos").alias("_p"), "y"), ("ts", "_p")
    ).select("series_id", F.col("_p").alias("pos"), F.col("pos").alias("vpos"), F.col("n").alias("vn"), "y")
    by_knot = valid.withColumnsRenamed({"pos": "_p", "vpos": "pos", "vn": "n"})
    spread = halo(by_knot, HALO, HALO, size=KNOTS_PER_SOLVE).select(
        "series_id", F.col("_p").alias("pos"), F.col("pos").alias("vpos"), F.col("n").alias("vn"), "y", F.col("_blk").alias("b"), F.col("_own").alias("own")
    )
    return spread.groupBy("series_id", "b").applyInPandas(
        _solve_block, "series_id string, pos long, vpos long, vn long, y double, m double"
    )


def cubic(panel: DataFrame) -> DataFrame:
    """Fill holes with the not-a-knot cubic through the valid points, extrapolating the outer pieces.

    Series with 2 or 3 valid points are interpolated linearly (also extrapolated).
    """
    points = spline_knots(panel)
    pt = F.struct("pos", "y", "m")
    ends = points.where("vpos <= 1 or vpos >= vn - 2").groupBy("series_id").agg(
        F.min_by(pt, F.when(F.col("vpos") == 0, 0)).alias("_k0"),
        F.max_by(pt, F.when(F.col("vpos") == 1, 1)).alias("_k1"),
        F.max_by(pt, F.when(F.col("vpos") == F.col("vn") - 2, 1)).alias("_z1"),
        F.max_by(pt, F.when(F.col("vpos") == F.col("vn") - 1, 1)).alias("_z0"),
    )
    sized = ends.join(per_series(panel), "series_id")
    base = panel.join(points.select("series_id", "pos", "m"), ["series_id", "pos"], "left")
    near = attach(nearest_valid(base, carry=["m"]), sized, how="left")

    def piece(x0, y0, m0, x1, y1, m1) -> Column:
        h, x = x1 - x0, F.col("pos")
        left, right = (x1 - x) / h, (x - x0) / h
        return left * y0 + right * y1 + ((left * left * left - left) * m0 + (right * right * right - right) * m1) * h * h / 6

    def between(a: str, b: str) -> Column:
        return piece(F.col(f"{a}.pos"), F.col(f"{a}.y"), F.col(f"{a}.m"), F.col(f"{b}.pos"), F.col(f"{b}.y"), F.col(f"{b}.m"))

    inner = piece(F.col("prev_pos"), F.col("prev_y"), F.col("prev_m"), F.col("next_pos"), F.col("next_y"), F.col("next_m"))
    filled = (
        F.when(F.col("y").isNotNull(), F.col("y"))
        .when(F.col("prev_pos").isNull(), between("_k0", "_k1"))
        .when(F.col("next_pos").isNull(), between("_z1", "_z0"))
        .otherwise(inner)
    )
    extra = ["m", "prev_pos", "prev_y", "prev_m", "next_pos", "next_y", "next_m", "_k0", "_k1", "_z0", "_z1"]
    return near.withColumn("y", filled).drop(*extra)


# ---- least-squares spline --------------------------------------------------------------------


def basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline design matrix on the full knot vector (Cox-de Boor, right end closed)."""
    x = np.clip(x, knots[degree], knots[-degree - 1])
    last = len(knots) - degree - 2
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, last)
    out = np.zeros((len(x), len(knots) - degree - 1))
    vals = np.zeros((len(x), degree + 1))
    vals[:, 0] = 1.0
    for d in range(1, degree + 1):
        saved = np.zeros(len(x))
        for r in range(d):
            right, left = knots[span + r + 1], knots[span + 1 - d + r]
            term = np.where(right > left, vals[:, r] / np.where(right > left, right - left, 1.0), 0.0)
            vals[:, r] = saved + (right - x) * term
            saved = (x - left) * term
        vals[:, d] = saved
    rows = np.arange(len(x))
    for r in range(degree + 1):
        out[rows, span - degree + r] = vals[:, r]
    return out


def knot_vector(n: int, interior: np.ndarray, degree: int) -> np.ndarray:
    inside = interior[(interior > 0) & (interior < n - 1)]
    return np.concatenate([np.zeros(degree + 1), inside, np.full(degree + 1, n - 1.0)])


def uniform_interior(n: int, count: int) -> np.ndarray:
    return np.linspace(1, n - 2, max(1, min(count, n // 4)))


def even_knots(n: int, segments: int, degree: int) -> np.ndarray:
    """Knots evenly spaced over the series and `degree` steps beyond, as a difference penalty needs them."""
    return (np.arange(-degree, segments + degree + 1) / segments) * (n - 1.0)


def segments_of(n: int, count: int) -> int:
    return max(2, min(count, n // 2))


def _normal_block(count: int, degree: int, penalised: bool):
    """Partial normal equations of one block of one series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        inner = pdf["interior"].iloc[0]
        interior = uniform_interior(n, count) if inner is None else np.asarray(inner, float)
        knots = even_knots(n, segments_of(n, count), degree) if penalised else knot_vector(n, interior, degree)
        b = basis(pdf["pos"].to_numpy(float), knots, degree)
        y = pdf["y"].to_numpy(float)
        return pd.DataFrame(
            {
                "series_id": [pdf["series_id"].iloc[0]],
                "n": [n],
                "interior": [interior.tolist()],
                "gram": [(b.T @ b).ravel().tolist()],
                "rhs": [(b.T @ y).tolist()],
                "squares": [float(y @ y)],
                "points": [len(y)],
            }
        )

    return run


def penalised(gram: np.ndarray, rhs: np.ndarray, squares: float, points: int) -> tuple[np.ndarray, float]:
    """(coefficients, penalty) with second differences of the coefficients penalised, the penalty by generalised
    cross-validation: a grid of quarter decades, then golden sections around the best of it."""
    k = len(rhs)
    d = np.diff(np.eye(k), 2, axis=0)
    p = d.T @ d
    unit = np.trace(gram) / np.trace(p)

    def fit(e: float) -> tuple[float, np.ndarray]:
        both = np.linalg.solve(gram + unit * 10**e * p, np.column_stack([rhs, gram]))
        c = both[:, 0]
        rest = max(squares - 2 * c @ rhs + c @ gram @ c, 0.0)
        free = max(points - np.trace(both[:, 1:]), 1e-9)
        return points * rest / free**2, c

    exponents = np.arange(-24, 33) / 4
    best = exponents[int(np.argmin([fit(e)[0] for e in exponents]))]
    low, high, golden = best - 0.25, best + 0.25, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if fit(a)[0] <= fit(b)[0] else (a, high)
    e = (low + high) / 2
    return fit(e)[1], float(unit * 10**e)


def _pieces(knots: np.ndarray, coef: np.ndarray, degree: int, n: int) -> tuple[list[float], list[list[float]]]:
    """Break points and local power coefficients of a B-spline on [0, n - 1]."""
    cuts = np.unique(knots[degree : len(knots) - degree])
    pieces = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        xs = lo + (hi - lo) * (np.arange(degree + 1) + 0.5) / (degree + 1)
        v = basis(xs, knots, degree) @ coef
        pieces.append(np.linalg.solve(np.vander(xs - lo, increasing=True), v).tolist())
    return cuts[:-1].tolist(), pieces


def _polynomials(degree: int, count: int | None = None):
    """Solve the summed equations; return break points and local power coefficients per interval. With `count` segments the
    coefficients are penalised."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, rhs = int(r.n), np.asarray(r.rhs, float)
                gram = np.asarray(r.gram, float).reshape(len(rhs), len(rhs))
                if count:
                    knots, coef = even_knots(n, segments_of(n, count), degree), penalised(gram, rhs, float(r.squares), int(r.points))[0]
                else:
                    knots = knot_vector(n, np.asarray(r.interior, float), degree)
                    coef = np.linalg.lstsq(gram, rhs, rcond=None)[0]
                rows.append((r.series_id, n, *_pieces(knots, coef, degree, n)))
            yield pd.DataFrame(rows, columns=["series_id", "n", "breaks", "pieces"])

    return run


FIT_SCHEMA = "series_id string, n long, breaks array<double>, pieces array<array<double>>"


def _lsq(panel: DataFrame, num_knots: int, degree: int, penalty: bool = False) -> DataFrame:
    blocked = panel.where(F.col("y").isNotNull()).withColumn("b", F.floor(F.col("pos") / BLOCK_ROWS))
    parts = blocked.select("series_id", "n", "pos", "y", "interior", "b").groupBy("series_id", "b").applyInPandas(
        _normal_block(num_knots, degree, penalty),
        "series_id string, n long, interior array<double>, gram array<double>, rhs array<double>, squares double, points long",
    )
    # One small array per block; the sum runs over blocks, element by element.
    def total(col: str) -> DataFrame:
        return (
            parts.select("series_id", F.posexplode(col).alias("i", "v"))
            .groupBy("series_id", "i").agg(F.sum("v").alias("v"))
            .groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
            .select("series_id", F.transform("e", lambda s: s.v).alias(col))
        )

    shape = parts.groupBy("series_id").agg(
        F.max("n").alias("n"), F.first("interior").alias("interior"), F.sum("squares").alias("squares"), F.sum("points").alias("points")
    )
    solve = _polynomials(degree, num_knots if penalty else None)
    return shape.join(total("gram"), "series_id").join(total("rhs"), "series_id").mapInPandas(solve, FIT_SCHEMA)


STRATEGIES = ("uniform", "curvature", "pspline")
SEGMENTS = 40  # of a penalised spline


def _short_fit(degree: int, factor: float):
    """Pieces of series with few points: the smoothing spline, or straight lines between fewer than degree + 1 points."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                x, y = (np.array([p[c] for p in r.points], float) for c in ("pos", "y"))
                gamma = np.zeros(len(x))
                if len(x) > degree:
                    y, gamma, _ = smooth_points(x, y, factor * len(x))
                pieces = []
                for x0, x1, f0, f1, g0, g1 in zip(x, x[1:], y, y[1:], gamma, gamma[1:]):
                    h = x1 - x0
                    pieces.append([f0, (f1 - f0) / h - h * (2 * g0 + g1) / 6, g0 / 2, (g1 - g0) / (6 * h)])
                if len(pieces) and gamma.any():  # natural ends go on straight
                    slope = (y[-1] - y[-2]) / (x[-1] - x[-2]) + (x[-1] - x[-2]) * (gamma[-2] + 2 * gamma[-1]) / 6
                    first = pieces[0][:2]
                    pieces = [[first[0] - first[1], first[1]], *pieces, [y[-1], slope]]
                    x = np.concatenate([[x[0] - 1], x])
                else:
                    pieces = [p[:2] for p in pieces] or [[float(y[0])]]
                    x = x[: len(pieces)]
                rows.append((r.series_id, int(r.n), x.tolist(), pieces))
            yield pd.DataFrame(rows, columns=["series_id", "n", "breaks", "pieces"])

    return run


def fit(panel: DataFrame, num_knots: int | None = None, degree: int = 3, strategy: str = "uniform", factor: float = 0.5) -> DataFrame:
    """Spline per series as (series_id, n, breaks, pieces).

    `uniform`: least squares with num_knots (10) inner knots; `curvature` moves them to where a first fit bends most; `pspline`:
    num_knots (40) even segments whose coefficients are penalised by their second differences, the penalty by generalised
    cross-validation. Normal equations are summed over blocks of a series. Series of up to 2 * (degree + 1) valid points get the
    smoothing spline whose squared residuals are `factor` times their number, those of up to `degree` straight lines.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    num_knots = num_knots or (SEGMENTS if strategy == "pspline" else 10)
    sized = per_series(panel, F.count("y").alias("_valid"))
    base = attach(panel, sized)
    long = base.where(F.col("_valid") > 2 * (degree + 1)).drop("_valid").withColumn("interior", F.lit(None).cast("array<double>"))
    if strategy == "curvature":
        count = F.greatest(F.lit(1), F.least(F.lit(num_knots), F.floor(F.col("n") / 4).cast("int")))
        spaced = F.transform(F.sequence(F.lit(1), count), lambda i: i * (F.col("n") - 1) / (count + 1))
        first = _lsq(long.withColumn("interior", spaced), num_knots, degree)
        moved = first.mapInPandas(_bent_knots(num_knots), "series_id string, n long, interior array<double>")
        long = attach(long.drop("interior"), moved)
    fitted = _lsq(long, num_knots, degree, strategy == "pspline")
    few = base.where((F.col("_valid") <= 2 * (degree + 1)) & F.col("y").isNotNull())
    points = few.groupBy("series_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "y"))).alias("points"))
    return fitted.unionByName(points.mapInPandas(_short_fit(degree, factor), FIT_SCHEMA))


def _bent_knots(num_knots: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n = int(r.n)
                count = max(1, min(num_knots, n // 4))
                at = equal_bend(np.asarray(r.breaks, float), [np.asarray(p, float) for p in r.pieces], float(n - 1), count)
                rows.append((r.series_id, n, np.unique(np.clip(at.round(), 1, n - 2)).tolist()))
            yield pd.DataFrame(rows, columns=["series_id", "n", "interior"])

    return run


def equal_bend(breaks: np.ndarray, pieces: list[np.ndarray], end: float, count: int) -> np.ndarray:
    """`count` positions that cut [breaks[0], end] into parts of equal total |second derivative|; evenly spaced on a straight line.

    The second derivative of a cubic is linear on each piece, so its integral and the inverse are exact. Pieces of a higher
    degree are cut into 16 parts with a linear one each.
    """
    x, bend = [], []
    for k, (start, coef) in enumerate(zip(breaks, pieces)):
        stop = breaks[k + 1] if k + 1 < len(breaks) else end
        second = np.polynomial.polynomial.polyder(coef, 2) if len(coef) > 2 else np.zeros(1)
        points = np.linspace(0.0, stop - start, 2 if len(second) <= 2 else 17)
        values = np.polynomial.polynomial.polyval(points, second)
        for u, v, f, g in zip(points, points[1:], values, values[1:]):
            if v <= u:
                continue
            if f * g < 0:  # a sign change in between
                root = u + (v - u) * f / (f - g)
                x += [(start + u, start + root), (start + root, start + v)]
                bend += [(abs(f), 0.0), (0.0, abs(g))]
            else:
                x.append((start + u, start + v))
                bend.append((abs(f), abs(g)))
    (a, b), (f, g) = np.array(x).T, np.array(bend).T
    areas = (f + g) / 2 * (b - a)
    below = np.concatenate([[0.0], np.cumsum(areas)])
    share = np.arange(1, count + 1) / (count + 1)
    if below[-1] <= 1e-12:
        return breaks[0] + share * (end - breaks[0])
    goal = share * below[-1]
    i = np.clip(np.searchsorted(below, goal, side="right") - 1, 0, len(areas) - 1)
    rest, slope = goal - below[i], (g[i] - f[i]) / (b[i] - a[i])
    # f u + slope u^2 / 2 = rest, in the form that has no division by a small slope
    return a[i] + 2 * rest / np.maximum(f[i] + np.sqrt(np.maximum(f[i] ** 2 + 2 * slope * rest, 0.0)), 1e-300)


def evaluate(rows: DataFrame, derivative: int = 0, at: str = "pos", out: str = "fitted") -> DataFrame:
    """Value (or derivative) of the attached fit at `at`; beyond the data the outer pieces continue."""
    x = F.col(at).cast("double")
    i = F.greatest(F.size(F.filter("breaks", lambda b: b <= x)) - 1, F.lit(0))
    dx = x - F.get("breaks", i)
    coef = F.get("pieces", i)
    for _ in range(derivative):
        coef = F.transform(F.slice(coef, 2, 64), lambda c, k: c * (k + 1))
    value = F.aggregate(F.reverse(coef), F.lit(0.0), lambda acc, c: acc * dx + c)
    return rows.withColumn(out, value)


def fitted(panel: DataFrame, fits: DataFrame) -> DataFrame:
    """Panel with `fitted`, first derivative `slope` and `residual`."""
    rows = evaluate(evaluate(attach(panel, fits), out="fitted"), 1, out="slope")
    return rows.withColumn("residual", F.col("y") - F.col("fitted")).drop("breaks", "pieces")


def extrapolate(fits: DataFrame, horizon: int) -> DataFrame:
    """(series_id, step, mean) beyond the end of each series."""
    ahead = fits.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ahead = ahead.withColumn("_x", F.col("n") - 1 + F.col("step"))
    return evaluate(ahead, at="_x", out="mean").select("series_id", "step", "mean")


def summary_features(panel: DataFrame) -> DataFrame:
    """Mean, deviation, range, and start / end / range of the fitted trend (series of 4 points or more)."""
    stats = per_series(
        panel, F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.min("y").alias("min"), F.max("y").alias("max")
    )
    fits = fit(panel).where("n >= 4")
    ends = evaluate(evaluate(fits.withColumns({"_a": F.lit(0), "_z": F.col("n") - 1}), at="_a", out="trend_start"), at="_z", out="trend_end")
    ends = ends.select("series_id", "trend_start", "trend_end", (F.col("trend_end") - F.col("trend_start")).alias("trend_range"))
    return stats.drop("n").join(ends, "series_id", "left")
