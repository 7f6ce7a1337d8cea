"""Blocked and distributed numerics against dense single-machine solutions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import analysis as an, decompose as dc, hierarchy as hi, spline, windows as wn


def dense_not_a_knot(x, y, at):
    """Cubic pieces from one dense system: values, C1, C2, and equal third derivatives at the second knots."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    r = 0
    for i in range(n):
        for xx, yy in ((x[i], y[i]), (x[i + 1], y[i + 1])):
            a[r, 4 * i : 4 * i + 4] = [1, xx - x[i], (xx - x[i]) ** 2, (xx - x[i]) ** 3]
            b[r] = yy
            r += 1
    for i in range(n - 1):
        h = x[i + 1] - x[i]
        a[r, 4 * i : 4 * i + 4], a[r, 4 * i + 5] = [0, 1, 2 * h, 3 * h * h], -1
        r += 1
        a[r, 4 * i : 4 * i + 4], a[r, 4 * i + 6] = [0, 0, 2, 6 * h], -2
        r += 1
    for i in (0, n - 2):
        a[r, 4 * i + 3], a[r, 4 * i + 7] = 1, -1
        r += 1
    c = np.linalg.solve(a, b)
    seg = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 1)
    d = at - np.asarray(x)[seg]
    return c[4 * seg] + c[4 * seg + 1] * d + c[4 * seg + 2] * d**2 + c[4 * seg + 3] * d**3


@pytest.mark.parametrize("size", [400, 4096])
def test_cubic_fill(panel, values_of, monkeypatch, size):
    """Blocks of 400 knots give what one dense solve gives."""
    monkeypatch.setattr(spline, "KNOTS_PER_SOLVE", size)
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=900))
    gone = rng.random(900) < 0.25
    gone[[0, 1, 898, 899]] = True
    p = panel({"s": [None if g else float(v) for g, v in zip(gone, y)], "few": [1.0, None, 3.0]})
    got = values_of(spline.cubic(p), "y")
    x = np.flatnonzero(~gone)
    want = dense_not_a_knot(x, y[x], np.arange(900.0))
    assert got["s"] == pytest.approx(want.tolist(), abs=1e-6)
    assert got["few"] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("degree", [1, 3])
def test_least_squares_spline(panel, values_of, monkeypatch, degree):
    monkeypatch.setattr(spline, "BLOCK_ROWS", 17)
    rng = np.random.default_rng(2)
    y = np.sin(np.arange(120) / 9) + 0.1 * rng.normal(size=120)
    p = panel({"s": y.tolist()})
    out = spline.fitted(p, spline.fit(p, num_knots=6, degree=degree))
    knots = spline.knot_vector(120, spline.uniform_interior(120, 6), degree)
    b = spline.basis(np.arange(120.0), knots, degree)
    assert b.sum(axis=1) == pytest.approx(np.ones(120))
    want = b @ np.linalg.lstsq(b, y, rcond=None)[0]
    assert values_of(out, "fitted")["s"] == pytest.approx(want.tolist(), abs=1e-8)
    num = np.gradient(want)
    assert degree == 1 or np.allclose(values_of(out, "slope")["s"][5:-5], num[5:-5], atol=0.06)


def test_spline_short_series_is_a_line(panel, values_of):
    p = panel({"s": [1, 2, 3, 4]})
    assert values_of(spline.fitted(p, spline.fit(p)), "fitted")["s"] == pytest.approx([1, 2, 3, 4])
    ahead = {r.step: r.mean for r in spline.extrapolate(spline.fit(p), 2).collect()}
    assert ahead == pytest.approx({1: 5.0, 2: 6.0})


def test_curvature_knots(panel, values_of):
    y = [abs(i - 60) * 1.0 for i in range(120)]
    p = panel({"s": y})
    even = values_of(spline.fitted(p, spline.fit(p, 6)), "residual")["s"]
    bent = values_of(spline.fitted(p, spline.fit(p, 6, strategy="curvature")), "residual")["s"]
    assert np.square(bent).sum() < np.square(even).sum()


def test_savgol(panel, values_of):
    y = np.random.default_rng(3).normal(size=25)
    got = values_of(wn.savgol(panel({"s": y.tolist(), "t": [1.0, 5.0, 2.0, 8.0]}), 7), "smooth")
    want = []
    for i in range(25):
        lo = min(max(i - 3, 0), 18)
        c = np.polyfit(np.arange(lo, lo + 7), y[lo : lo + 7], 2)
        want.append(np.polyval(c, i))
    assert got["s"] == pytest.approx(want)
    assert got["t"] == pytest.approx([1.0, 5.0, 2.0, 8.0])


def test_moving_average_matches_zero_padded_convolution(panel, values_of):
    y = np.random.default_rng(4).normal(size=30)
    for p in (2, 3, 4, 7):
        got = values_of(wn.moving_average_parts(panel({"s": y.tolist()}), p), "trend")["s"]
        assert got == pytest.approx(np.convolve(y, np.ones(p) / p, mode="same").tolist())


def test_stl(panel, values_of):
    t = np.arange(120)
    y = 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)
    y[60] += 40  # outlier
    parts = dc.stl(panel({"s": y.tolist(), "short": [1.0, 2.0, 3.0]}), 12)
    got = {c: np.array(values_of(parts, c)["s"]) for c in ("trend", "seasonal", "resid")}
    assert np.allclose(got["trend"] + got["seasonal"] + got["resid"], y)
    assert abs(got["resid"][60]) > 30
    assert np.abs(got["trend"] - 0.5 * t)[12:-12].max() < 1.0
    assert {r.method for r in parts.where("series_id = 'short'").collect()} == {"moving_average"}


@pytest.mark.parametrize(("n", "period", "robust", "rows"), [(300, 4, False, 160), (300, 4, True, 64), (131, 3, False, 50)])
def test_stl_in_blocks_is_stl_in_one(panel, values_of, n, period, robust, rows):
    rng = np.random.default_rng(n)
    t = np.arange(n)
    y = 0.1 * t + 5 * np.sin(2 * np.pi * t / period) + rng.normal(size=n)
    y[n // 2] += 30
    parts = dc.stl(panel({"s": y.tolist()}), period, robust, rows)
    trend, season = dc.stl_parts(y, period, robust)
    assert values_of(parts, "trend")["s"] == pytest.approx(trend.tolist(), abs=1e-8)
    assert values_of(parts, "seasonal")["s"] == pytest.approx(season.tolist(), abs=1e-8)
    assert {r.method for r in parts.collect()} == {"stl"}


@pytest.mark.parametrize(("rows", "tile_bits"), [(None, None), (5, 0), (5, 2)])
def test_dominant_period(panel, rows, tile_bits):
    rng = np.random.default_rng(3)
    series = {"s": [np.sin(2 * np.pi * i / 8) for i in range(64)], "t": [1, 2, 3], "holes": [None if i % 11 == 3 else np.cos(i) + 0.01 * i for i in range(70)], "noise": rng.normal(size=53).tolist()}
    got = {r.series_id: r.period for r in an.dominant_period(panel(series), rows, tile_bits).collect()}
    want = {}
    for k, y in series.items():
        y = np.array([v for v in y if v is not None], float)
        p = len(y) // (int(np.abs(np.fft.rfft(y - y.mean()))[1:].argmax()) + 1) if len(y) >= 6 else 0
        want[k] = p if 2 <= p <= len(y) // 2 else None
    assert got == want and got["s"] == 8 and got["t"] is None


def test_reconciliation_against_dense(spark):
    edges = [("total", "x"), ("total", "y"), ("x", "x1"), ("x", "x2"), ("y", "y1")]
    e = spark.createDataFrame([(h, p, c) for h in ("h1", "h2") for p, c in edges], "hierarchy_id string, parent string, child string")
    rng = np.random.default_rng(1)
    ids = ["total", "x", "y", "x1", "x2", "y1"]
    base = {h: pd.DataFrame(rng.normal(10, 3, (6, 4)), index=ids) for h in ("h1", "h2")}
    f = spark.createDataFrame([(h, s, int(k) + 1, float(b.loc[s, k])) for h, b in base.items() for s in ids for k in b.columns], "hierarchy_id string, series_id string, step int, mean double")
    s = np.array([[1, 1, 1], [1, 1, 0], [0, 0, 1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    got = hi.optimal(e, f, "ols").toPandas()
    for h, b in base.items():
        want = s @ np.linalg.inv(s.T @ s) @ s.T @ b.to_numpy()
        mine = got[got.hierarchy_id == h].pivot(index="series_id", columns="step", values="mean").loc[ids].to_numpy()
        assert np.allclose(mine, want)
    dense = hi.dense_projection(e, f, "ols").toPandas().set_index(["hierarchy_id", "series_id", "step"])["mean"]
    assert np.allclose(got.set_index(["hierarchy_id", "series_id", "step"])["mean"].loc[dense.index], dense)
    for m in ("ols", "mint_shrink", "top_down"):
        assert hi.coherency(e, hi.reconcile(e, f, m), 1e-5).count() == 0


def test_minimum_trace_of_trees_against_dense(spark):
    schema = "hierarchy_id string, parent string, child string"
    deep = [("t", "a"), ("t", "b"), ("a", "a1"), ("a", "a2"), ("b", "b1"), ("a1", "x"), ("a1", "y"), ("a1", "z")]
    e = spark.createDataFrame([("deep", *c) for c in deep] + [("flat", "r", f"l{i}") for i in range(4)] + [("one", "p", "q")], schema)
    rng = np.random.default_rng(2)
    rows = []
    for h, members, steps in (("deep", ["t", "a", "b", "a1", "a2", "b1", "x", "y", "z"], 7), ("flat", ["r", *[f"l{i}" for i in range(4)]], 3), ("one", ["p", "q"], 1)):
        rows += [(h, m, s, float(rng.normal(10, 3))) for m in members for s in range(1, steps + 1) if (m, s) != ("b", 2)]
    f = spark.createDataFrame(rows, "hierarchy_id string, series_id string, step int, mean double")
    key = ["hierarchy_id", "series_id", "step"]
    got = hi.optimal(e, f, "mint_shrink").toPandas().set_index(key)["mean"].sort_index()
    want = hi.dense_projection(e, f, "mint_shrink").toPandas().set_index(key)["mean"].sort_index()
    assert got.index.equals(want.index) and np.allclose(got, want, atol=1e-5)
    sums = hi.level_sums(e, f).toPandas().set_index(key)["mean"].sort_index()
    plain = hi.bottom_up(e, f).toPandas().set_index(key)["mean"].sort_index()
    assert sums.index.equals(plain.index) and np.allclose(sums, plain)


def test_shared_child_is_solved_densely(spark):
    e = spark.createDataFrame([("h", "p", "c"), ("h", "q", "c"), ("h", "p", "d")], "hierarchy_id string, parent string, child string")
    f = spark.createDataFrame([("h", s, 1, v) for s, v in (("p", 5.0), ("q", 3.0), ("c", 2.0), ("d", 1.0))], "hierarchy_id string, series_id string, step int, mean double")
    assert not hi.is_tree(e)
    assert hi.coherency(e, hi.reconcile(e, f, "ols"), 1e-9).count() == 0


@pytest.mark.parametrize(("rows", "tile_bits"), [(4, 0), (4, 2), (65_536, None)])
def test_lag_correlation_of_any_length(panel, monkeypatch, rows, tile_bits):
    from tidepanel.operators import attribution as at, blocks as bl

    monkeypatch.setattr(bl, "BLOCK_ROWS", rows)
    y = np.random.default_rng(8).normal(size=31)
    got = {r.lag: r.strength for r in at.lag_correlation(panel({"s": y.tolist(), "flat": [1] * 9}), tile_bits).collect()}
    d = y - y.mean()
    want = {k: abs((d[:-k] * d[k:]).sum() / (y.var() * (31 - k))) for k in range(1, 15)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("tile_bits", [0, 1, 3])
def test_spectrum_is_that_of_one_transform(panel, tile_bits):
    """Prime, even and power-of-two lengths, tiles of one, two and eight values."""
    from tidepanel.operators import fourier

    rng = np.random.default_rng(9)
    series = {f"s{n}": rng.normal(size=n) for n in (7, 64, 90, 101)}
    found = fourier.spectrum(panel({k: v.tolist() for k, v in series.items()}), "y", tile_bits).collect()
    got = {(r.series_id, (r.chunk << tile_bits) + i): complex(a, b) for r in found for i, (a, b) in enumerate(zip(r.re, r.im))}
    for k, v in series.items():
        assert np.allclose([got[k, i] for i in range(len(v))], np.fft.fft(v))


def test_spectrum_sends_no_transform_through_the_driver(panel, spark):
    """The filters start from a row per series, but their transform is as long as the series: no broadcast of it."""
    from tidepanel.operators import fourier

    rows = panel({"s": np.random.default_rng(2).normal(size=90).tolist()})
    found = fourier.spectrum(rows, "y", 2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("Initial Plan")[0].splitlines() if "chunk" in line and "Join" in line]
    assert lines and not [line for line in lines if "Broadcast" in line]


def test_exchanges_of_transforms_grow_with_the_rows(panel):
    """No exchange of the all-lags sums carries more than a constant times the rows."""
    from tidepanel.operators import fourier

    for n in (128, 512):
        rows = panel({"s": np.random.default_rng(1).normal(size=n).tolist()})
        runs = fourier.runs_of(rows, "y", 2 * F.col("n"), 2)
        once = fourier.transform(runs, tile_bits=2)
        assert sum(len(r.re) for r in runs.collect()) == n and sum(len(r.re) for r in once.collect()) == 2 * n


@pytest.mark.parametrize("half", [False, True])
def test_spectrum_of_rows_in_any_order(panel, half):
    """Grids of odd and even height, rows dealt at random, several spans."""
    from tidepanel.operators import fourier

    rng = np.random.default_rng(11)
    series = {f"s{n}": rng.normal(size=n) for n in (1, 2, 163, 175, 337)}
    rows = panel({k: v.tolist() for k, v in series.items()}).orderBy(F.rand(3)).repartition(5)
    found = fourier.spectrum(rows, "y", 1, half).collect()
    assert len({(r.series_id, r.chunk) for r in found}) == len(found)
    got = {(r.series_id, 2 * r.chunk + i): complex(a, b) for r in found for i, (a, b) in enumerate(zip(r.re, r.im))}
    for k, v in series.items():
        want = np.fft.fft(v)[: len(v) // 2 + 1 if half else None]
        assert np.abs(np.array([got[k, i] for i in range(len(want))]) - want).max() <= 1e-12 * np.abs(want).max()


def test_spectrum_is_read_off_to_many_digits():
    """Every share of points per value that a grid can have."""
    from numpy.polynomial import chebyshev

    from tidepanel.operators import fourier

    rng, tile, m = np.random.default_rng(5), 4, 1 << 12
    for over in (1.5, 1.6, 1.8, 2.2, 2.99):
        n = int(m / over) - 2 * tile
        y, t = rng.normal(size=n), np.arange(n) - fourier._centre(n, tile)
        half, shape = fourier._window(n, m, tile)
        assert half <= fourier.MOST_HALF
        grid = np.zeros(m)
        grid[t % m] = y / fourier._window_transform(t, m, half, shape)
        base, rest = np.divmod(np.arange(n) * m, n)
        weights = fourier._window_pieces(half, shape) @ chebyshev.chebvander(2 * (rest / n) - 1, 20).T
        found = (weights * np.fft.fft(grid)[(base + np.arange(1 - half, half + 1)[:, None]) % m]).sum(axis=0)
        want = np.abs(np.fft.fft(y))
        assert np.abs(np.abs(found) - want).max() <= 3e-13 * want.max()


def test_spectrum_sends_few_values(panel):
    """One transform of the real values: once as many values as there are, then half of the grid."""
    from tidepanel.operators import fourier

    for n in (150, 600):
        rows = panel({"s": np.random.default_rng(1).normal(size=n).tolist()}).coalesce(1)
        runs = fourier.grid_runs(rows, "y", 2)
        assert sum(len(r.re) for r in runs.collect()) <= n + 8
        size = runs.first().height << runs.first().bits
        half = fourier.transform(runs, tile_bits=2, real=True).collect()
        assert 1.5 * n <= size <= 1.5 * n + 8 * math.isqrt(2 * size) and len(half) * 4 <= size / 2 + 4 * math.isqrt(2 * size)
        plan = fourier.spectrum(rows, "y", 2, half=True)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("FlatMapGroupsInArrow") == 3


def test_staged_rows_of_spectra_are_dropped(panel, tmp_path, monkeypatch):
    from tidepanel import session
    from tidepanel.operators import fourier

    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    rows = fourier.centred(panel({"s": list(range(40))}))
    assert rows.count() == 40 and {p.name.split("-")[0] for p in tmp_path.iterdir() if any(p.glob("*.parquet"))} == {"centred"}


def test_attribution_ignores_points_outside_the_context(panel):
    from tidepanel.operators import attribution as at

    y = list(range(20))
    full = {r.pos: r.importance for r in at.occlusion(panel({"s": y}), window=2, context=6).collect()}
    assert len(full) == 6 and sum(full.values()) == pytest.approx(1.0)


def test_deep_and_cyclic_hierarchies(spark):
    schema = "hierarchy_id string, parent string, child string"
    chain = spark.createDataFrame([("deep", f"m{i:02d}", f"m{i + 1:02d}") for i in range(66)], schema)
    assert {r.series_id: r.depth for r in hi.levels(chain, checked=True).collect()} == {f"m{i:02d}": i for i in range(67)}
    ring = spark.createDataFrame([("ring", "r", "a"), ("ring", "a", "b"), ("ring", "b", "a"), ("fine", "r", "a")], schema)
    assert {r.hierarchy_id for r in hi.cycle_members(ring).collect()} == {"ring"}
    assert {r.hierarchy_id for r in hi.levels(ring).collect()} == {"fine"}


def test_shrinkage_by_sums_equals_the_plain_definition():
    rng = np.random.default_rng(4)
    for members, steps in ((5, 12), (8, 3)):
        r = rng.normal(size=(members, steps)) + np.linspace(0, 1, steps)
        c = r - r.mean(axis=1, keepdims=True)
        cov = np.cov(r)
        off = cov - np.diag(np.diag(cov))
        error = sum(np.linalg.norm(np.outer(c[:, t], c[:, t]) - cov) ** 2 for t in range(steps))
        weight, variances = hi.shrinkage(c)
        assert weight == pytest.approx(min(max(error / (steps * (off**2).sum()), 0.0), 1.0))
        s = np.vstack([np.ones((1, members - 1)), np.eye(members - 1)])
        full = (1 - weight) * cov + weight * np.diag(np.diag(cov)) + 1e-8 * np.eye(members)
        assert np.allclose(hi._weighted(s, r), s.T @ np.linalg.inv(full), rtol=1e-5, atol=1e-6)


def test_knots_share_the_bend_equally():
    from tidepanel.operators.spline import equal_bend

    # second derivative 6x - 6 on [0, 2], then 6 on [2, 4]: total 3 + 3 + 12
    at = equal_bend(np.array([0.0, 2.0]), [np.array([0, 0, -3.0, 1.0]), np.array([0, 0, 3.0])], 4.0, 5)
    assert at == pytest.approx([1.0, 2.0, 2.5, 3.0, 3.5])
    assert equal_bend(np.array([0.0]), [np.array([1.0, 2.0])], 10.0, 4) == pytest.approx([2.0, 4.0, 6.0, 8.0])
