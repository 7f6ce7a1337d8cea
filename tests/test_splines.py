"""Penalised and smoothing splines against dense solves."""

import numpy as np
import pytest

from tidepanel.operators import smoothing as sm, spline
from tidepanel.plans.prepare import prepare_panel


def dense_smoother(x, y, lam):
    """Values that minimise squared residuals + lam * integrated squared second derivative, by dense matrices."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    return np.linalg.solve(np.eye(n) + lam * q @ np.linalg.solve(r, q.T), y)


def wavy(n, seed=1, gaps=True):
    rng = np.random.default_rng(seed)
    y = np.sin(np.arange(n) / 9) * 4 + rng.normal(size=n)
    gone = rng.random(n) < (0.2 if gaps else 0)
    gone[[0, n - 1]] = gaps
    return [None if g else float(v) for g, v in zip(gone, y)]


@pytest.mark.parametrize("w", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 5, 97, 1500])
def test_banded_solve(w, n):
    rng = np.random.default_rng(n)
    a, bands = np.zeros((n, n)), np.zeros((2 * w + 1, n))
    for d in range(-w, w + 1):
        i = np.arange(max(0, -d), max(min(n, n - d), max(0, -d)))
        v = rng.normal(size=len(i)) + (8 if d == 0 else 0)
        a[i, i + d] = bands[w + d, i] = v
    b = rng.normal(size=(n, 2))
    assert np.allclose(a @ sm.solve_bands(bands, b), b)


@pytest.mark.parametrize("size", [8, 13, 65_536])
def test_smoothing_spline_in_blocks(panel, values_of, size):
    """Blocks of 8 and 13 points give the spline of one dense solve; its squared residuals meet the target."""
    y = wavy(110)
    straight = [2.0 * i + (-1) ** i * 0.01 for i in range(40)]
    out = sm.smoothing_spline(panel({"s": y, "line": straight, "one": [None, 5.0, None], "none": [None, None]}), 0.5, size)
    got, lam = values_of(out, "fitted"), values_of(out, "lam")["s"][0]
    at = np.array([i for i, v in enumerate(y) if v is not None])
    own = np.array([y[i] for i in at])
    want = dense_smoother(at.astype(float), own, lam)
    assert np.array(got["s"], float)[at] == pytest.approx(want, abs=1e-6)
    assert ((own - want) ** 2).sum() == pytest.approx(0.5 * len(at), rel=1e-4)
    assert got["line"] == pytest.approx(np.polyval(np.polyfit(np.arange(40), straight, 1), np.arange(40)).tolist(), abs=1e-8)
    assert got["one"] == [5.0, 5.0, 5.0] and got["none"] == [None, None]
    full = np.array(got["s"], float)
    assert full[0] == pytest.approx(2 * full[1] - full[2], abs=0.05) or at[0] > 1  # straight beyond the points
    ends = [i for i in range(at[0] + 1)]
    assert np.allclose(np.diff(full[ends], 2), 0, atol=1e-8)


def test_long_series_stay_smooth_across_blocks(panel, values_of):
    y = wavy(400, 3, gaps=False)
    p = panel({"s": y})
    one, many = (values_of(sm.smoothing_spline(p, 0.8, size), "fitted")["s"] for size in (1000, 16))
    assert many == pytest.approx(one, abs=1e-6)


def test_penalised_spline_against_dense(panel, values_of, monkeypatch):
    monkeypatch.setattr(spline, "BLOCK_ROWS", 17)
    y = wavy(150, 5)
    fits = spline.fit(panel({"s": y}), strategy="pspline")
    got = np.array(values_of(spline.fitted(panel({"s": y}), fits), "fitted")["s"])
    at = np.array([i for i, v in enumerate(y) if v is not None])
    own = np.array([y[i] for i in at])
    knots = spline.even_knots(150, 40, 3)
    b = spline.basis(at.astype(float), knots, 3)
    d = np.diff(np.eye(43), 2, axis=0)

    def solved(lam):
        hat = np.linalg.solve(b.T @ b + lam * d.T @ d, b.T)
        rest = own - b @ hat @ own
        return hat @ own, len(own) * (rest @ rest) / (len(own) - np.trace(b @ hat)) ** 2

    coef, lam = spline.penalised(b.T @ b, b.T @ own, float(own @ own), len(own))
    assert np.allclose(got, spline.basis(np.arange(150.0), knots, 3) @ coef, atol=1e-7)
    assert np.allclose(coef, solved(lam)[0])
    best = solved(lam)[1]
    assert all(best <= solved(lam * f)[1] + 1e-12 for f in (0.5, 0.9, 1.1, 2.0, 10.0, 0.1))
    rest = own - got[at]
    assert abs(rest.sum()) < 1e-6 and abs(rest @ at) < 1e-4  # straight lines are not penalised


def test_short_series(panel, values_of):
    rows = {"six": [0.0, 3.0, 1.0, 5.0, 2.0, 7.0], "three": [1.0, 5.0, 2.0], "one": [4.0]}
    p = panel(rows)
    got = values_of(spline.fitted(p, spline.fit(p, factor=0.3)), "fitted")
    f, _, _ = sm.smooth_points(np.arange(6.0), np.array(rows["six"]), 0.3 * 6)
    assert got["six"] == pytest.approx(f.tolist(), abs=1e-9)
    assert got["three"] == [1.0, 5.0, 2.0] and got["one"] == [4.0]
    ahead = {(r.series_id, r.step): r.mean for r in spline.extrapolate(spline.fit(p, factor=0.3), 2).collect()}
    assert ahead["three", 1] == -1.0 and ahead["six", 2] - ahead["six", 1] == pytest.approx(ahead["six", 1] - f[-1])


def test_smoothing_of_the_preparation(panel, values_of):
    p = panel({"s": wavy(200, 7)})
    made = {k: values_of(prepare_panel(p, fill="linear", smoothing=k, lookback=4)["panel"], "smooth")["s"] for k in ("legacy", "pspline", "smoothing_spline")}
    filled = values_of(prepare_panel(p, fill="linear", smoothing="pspline", lookback=4)["panel"], "interpolated")["s"]
    rough = {k: np.square(np.diff(v, 2)).sum() for k, v in made.items()}
    assert rough["pspline"] < 0.2 * np.square(np.diff(filled, 2)).sum() and rough["smoothing_spline"] < rough["legacy"]
    with pytest.raises(ValueError):
        prepare_panel(p, smoothing="other")
