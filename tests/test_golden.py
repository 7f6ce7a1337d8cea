"""Small inputs with known results."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import (
    analysis as an, clean, conformal as cf, ensemble as en, folds, forecast as fc, hierarchy as hi, leaderboard as lb, metrics as mt,
    scenario as sc, selection as sel, trust as tr, windows as wn,
)

T0 = datetime(2024, 1, 1)


def hours(*hs):
    return [T0 + timedelta(hours=h) for h in hs]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "series_id string, step int, a double, p double")


def test_metrics_two_series(spark, panel):
    hist = panel({"s1": [1, 3], "s2": [2, 4]})
    pr = pairs(spark, [("s1", 1, 2.0, 3.0), ("s1", 2, 4.0, 3.0), ("s2", 1, 4.0, 4.0), ("s2", 2, 2.0, 4.0)])
    names = ["mape", "mase", "mae", "rmse", "smape"]
    wide = mt.evaluate(pr, names, scale=mt.naive_scale(hist))
    m = {r.metric: r.value for r in mt.macro(mt.to_long(wide, names, ["series_id"])).collect()}
    assert m == pytest.approx({"mape": 43.75, "mase": 0.5, "mae": 1.0, "rmse": 1.2071067811865475, "smape": 33.80952380952381})


def test_metrics_with_quantiles(spark, panel):
    hist = panel({"s": [1, 2, 3, 4]})
    pr = spark.createDataFrame(
        [("s", 1, 3.0, 2.0, {"0.1": 1.5, "0.9": 2.5, "bad": 1.0}), ("s", 2, 5.0, 6.0, {"0.1": 4.0, "0.9": 6.5, "2": 1.0})],
        "series_id string, step int, a double, p double, quantiles map<string,double>",
    )
    r = mt.evaluate(pr, ["wape", "rmsse", "pinball"], scale=mt.naive_scale(hist)).first()
    assert (r.wape, r.rmsse, r.pinball) == pytest.approx((25.0, 1.0, 0.2125))


def test_undefined_metrics(spark, panel):
    pr = pairs(spark, [("s", 1, 0.0, 0.0)])
    r = mt.evaluate(pr, ["mape", "smape", "wape", "mase"], scale=mt.naive_scale(panel({"s": [5, 5]}))).first()
    assert (r.mape, r.smape, r.wape, r.mase) == (None, None, None, None)


def raw(spark, rows):
    return spark.createDataFrame([("s", t, v) for t, v in rows], "series_id string, ts timestamp, y double")


def test_linear_grid(spark):
    df = raw(spark, zip(hours(0, 1, 2, 4, 5), [10.0, None, 12.0, 14.0, 15.0]))
    p, d, v = clean.regularize_and_impute(df, "h", "linear", max_missing_ratio=0.5)
    assert [r.y for r in p.orderBy("pos").collect()] == [10, 11, 12, 13, 14, 15]
    r = d.first()
    assert (r.original_rows, r.regular_rows, r.raw_nulls, r.missing_timestamps, r.imputed) == (5, 6, 1, 1, 2)
    assert v.count() == 0


def test_duplicate_collapse(spark):
    df = raw(spark, zip(hours(0, 0, 1, 3), [1.0, 3.0, None, 8.0]))
    p, d, _ = clean.regularize_and_impute(df, "h", "linear", max_missing_ratio=0.9)
    assert [r.y for r in p.orderBy("pos").collect()] == [2, 4, 6, 8]
    assert d.first().collapsed == 1


def test_seasonal_gap(panel, values_of):
    got = values_of(clean.seasonal(panel({"s": [1, 10, 2, 20, None, 30, 4, 40]}), 2), "y")["s"]
    assert got[4] == pytest.approx(7 / 3)


@pytest.mark.parametrize(
    "hs, ys, kw, text",
    [
        ((0, 1, 5), (1.0, 2.0, 3.0), {"max_gap": 2, "max_missing_ratio": 0.9}, "max missing gap 3 exceeds limit 2"),
        ((0, 1, 5), (1.0, 2.0, 3.0), {}, "missing ratio 0.5000 exceeds limit 0.3000"),
        ((0, 1, 2, 3), (None, 2.0, 3.0, 4.0), {"edge": "reject"}, "leading or trailing"),
        ((0, 1), (None, None), {}, "only null values"),
    ],
)
def test_limits_become_violations(spark, hs, ys, kw, text):
    _, d, v = clean.regularize_and_impute(raw(spark, zip(hours(*hs), ys)), "h", "linear", **kw)
    assert text in v.first().reason and d.count() == 0


def test_validation_reasons(panel):
    p = panel({"ok": [1, 2, 3, 4], "flat": [2, 2, 2], "inf": [1, float("inf"), 3], "gone": [None, None], "nan": [1.0, float("nan"), 2.0, 3.0, 4.0]})
    got = {r.series_id: r.reasons for r in clean.validate_series(p).collect()}
    assert got["ok"] == [] and got["nan"] == []
    assert got["flat"] == ["target is constant (zero variance)"]
    assert got["inf"] == ["target contains Inf/-Inf"]
    assert got["gone"] == ["target has no valid numeric values"]


def test_trend_anomaly_season(panel):
    assert an.trend(panel({"s": [1, 2, 3, 4, 5]})).first().direction == "up"
    flat = an.trend(panel({"s": [3, 3, 3]})).first()
    assert (flat.direction, flat.r2) == ("flat", 0.0)
    assert [r.pos for r in an.anomalies(panel({"s": [1, 1.2, 1.1, 1, 9, 1.2, 1.1]})).collect()] == [4]
    assert 4 in an.seasonality(panel({"s": [(i % 4) - 1 for i in range(48)]}), 20).first().periods
    assert an.stationarity(panel({"s": [1, 2, 1]})).first().stationary is None


def test_features(panel, values_of):
    f = wn.feature_bundle(panel({"s": list(range(100)), "ones": [1] * 100}))
    lag = values_of(f, "lag_1")
    assert lag["s"][:2] == [None, 0.0]
    assert values_of(f, "rolling_std_7")["ones"][6] == 0.0
    assert all(0 <= v <= 1 for v in values_of(f, "day_of_week")["s"])
    assert values_of(f, "hour_of_day")["s"][0] is None  # constant in daily data


def test_ensembles(spark):
    rows = [("a", "s", 1, 1.0), ("a", "s", 2, 3.0), ("b", "s", 1, 3.0), ("b", "s", 2, 5.0)]
    f = spark.createDataFrame(rows, "model string, series_id string, step int, mean double")
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "model string, weight double")
    assert [r.mean for r in en.merge(f, "mean", w).orderBy("step").collect()] == [2.5, 4.5]
    g = spark.createDataFrame([("a", "s", 1, 1.0), ("b", "s", 1, 2.0), ("c", "s", 1, 10.0)], f.schema)
    w = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "model string, weight double")
    assert en.merge(g, "median", w).first().mean == 2.0
    assert en.merge(g, "trimmed_mean").first().mean == 2.0
    assert en.merge(g, "winsorized_mean").first().mean == 2.0
    assert en.merge(g, "mean", min_models=4).count() == 0


def test_conformal(spark):
    a, p = [[10, 11, 12], [20, 21, 22]], [[9.5, 11.5, 12], [19.5, 21.5, 22]]
    rows = [("s", i * 3 + j, 6, float(a[i][j]), float(p[i][j])) for i in range(2) for j in range(3)]
    c = cf.calibrate(spark.createDataFrame(rows, "series_id string, pos long, n long, a double, p double"), 0.9)
    assert c.first().q_hat == 0.5
    f = spark.createDataFrame([("s", 1, 10.0, {"0.5": 10.0})], "series_id string, step int, mean double, quantiles map<string,double>")
    q = cf.intervals(f, c, 0.9).first().quantiles
    assert q == {"0.5": 10.0, "0.05": 9.5, "0.95": 10.5}


@pytest.fixture
def small_tree(spark):
    e = spark.createDataFrame([("h", "total", "a"), ("h", "total", "b")], "hierarchy_id string, parent string, child string")
    vals = {"total": [100, 200, 300], "a": [60, 120, 180], "b": [50, 90, 130], "other": [1, 2, 3]}
    f = spark.createDataFrame([("h", s, i + 1, float(v)) for s, vs in vals.items() for i, v in enumerate(vs)], "hierarchy_id string, series_id string, step int, mean double")
    return e, f


def test_hierarchy(small_tree):
    e, f = small_tree
    assert {(r.ancestor, r.leaf): r.k for r in hi.closure(e).collect()} == {("total", "a"): 1, ("total", "b"): 1, ("a", "a"): 1, ("b", "b"): 1}
    assert hi.coherency(e, f).count() == 1
    for method, tol in (("bottom_up", 1e-10), ("top_down", 1e-9), ("ols", 1e-6), ("mint_shrink", 1e-5)):
        r = hi.reconcile(e, f, method)
        assert hi.coherency(e, r, tol).count() == 0, method
        assert r.where("series_id = 'other'").count() == 3
    bu = {r.step: r.mean for r in hi.reconcile(e, f).where("series_id = 'total'").collect()}
    assert bu == {1: 110, 2: 210, 3: 310}


def test_counterfactual(panel):
    p = panel({"s": [10, 11, 12, 20, 22]})

    def steady(y, h, q):
        return {"mean": [12.0, 13.0]}

    steps, s = sc.counterfactual(p, F.lit(3), fc.GroupedModel("steady", steady), horizon=2)
    assert [r.actual for r in steps.orderBy("step").collect()] == [20, 22]
    r = s.first()
    assert (r.total_delta, r.direction) == (17.0, "above_counterfactual")


def test_scenario_tree(panel):
    t = sc.scenario_tree(panel({"s": [10, 11, 12, 11, 13]}), "last_value", 2, [0.1, 0.9])
    rows = t.collect()
    assert len(rows) == 7
    for d in (0, 1, 2):
        assert sum(r.probability for r in rows if r.depth == d) == pytest.approx(1.0)
    assert {r.parent_id for r in rows if r.depth == 2} == {"root/q0.1", "root/q0.9"}


def test_routing(spark):
    s = spark.createDataFrame([("accurate", 0.82, 260.0), ("balanced", 0.95, 140.0), ("fast", 1.15, 60.0)], "model string, mase double, latency_ms double")
    lane = {r.lane: r.model for r in lb.lanes(lb.routing_ranks(s, ["mase"])).collect()}
    assert lane == {"default": "accurate", "fast_path": "fast", "high_accuracy": "accurate"}


def test_equal_weights_when_a_model_is_undefined(spark):
    agg = spark.createDataFrame([("a", "mase", 0.5)], "model string, metric string, value double")
    names = spark.createDataFrame([("a",), ("b",)], "model string")
    assert {r.model: r.weight for r in lb.inverse_error_weights(agg, names).collect()} == {"a": 1.0, "b": 1.0}


def test_trust_aliases(spark):
    p = spark.createDataFrame([("BTC", 12.0, 0.2, 0.1, 0.9)], "symbol string, spread_bps double, volatility_regime double, slippage_risk double, freshness_score double")
    n = tr.normalize(p, tr.FINANCIAL).first()
    assert (n.item_id, n.bid_ask_spread_bps, n.realized_volatility, n.execution_risk, n.data_freshness, n.liquidity_depth) == ("BTC", 12.0, 0.2, 0.1, 0.9, 0.5)
    r = tr.score(p, "financial_market").first()
    assert r.trust_score == pytest.approx(0.25 * 0.5 + 0.25 * 0.88 + 0.25 * 0.8 + 0.15 * 0.9 + 0.1 * 0.9)
    assert (r.risk_category, r.status) == ("GREEN", "high_trust")


def test_folds(spark):
    lengths = spark.createDataFrame([("long", 100), ("short", 40), ("tiny", 20)], "series_id string, n long")
    got = sorted((r.series_id, r.fold, r.train_end, r.test_end) for r in folds.generate_folds(lengths, 14).collect())
    assert got == [("long", 0, 58, 72), ("long", 1, 72, 86), ("long", 2, 86, 100)]


def test_recommendation_rules(spark, panel):
    r = {x.model: x for x in sel.recommend(sel.series_profile(panel({"s": [1, 2, 3]})), horizon=300).collect()}
    assert r["moirai-2.0-R-small"].reasons == ["restricted_license"]
    assert r["timesfm-2.5-200m"].reasons == ["horizon_exceeds_limit:256"]
    assert r["timemixer-base"].reasons == ["forecast_not_ready"]
    assert r["mock"].score == 79 and r["sundial-base-128m"].score == 108


def test_failing_series_does_not_fail_the_job(panel):
    def picky(y, h, q):
        if len(y) < 3:
            raise ValueError("too short")
        return {"mean": [y[-1]] * h}

    out = fc.forecast(panel({"a": [1, 2, 3], "b": [1]}), fc.GroupedModel("picky", picky), 2)
    got = {(r.series_id, r.step): (r.mean, r.error) for r in out.collect()}
    assert got == {("a", 1): (3.0, None), ("a", 2): (3.0, None), ("b", None): (None, "ValueError: too short")}


def test_unmatched_transform(panel):
    plan = {"x": [sc.Transform("target", "add", 1.0, series_id="nope")]}
    assert sc.unmatched_transforms(panel({"s": [1]}), plan).count() == 1
