"""User models: whole requests, streamed histories, paths, timings, chains of candidates."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import attribution as at, folds, forecast as fc, scenario as sc, selection as sel
from tidepanel.plans.benchmark import run_benchmark

DAY = timedelta(days=1)
T0 = datetime(2024, 1, 1)


def covariates(spark, n):
    rows = [("s", "past", "promo", T0 + DAY * i, float(i * i), None) for i in range(n)]
    rows += [("s", "future", "promo", T0 + DAY * i, float(i * i), None) for i in range(n, n + 4)]
    rows += [("s", "past", "seen", T0 + DAY * i, None, "x" if i % 2 else "y") for i in range(n + 2)]
    rows += [("s", "static", "area", None, 7.0, None)]
    return spark.createDataFrame(rows, "series_id string, role string, name string, ts timestamp, num double, cat string")


def test_a_request_has_everything(spark, panel):
    def probe(request):
        assert request["keys"] == {"series_id": "s"} and request["freq"] == "D" and request["static"] == {"area": 7.0}
        assert request["target"].tolist() == [float(i) for i in range(10)] and len(request["timestamps"]) == 10
        assert request["timestamps"][-1] - request["timestamps"][0] == np.timedelta64(9, "D")
        assert request["past_covariates"]["promo"].tolist() == [float(i * i) for i in range(10)]
        assert request["future_covariates"]["promo"].tolist() == [100.0, 121.0, 144.0]  # as many as the horizon
        assert request["past_covariates"]["seen"].tolist() == ["y", "x"] * 5 and set(request["future_covariates"]) == {"promo"}
        return {"mean": [request["horizon"], len(request["quantiles"])], "quantiles": {"0.9": [1.0, 2.0]}}

    model = fc.RequestModel("probe", probe, covariates(spark, 10), "D")
    rows = fc.forecast(panel({"s": list(range(10))}), model, 3, [0.9]).collect()
    assert [(r.step, r.mean, r.quantiles, r.error) for r in sorted(rows, key=lambda r: r.step or 0)] == [(1, 3.0, {"0.9": 1.0}, None), (2, 1.0, {"0.9": 2.0}, None)]


def test_folds_see_what_was_known(spark, panel):
    seen = "series_id string, role string, name string, ts timestamp, num double, cat string"
    rows = [("s", role, "promo", T0 + DAY * i, float(i), None) for i in range(60) for role in ("past", "future")]
    model = fc.RequestModel("promo", lambda r: {"mean": r["future_covariates"]["promo"] + len(r["past_covariates"]["promo"])}, spark.createDataFrame(rows, seen))
    parts = folds.fold_rows(panel({"s": list(range(60))}), 5, num_folds=2)
    got = {(r.fold, r.step): r.mean for r in fc.forecast(folds.fold_history(parts), model, 5, keys=["fold", "series_id"]).collect()}
    assert got == {(f, k): end + k - 1 + end for f, end in ((0, 50.0), (1, 55.0)) for k in range(1, 6)}


def test_long_histories_are_whole(panel):
    p = panel({"s": [1.0] * 9000, "t": [2.0] * 5})
    length = fc.GroupedModel("length", lambda y, h, q: {"mean": [len(y)]})
    assert {r.series_id: r.mean for r in fc.forecast(p, length, 1).collect()} == {"s": 9000.0, "t": 5.0}
    short = fc.GroupedModel("length", lambda y, h, q: {"mean": [len(y)]}, max_context=100)
    assert {r.series_id: r.mean for r in fc.forecast(p, short, 1).collect()} == {"s": 100.0, "t": 5.0}


@pytest.mark.parametrize("name", fc.LOCAL)
def test_native_models_inside_a_task(panel, name):
    rng = np.random.default_rng(3)
    p = panel({"a": rng.normal(size=40).tolist(), "b": (rng.normal(size=23) + np.arange(23)).tolist(), "flat": [4.0] * 15})
    key = lambda rows: {(r.series_id, r.step): r for r in rows}
    jobs, slot = (key(f.collect()) for f in (fc.forecast(p, name, 9, [0.1, 0.9]), fc.forecast(p, fc.local_model(name), 9, [0.1, 0.9])))
    assert jobs.keys() == slot.keys()
    for k, r in jobs.items():
        assert slot[k].mean == pytest.approx(r.mean) and slot[k].quantiles == pytest.approx(r.quantiles)


def test_tree_of_a_user_model_and_its_warnings(panel):
    def drift(y, horizon, levels):
        if len(y) > 6 and y[-1] > 100:
            raise RuntimeError("too high")
        return {"mean": [y[-1] + 1], "quantiles": {"0.1": [y[-1] - 1]}}

    nodes = sc.scenario_tree(panel({"s": [1.0] * 6, "high": [200.0] * 6}), fc.GroupedModel("drift", drift), 2, [0.1, 0.9]).collect()
    got = {(r.series_id, r.node_id): r.value for r in nodes}
    assert got["s", "root/q0.1"] == 0.0 and got["s", "root/q0.9"] == 0.0  # the nearest level given
    assert got["s", "root/q0.1/q0.1"] == -1.0 and len([k for k in got if k[0] == "s"]) == 7
    lost = [r for r in nodes if r.series_id == "high" and r.depth == 2]
    assert all(r.value is None and "missing forecast" in r.warning for r in lost) and len(lost) == 2
    alone = sc.scenario_tree(panel({"s": [1.0, 3.0]}), fc.GroupedModel("mean", lambda y, h, q: {"mean": [y.mean()]}), 1, [0.2]).collect()
    assert [r.value for r in alone if r.depth == 1] == [2.0]


def test_what_if_and_counterfactual_warnings(panel):
    p = panel({"s": [1.0] * 10, "odd": [5.0] * 4})
    picky = fc.GroupedModel("picky", lambda y, h, q: {"mean": [1.0] * h} if len(y) > 4 else {}["none"])
    found = {(r.scenario, r.series_id): r.warning for r in sc.what_if_problems(p, {"up": [sc.Transform("target", "multiply", 2.0)]}, picky, 3).collect()}
    assert found.keys() == {("baseline", "odd"), ("up", "odd")} and all("missing forecast" in w for w in found.values())
    steps, _ = sc.counterfactual(p, F.lit(6), "last_value", horizon=4)
    assert [(r.series_id, r.warning[:23]) for r in sc.counterfactual_warnings(p, F.lit(6), steps, 4).collect()] == [("odd", "no post-intervention po")]


def test_measured_latency(panel):
    import time

    def slow(y, horizon, levels):
        time.sleep(0.02)
        return {"mean": [y[-1]] * horizon}

    p = panel({"a": list(range(60)), "b": list(range(60))})
    r = run_benchmark(p, ["last_value", fc.GroupedModel("slow", slow)], 5, num_folds=2, measure=True)
    timed = {x.model: x for x in r["latency"].collect()}
    assert timed["slow"].latency_ms >= 20 > timed["last_value"].latency_ms > 0 and timed["slow"].calls == 4
    plain = run_benchmark(p, ["last_value", "linear_trend"], 5, num_folds=2)["aggregate"].collect()
    again = run_benchmark(p, ["last_value", "linear_trend"], 5, num_folds=2, measure=True)["aggregate"].collect()
    assert {(x.model, x.metric): x.value for x in again} == pytest.approx({(x.model, x.metric): x.value for x in plain})


def test_auto_forecast_chain(spark, panel):
    p = panel({"a": list(range(20)), "b": [3.0]})
    ranked = spark.createDataFrame([(s, r, m) for s in "ab" for r, m in ((1, "linear_trend"), (2, "last_value"))], "series_id string, rank int, model string")
    runners = {"last_value": fc.last_value, "linear_trend": lambda h, k: fc.linear_trend(h.where("n > 5"), k)}
    r = sel.auto_forecast(p, ranked, runners, 2, lane="nowhere", explicit="linear_trend")
    got = {x.series_id: (x.model, x.stage, x.rank) for x in r["forecast"].collect()}
    assert got == {"a": ("linear_trend", "explicit", 2), "b": ("last_value", "ranked", 3)}
    tried = sorted((x.series_id, x.rank, x.model, x.outcome, x.reason) for x in r["attempts"].collect() if x.series_id == "b")
    assert [t[2:4] for t in tried] == [("nowhere", "failed"), ("linear_trend", "failed"), ("last_value", "ok")] and tried[0][4] == "model is not available"
    one = sel.auto_forecast(p, ranked, runners, 2, lane="nowhere", allow_fallback=False)
    assert one["forecast"].count() == 0 and one["attempts"].count() == 2


@pytest.mark.parametrize("name", ["last_value", "seasonal_naive", "linear_trend"])
def test_attribution_by_weights_is_that_of_variants(panel, name):
    """Weights of native models give what forecasting every variant gives."""
    rng = np.random.default_rng(5)
    p = panel({"s": rng.normal(size=17).tolist(), "t": rng.normal(size=5).tolist()})
    for attribute, options in ((at.occlusion, {"window": 4}), (at.permutation, {"repeats": 3})):
        for horizon in (1, 9):
            by_weight, by_variant = (
                {(r.series_id, r.pos): r.importance for r in attribute(p, horizon=horizon, predict=model, **options).collect()} for model in (name, fc.local_model(name))
            )
            assert by_weight == pytest.approx(by_variant, abs=1e-9) and len(by_weight) == 22


def test_compare_isolates_models(panel):
    p = panel({"a": [1.0, 2.0], "b": [3.0]})
    rows = fc.compare(p, ["last_value", "unheard_of"], 2).collect()
    assert sum(r.model == "last_value" and r.error is None for r in rows) == 4
    assert {r.series_id for r in rows if r.model == "unheard_of" and "unknown model" in r.error} == {"a", "b"}
