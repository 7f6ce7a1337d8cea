"""Fallback forecasts and the composite report on small panels."""

import math

from tidepanel.operators import forecast as fc, selection as sel
from tidepanel.plans.report import forecast_report


def wave(n):
    return [10 + 3 * math.sin(2 * math.pi * i / 7) for i in range(n)]


def test_fallback_only_for_series_without_result(spark, panel):
    p = panel({"long": wave(30), "short": [1.0, 2.0, 4.0]})
    cands = spark.createDataFrame([(s, m, r) for s in ("long", "short") for m, r in (("a", 1), ("b", 2))], "series_id string, model string, rank int")
    runners = {"a": lambda h, k: fc.seasonal_naive(h.where("n >= 7"), k, 7), "b": fc.last_value}
    got = sel.forecast_with_fallback(p, cands, runners, 2, [1, 2]).collect()
    assert {(r.series_id, r.model, r["rank"]) for r in got} == {("long", "a", 1), ("short", "b", 2)}
    assert len(got) == 4 and {r.mean for r in got if r.series_id == "short"} == {4.0}


def test_report(panel):
    p = panel({"a": wave(42), "b": [5.0] * 40 + [50.0, 5.0]})
    rep = forecast_report(p, 3, {"tide": fc.linear_trend, "patchtst": fc.last_value})
    assert rep["analysis"].count() == 2
    assert {r.series_id: r.periods[0] for r in rep["analysis"].where("series_id = 'a'").collect()} == {"a": 7}
    f = rep["forecast"].collect()
    assert sorted((r.series_id, r.step) for r in f) == [(s, k) for s in "ab" for k in (1, 2, 3)]
    s = rep["summary"].first()
    assert s.series == 2 and s.model in ("tide", "patchtst")


def test_fingerprint_is_the_references(spark):
    import hashlib

    from tidepanel.operators.leaderboard import dataset_fingerprint

    rows = [(f"s{i:03d}", i + 1, "D") for i in range(300)]
    df = spark.createDataFrame(rows[::-1], "series_id string, points long, freq string").repartition(7)
    expected = hashlib.sha256("|".join(f"{s}:{n}:{f}" for s, n, f in rows).encode()).hexdigest()[:16]
    assert [r.fingerprint for r in dataset_fingerprint(df).collect()] == [expected]
