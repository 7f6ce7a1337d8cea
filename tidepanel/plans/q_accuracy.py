"""Forecasts and their accuracy on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import folds, forecast as fc, metrics as mt
from tidepanel.operators.blocks import number_rows
from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.session import table

H = 7
HOLD = (
    f"WITH {pn.EVENTS_DAILY}, hist AS (SELECT * FROM events_daily WHERE pos < n - 7),"
    " lastv AS (SELECT series_id, arg_max(y, pos) AS p FROM hist GROUP BY 1),"
    " pairs AS (SELECT t.series_id, t.pos - (t.n - 7) + 1 AS step, t.y AS a, l.p FROM events_daily t"
    " JOIN lastv l USING (series_id) WHERE t.pos >= t.n - 7),"
    " scl AS (SELECT series_id, avg(abs(d)) AS scale_abs, avg(d * d) AS scale_sq FROM (SELECT series_id, y - lag(y, 1)"
    " OVER (PARTITION BY series_id ORDER BY pos) AS d FROM hist) GROUP BY 1)"
)


def _pairs(spark, sf):
    history, actuals = folds.holdout(pn.events_daily(spark, sf), H)
    fcst = fc.last_value(history, H).withColumnRenamed("mean", "p")
    return history, mt.match_forecasts(actuals, fcst)


@query(
    "f02_last_value_holdout",
    HOLD + ", per AS (SELECT series_id, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse,"
    " avg(CASE WHEN abs(a) + abs(p) > 0 THEN 200 * abs(a - p) / (abs(a) + abs(p)) END) AS smape FROM pairs GROUP BY 1)"
    " SELECT series_id, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(smape, 6) AS smape FROM per"
    " UNION ALL SELECT '__macro__', round(avg(mae), 6), round(avg(rmse), 6), round(avg(smape), 6) FROM per",
)
def f02_last_value_holdout(spark, sf):
    _, pairs = _pairs(spark, sf)
    names = ["mae", "rmse", "smape"]
    out = mt.with_macro_row(mt.evaluate(pairs, names), names)
    return out.select("series_id", *[F.round(m, 6).alias(m) for m in names])


def _metric(name: str, expr: str, key: str):
    @query(key, HOLD + f" SELECT series_id, round({expr}, 6) AS {name} FROM pairs LEFT JOIN scl USING (series_id) GROUP BY 1")
    def run(spark, sf, name=name):
        history, pairs = _pairs(spark, sf)
        scale = mt.naive_scale(history) if name in mt.NEEDS_SCALE else None
        return mt.evaluate(pairs, [name], scale=scale).select("series_id", F.round(name, 6).alias(name))

    return run


_metric("mape", "100 * avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END)", "a03_mape")
_metric("mase", "avg(abs(a - p)) / nullif(max(scale_abs), 0)", "a04_mase")
_metric("mae", "avg(abs(a - p))", "a05_mae")
_metric("rmse", "sqrt(avg((a - p) * (a - p)))", "a06_rmse")
_metric("smape", "avg(CASE WHEN abs(a) + abs(p) > 0 THEN 200 * abs(a - p) / (abs(a) + abs(p)) END)", "a07_smape")
_metric("wape", "100 * sum(abs(a - p)) / nullif(sum(abs(a)), 0)", "a08_wape")
_metric("rmsse", "sqrt(avg((a - p) * (a - p)) / nullif(max(scale_sq), 0))", "a09_rmsse")

# z values of the standard normal at 0.1, 0.5 and 0.9
Z10 = "1.2815515655446008"
SCALE_SQL = (
    ", dif AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM hist),"
    " med AS (SELECT series_id, list_sort(list(d))[1 + count(d) // 2] AS m FROM dif WHERE d IS NOT NULL GROUP BY 1),"
    " mad AS (SELECT series_id, list_sort(list(abs(d - m)))[1 + count(d) // 2] AS mad FROM dif JOIN med USING (series_id)"
    " WHERE d IS NOT NULL GROUP BY 1),"
    " shp AS (SELECT series_id, max(y) - min(y) AS rng, abs(arg_max(y, pos)) AS lst FROM hist GROUP BY 1),"
    " scale AS (SELECT series_id, CASE WHEN 1.4826 * mad > 1e-9 THEN 1.4826 * mad WHEN rng > 0 THEN rng / 6"
    " ELSE greatest(lst * 0.01, 1e-6) END AS s FROM shp LEFT JOIN mad USING (series_id))"
)


@query(
    "a10_pinball",
    HOLD + SCALE_SQL + ", q AS (SELECT p.series_id, a, lvl, p.p + z * s * sqrt(step) AS f FROM pairs p JOIN scale USING (series_id),"
    f" (VALUES (0.1, -{Z10}), (0.5, 0.0), (0.9, {Z10})) AS v(lvl, z))"
    " SELECT series_id, round(avg(CASE WHEN a >= f THEN lvl * (a - f) ELSE (lvl - 1) * (a - f) END), 6) AS pinball FROM q GROUP BY 1",
)
def a10_pinball(spark, sf):
    history, actuals = folds.holdout(pn.events_daily(spark, sf), H)
    fcst = fc.forecast(history, "last_value", H, quantiles=[0.1, 0.5, 0.9]).withColumnRenamed("mean", "p")
    pairs = mt.match_forecasts(actuals, fcst)
    return mt.evaluate(pairs, ["pinball"]).select("series_id", F.round("pinball", 6).alias("pinball"))


@query(
    "f06_quantile_fallback",
    HOLD + SCALE_SQL + " SELECT series_id, CAST(step AS INTEGER) AS step, q AS level, round(p + z * s * sqrt(step), 6) AS value FROM lastv"
    f" JOIN scale USING (series_id), range(1, 8) AS r(step), (VALUES ('0.1', -{Z10}), ('0.5', 0.0), ('0.9', {Z10})) AS v(q, z)",
)
def f06_quantile_fallback(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), H)
    rows = fc.forecast(history, "last_value", H, quantiles=[0.1, 0.5, 0.9])
    return rows.select("series_id", "step", F.explode("quantiles").alias("level", "value")).select(
        "series_id", "step", "level", F.round("value", 6).alias("value")
    )


@query(
    "a11_macro",
    HOLD + ", per AS (SELECT series_id, avg(abs(a - p)) AS mae, 100 * avg(CASE WHEN a <> 0 THEN abs((a - p) / a) END) AS mape,"
    " avg(abs(a - p)) / nullif(max(scale_abs), 0) AS mase FROM pairs LEFT JOIN scl USING (series_id) GROUP BY 1)"
    " SELECT m AS metric, round(avg(v), 6) AS value FROM (SELECT 'mae' AS m, mae AS v FROM per UNION ALL SELECT 'mape', mape FROM per"
    " UNION ALL SELECT 'mase', mase FROM per) GROUP BY 1 HAVING avg(v) IS NOT NULL",
)
def a11_macro(spark, sf):
    history, pairs = _pairs(spark, sf)
    names = ["mae", "mape", "mase"]
    wide = mt.evaluate(pairs, names, scale=mt.naive_scale(history))
    return mt.macro(mt.to_long(wide, names, ["series_id"])).select("metric", F.round("value", 6).alias("value"))


@query(
    "a24_epsilon_metrics",
    HOLD + " SELECT series_id, round(100 * avg(abs((a - p) / greatest(abs(a), 1e-9))), 6) AS mape,"
    " round(100 * avg(2 * abs(a - p) / greatest(abs(a) + abs(p), 1e-9)), 6) AS smape FROM pairs GROUP BY 1",
)
def a24_epsilon_metrics(spark, sf):
    _, pairs = _pairs(spark, sf)
    out = mt.evaluate(pairs, ["mape", "smape"], zero_policy="epsilon")
    return out.select("series_id", F.round("mape", 6).alias("mape"), F.round("smape", 6).alias("smape"))


@query(
    "e04_metric_registry",
    HOLD + " SELECT series_id, 'bias' AS metric, round(avg(a - p), 6) AS value FROM pairs GROUP BY 1"
    " UNION ALL SELECT series_id, 'mae', round(avg(abs(a - p)), 6) FROM pairs GROUP BY 1",
)
def e04_metric_registry(spark, sf):
    """A user metric is one more aggregate builder in the registry."""
    mt.REGISTRY.setdefault("bias", lambda _: F.avg(F.col("a") - F.col("p")))
    _, pairs = _pairs(spark, sf)
    long = mt.to_long(mt.evaluate(pairs, ["bias", "mae"]), ["bias", "mae"], ["series_id"])
    return long.withColumn("value", F.round("value", 6))


# ---- joins of history, actuals and forecasts -------------------------------------------------


@query(
    "j01_missing_forecasts",
    HOLD + " SELECT DISTINCT series_id, 'metrics skipped for series ''' || series_id || ''': missing matching forecast output' AS warning"
    " FROM pairs WHERE series_id = 'error'",
)
def j01_missing_forecasts(spark, sf):
    history, actuals = folds.holdout(pn.events_daily(spark, sf), H)
    return mt.unmatched_series(actuals, fc.last_value(history.where("series_id <> 'error'"), H))


@query(
    "j02_actual_prediction_overlap",
    HOLD + " SELECT series_id, CAST(step AS INTEGER) AS step, a, p FROM pairs WHERE step <= 5",
)
def j02_actual_prediction_overlap(spark, sf):
    history, actuals = folds.holdout(pn.events_daily(spark, sf), H)
    fcst = fc.last_value(history, 5).withColumnRenamed("mean", "p")
    return mt.match_forecasts(actuals, fcst).select("series_id", "step", "a", "p")


# ---- native forecasters ----------------------------------------------------------------------

LINE_SQL = " fit AS (SELECT series_id, max(n) AS n, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM panel GROUP BY 1)"
PROFILE_SQL = (
    " line AS (SELECT series_id, max(n) AS n, avg(y) AS level, coalesce(regr_slope(y, pos), 0) AS slope FROM panel GROUP BY 1),"
    " ph AS (SELECT p.series_id, pos % 7 AS phase, avg(y - (level + slope * (pos - (p.n - 1) / 2))) AS m FROM panel p"
    " JOIN line USING (series_id) GROUP BY 1, 2),"
    " tmpl AS (SELECT series_id, phase, m - avg(m) OVER (PARTITION BY series_id) AS s FROM ph)"
)
OD = f"WITH {pn.ORDERS_DAILY}, panel AS (SELECT * FROM orders_daily),"


@query(
    "f03_seasonal_naive",
    OD + " x AS (SELECT 1) SELECT series_id, CAST(step AS INTEGER) AS step, y AS mean FROM panel, range(1, 15) AS r(step)"
    " WHERE pos = n - 7 + ((step - 1) % 7)",
)
def f03_seasonal_naive(spark, sf):
    return fc.seasonal_naive(pn.orders_daily(spark, sf), 14, 7)


@query(
    "f04_linear_trend",
    OD + LINE_SQL + " SELECT series_id, CAST(step AS INTEGER) AS step, round(my + b * (n - 1 + step - mx), 3) AS mean FROM fit, range(1, 15) AS r(step)",
)
def f04_linear_trend(spark, sf):
    return fc.linear_trend(pn.orders_daily(spark, sf), 14).withColumn("mean", F.round("mean", 3))


@query(
    "f05_seasonal_profile",
    OD + PROFILE_SQL + " SELECT l.series_id, CAST(step AS INTEGER) AS step,"
    " round(level + slope * (n - 1 + step - (n - 1) / 2) + s, 3) AS mean FROM line l, range(1, 15) AS r(step)"
    " JOIN tmpl t ON true WHERE t.series_id = l.series_id AND t.phase = (n - 1 + step) % 7",
)
def f05_seasonal_profile(spark, sf):
    return fc.seasonal_profile(pn.orders_daily(spark, sf), 14, 7).withColumn("mean", F.round("mean", 3))


@query(
    "f07_sample_quantiles",
    "WITH s AS (SELECT event_type AS series_id, CAST(day(ts) AS INTEGER) AS step, value AS y FROM events)"
    " SELECT series_id, step, round(quantile_cont(y, 0.1), 6) AS q0_1, round(quantile_cont(y, 0.5), 6) AS q0_5,"
    " round(quantile_cont(y, 0.9), 6) AS q0_9 FROM s GROUP BY 1, 2",
)
def f07_sample_quantiles(spark, sf):
    """Each event is one sampled value of its type's daily path."""
    ev = table(spark, sf, "events")
    samples = ev.select(
        F.col("event_type").alias("series_id"), F.dayofmonth("ts").alias("step"), "ts", "event_id", F.col("value").alias("y")
    )
    keys = ["series_id", "step"]
    out = fc.quantiles_from_samples(number_rows(samples, ("ts", "event_id"), keys), [0.1, 0.5, 0.9], keys)
    return out.select(*keys, *[F.round(F.col(f"`q{q}`"), 6).alias(f"q{q}".replace(".", "_")) for q in ("0.1", "0.5", "0.9")])


@query(
    "f08_quantile_channels",
    HOLD + SCALE_SQL + " SELECT series_id, CAST(step AS INTEGER) AS step, round(p + z * s * sqrt(step), 6) AS q90, CAST(NULL AS DOUBLE) AS q25"
    f" FROM lastv JOIN scale USING (series_id), range(1, 8) AS r(step), (VALUES ({Z10})) AS v(z)",
)
def f08_quantile_channels(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), H)
    rows = fc.pick_channels(fc.forecast(history, "last_value", H, quantiles=[0.1, 0.9]), [0.9, 0.25])
    return rows.select("series_id", "step", F.round(F.col("quantiles")["0.9"], 6).alias("q90"), F.col("quantiles")["0.25"].alias("q25"))


@query(
    "f01_plugin_model",
    OD + " t AS (SELECT series_id, pos, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM panel WHERE pos >= n - 512),"
    " s AS (SELECT series_id, arg_max(y, pos) AS lv, avg(d) AS m, stddev_pop(d) AS sd FROM t GROUP BY 1)"
    " SELECT 'damped_drift' AS model, series_id, CAST(h AS INTEGER) AS step, round(lv + m * (1 - pow(0.9, h)) / (1 - 0.9), 3) AS mean,"
    f" round(lv + m * (1 - pow(0.9, h)) / (1 - 0.9) + {Z10} * sd * sqrt(h), 3) AS q90, CAST(NULL AS VARCHAR) AS error FROM s, range(1, 15) AS r(h)",
)
def f01_plugin_model(spark, sf):
    """A user's Python model (damped drift) through the grouped-map slot, one series per call."""
    model = fc.GroupedModel("damped_drift", damped_drift, max_context=512)
    out = fc.forecast(pn.orders_daily(spark, sf), model, 14, quantiles=[0.1, 0.9])
    return out.select("model", "series_id", "step", F.round("mean", 3).alias("mean"), F.round(F.col("quantiles")["0.9"], 3).alias("q90"), "error")


def damped_drift(y, horizon, levels):
    """Drift of the context, damped by 0.9 per step; bands widen with the spread of the differences."""
    import numpy as np
    from statistics import NormalDist

    d = np.diff(y) if len(y) > 1 else np.zeros(1)
    h = np.arange(1, horizon + 1)
    mean = y[-1] + d.mean() * np.cumsum(0.9 ** (h - 1))
    return {
        "mean": mean.tolist(),
        "quantiles": {f"{q:g}": (mean + NormalDist().inv_cdf(q) * d.std() * np.sqrt(h)).tolist() for q in levels},
    }


@query(
    "f09_compare_models",
    HOLD + " SELECT m AS model, count(DISTINCT series_id) AS series, CAST(0 AS BIGINT) AS failed, 'ok' AS status FROM hist,"
    " (VALUES ('last_value'), ('linear_trend'), ('seasonal_naive')) AS v(m) GROUP BY 1",
)
def f09_compare_models(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), H)
    return fc.compare_summary(fc.compare(history, ["last_value", "linear_trend", "seasonal_naive"], H), H)


@query(
    "f09_compare_errors",
    HOLD + " SELECT m AS model, count(DISTINCT series_id) AS series, CASE WHEN m = 'last_value' THEN CAST(0 AS BIGINT) ELSE count(DISTINCT series_id) END AS failed, CASE WHEN m = 'last_value' THEN 'ok' ELSE 'error' END AS status FROM hist,"
    " (VALUES ('last_value'), ('unheard_of'), ('broken')) AS v(m) GROUP BY 1",
)
def f09_compare_errors(spark, sf):
    """An unknown model and one that fails answer with error rows; the third is not affected."""
    history, _ = folds.holdout(pn.events_daily(spark, sf), H)

    def broken(y, horizon, levels):
        raise RuntimeError("no model here")

    return fc.compare_summary(fc.compare(history, ["last_value", "unheard_of", fc.GroupedModel("broken", broken)], H), H)


# ---- folds -----------------------------------------------------------------------------------

FOLDS_SQL = (
    " folds AS (SELECT series_id, CAST(2 - i AS INTEGER) AS fold, n - (i + 1) * 14 AS train_end, n - (i + 1) * 14 AS test_start,"
    " n - i * 14 AS test_end FROM (SELECT series_id, max(n) AS n FROM panel GROUP BY 1), range(0, 3) AS r(i)"
    " WHERE n - (i + 1) * 14 >= 32)"
)


@query("w15_walk_forward_folds", OD + FOLDS_SQL + " SELECT * FROM folds")
def w15_walk_forward_folds(spark, sf):
    lengths = pn.orders_daily(spark, sf).groupBy("series_id").agg(F.max("n").alias("n"))
    return folds.generate_folds(lengths, 14)


@query(
    "f11_fold_requests",
    OD + FOLDS_SQL + " SELECT fold, p.series_id, CASE WHEN pos < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS rows,"
    " round(sum(y), 2) AS total FROM panel p JOIN folds f ON p.series_id = f.series_id AND pos < test_end GROUP BY 1, 2, 3",
)
def f11_fold_requests(spark, sf):
    rows = folds.fold_rows(pn.orders_daily(spark, sf), 14)
    return rows.groupBy("fold", "series_id", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("y"), 2).alias("total")
    )


@query(
    "f12_fold_metrics",
    OD + FOLDS_SQL + ", lv AS (SELECT fold, p.series_id, arg_max(y, pos) AS p FROM panel p JOIN folds f ON p.series_id = f.series_id"
    " AND pos < train_end GROUP BY 1, 2),"
    " sc AS (SELECT fold, series_id, avg(abs(d)) AS s FROM (SELECT fold, p.series_id, y - lag(y) OVER (PARTITION BY fold, p.series_id ORDER BY pos) AS d"
    " FROM panel p JOIN folds f ON p.series_id = f.series_id AND pos < train_end) GROUP BY 1, 2)"
    " SELECT f.fold, f.series_id, round(avg(abs(y - p)), 2) AS mae, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse,"
    " round(avg(abs(y - p)) / max(s), 6) AS mase FROM panel t JOIN folds f ON t.series_id = f.series_id AND pos >= test_start AND pos < test_end"
    " JOIN lv ON lv.fold = f.fold AND lv.series_id = f.series_id JOIN sc ON sc.fold = f.fold AND sc.series_id = f.series_id GROUP BY 1, 2",
)
def f12_fold_metrics(spark, sf):
    keys = ["fold", "series_id"]
    rows = folds.fold_rows(pn.orders_daily(spark, sf), 14)
    history = folds.fold_history(rows)
    fcst = fc.last_value(history, 14, keys).withColumnRenamed("mean", "p")
    pairs = mt.match_forecasts(folds.fold_actuals(rows), fcst, keys)
    out = mt.evaluate(pairs, ["mae", "rmse", "mase"], keys, mt.naive_scale(history, keys=keys))
    return out.select(*keys, F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mase", 6).alias("mase"))
