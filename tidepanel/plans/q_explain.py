"""Explanations, narratives and reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import analysis as an, explain as ex, folds, forecast as fc, trust as tr
from tidepanel.plans import panels as pn
from tidepanel.plans.catalog import query
from tidepanel.plans.q_accuracy import HOLD, SCALE_SQL, Z10
from tidepanel.plans.q_analysis import ANALYSIS, IQR, LAGC, SHARES
from tidepanel.plans.q_prep import MA7
from tidepanel.plans.q_selection import BENCH, _bench
from tidepanel.plans.q_trust import _scores_sql, payload
from tidepanel.functions.registry import Model
from tidepanel.plans.report import forecast_report
from tidepanel.session import table

# Trend forecasts of the daily event means with fallback bands, and the facts about them.
FACTS = (
    HOLD + SCALE_SQL + ", lf AS (SELECT series_id, max(n) - 7 AS n, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM hist GROUP BY 1),"
    f" fq AS (SELECT lf.series_id, step, my + b * (n - 1 + step - mx) AS mean, 2 * {Z10} * s * sqrt(step) AS spread FROM lf JOIN scale USING (series_id), range(1, 8) AS r(step)),"
    " ff AS (SELECT series_id, count(*) AS horizon, arg_min(mean, step) AS f0, arg_max(mean, step) AS f1, avg(mean) AS fm, avg(abs(mean)) AS fa, stddev_pop(mean) AS fsd, min(mean) AS fmin, avg(spread) AS sp FROM fq GROUP BY 1),"
    " hh AS (SELECT series_id, avg(y) AS hm, stddev_pop(y) AS hsd, min(y) AS hmin, count(y) AS hn FROM hist GROUP BY 1),"
    " fa AS (SELECT *, CASE WHEN f1 - f0 > greatest(abs(f0) * 0.01, 1e-6) THEN 'up' WHEN f1 - f0 < -greatest(abs(f0) * 0.01, 1e-6) THEN 'down' ELSE 'flat' END AS dir, sp / CASE WHEN fa > 0 THEN fa ELSE 1 END AS sr, (fm - hm) / abs(hm) * 100 AS pct FROM ff JOIN hh USING (series_id))"
)


def fitted(spark, sf):
    history, _ = folds.holdout(pn.events_daily(spark, sf), 7)
    return history, fc.forecast(history, "linear_trend", 7, quantiles=[0.1, 0.9])


@query("c25_quantile_band_edges", FACTS + " SELECT series_id, CAST(step AS INTEGER) AS step, round(mean - spread / 2, 6) AS low, round(mean + spread / 2, 6) AS high FROM fq")
def c25_quantile_band_edges(spark, sf):
    _, f = fitted(spark, sf)
    low, high = ex.band_edges()
    return f.select("series_id", "step", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "f35_forecast_explanation",
    FACTS + " SELECT series_id, dir AS direction, CASE WHEN sr < 0.2 THEN 'high confidence (tight quantile spread)' WHEN sr < 0.5 THEN 'moderate confidence (medium quantile spread)' ELSE 'low confidence (wide quantile spread)' END AS confidence,"
    " CASE WHEN abs(pct) < 2 THEN 'forecast mean is close to historical mean' WHEN pct > 0 THEN printf('forecast mean is %.1f%% above historical mean', abs(pct)) ELSE printf('forecast mean is %.1f%% below historical mean', abs(pct)) END AS comparison,"
    " concat_ws('; ', CASE dir WHEN 'up' THEN 'mean forecast shows an upward trajectory' WHEN 'down' THEN 'mean forecast shows a downward trajectory' ELSE 'mean forecast is relatively flat' END, CASE WHEN f1 >= f0 THEN 'forecast is monotonic increasing' ELSE 'forecast is monotonic decreasing' END,"
    " CASE WHEN hmin >= 0 AND fmin < 0 THEN 'forecast crosses below zero while history is non-negative' END, 'uncertainty widens over the forecast horizon') AS patterns FROM fa",
)
def f35_forecast_explanation(spark, sf):
    history, f = fitted(spark, sf)
    return ex.explain_forecast(f, history).withColumn("patterns", F.array_join("patterns", "; "))


@query(
    "f36_forecast_narrative",
    FACTS + ", panel AS (SELECT series_id, ts, pos, n - 7 AS n, y FROM hist)" + IQR + ", ac AS (SELECT series_id, count(*) AS c FROM an WHERE x GROUP BY 1),"
    " nr AS (SELECT fa.*, least(abs(f1 - f0) / greatest(abs(f0), 1.0), 1.0) AS strength, sp / greatest(fa.fa, 1.0) AS nsr, coalesce(c, 0) AS anomalies, CASE WHEN fsd / hsd > 1.15 THEN 'higher' WHEN fsd / hsd < 0.85 THEN 'lower' ELSE 'stable' END AS vol FROM fa LEFT JOIN ac USING (series_id)),"
    " n2 AS (SELECT *, CASE WHEN nsr < 0.2 THEN 'high' WHEN nsr < 0.5 THEN 'medium' ELSE 'low' END AS lvl FROM nr)"
    " SELECT series_id, '7-step forecast narrative for series ''' || series_id || ''' using model ''linear_trend''' AS summary, dir AS direction, round(strength, 6) AS strength, lvl AS level, round(nsr, 6) AS spread_ratio, anomalies, round(pct, 6) AS mean_delta_pct, vol AS volatility_change,"
    " 'Trend is ' || dir || ' with ' || lvl || ' confidence; forecast mean is ' || CASE WHEN abs(pct) < 2 THEN 'close to historical mean' WHEN pct > 0 THEN printf('%.1f%% above historical mean', abs(pct)) ELSE printf('%.1f%% below historical mean', abs(pct)) END || '.' AS key_insight FROM n2",
)
def f36_forecast_narrative(spark, sf):
    history, f = fitted(spark, sf)
    n = ex.forecast_narrative(f, history, "linear_trend")
    return n.select("series_id", "summary", "direction", F.round("strength", 6).alias("strength"), "level", F.round("spread_ratio", 6).alias("spread_ratio"), "anomalies", F.round("mean_delta_pct", 6).alias("mean_delta_pct"), "volatility_change", "key_insight")


@query(
    "f37_analysis_narrative",
    ANALYSIS + " SELECT series_id, printf('Series ''%s'' shows %s trend, %d anomalies, and data quality %.2f', series_id, direction, anomalies, quality) AS summary, CAST(nullif(string_split(periods, ',')[1], '') AS DOUBLE) AS period,"
    " concat_ws('; ', CASE WHEN anomalies > 0 THEN 'anomalies_detected' END, CASE WHEN NOT stationary THEN 'non_stationary' END, CASE WHEN quality < 0.7 THEN 'low_data_quality' END) AS risks FROM ana",
)
def f37_analysis_narrative(spark, sf):
    return _narrative_of(an.analyze(pn.ship_monthly(spark, sf)))


def _narrative_of(analysis):
    n = ex.analysis_narrative(analysis)
    return n.select("series_id", "summary", F.col("period").cast("double").alias("period"), F.array_join("risks", "; ").alias("risks"))


@query("c05_narrative_text", ANALYSIS + " SELECT printf('Series ''%s'' shows %s trend, %d anomalies, and data quality %.2f', series_id, direction, anomalies, quality) AS summary FROM ana")
def c05_narrative_text(spark, sf):
    return ex.analysis_narrative(an.analyze(pn.ship_monthly(spark, sf))).select("summary")


# both installed models score the same, so the first by name is taken
@query(
    "f38_report",
    ANALYSIS + ", lt AS (SELECT series_id, max(n) AS n, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM panel GROUP BY 1)"
    " SELECT lt.series_id, 'linear_trend' AS model, CAST(step AS INTEGER) AS step, round(my + b * (lt.n - 1 + step - mx), 2) AS mean,"
    " printf('Series ''%s'' shows %s trend, %d anomalies, and data quality %.2f', lt.series_id, direction, anomalies, quality) AS summary FROM lt JOIN ana USING (series_id), range(1, 7) AS r(step)",
)
def f38_report(spark, sf):
    """Analysis, selection among two installed models, forecasts with fallback, summary line."""
    runners = {"seasonal_naive": lambda h, k: fc.seasonal_naive(h, k, 12), "linear_trend": fc.linear_trend}
    installed = [Model(name, "native", "apache-2.0") for name in runners]
    rep = forecast_report(pn.ship_monthly(spark, sf), 6, runners, installed)
    f = rep["forecast"].select("series_id", "model", "step", F.round("mean", 2).alias("mean"))
    return f.join(rep["narrative"].select("series_id", "summary"), "series_id")


@query(
    "f40_decision_rows",
    FACTS + SHARES + " SELECT fa.series_id, dir AS direction, CASE WHEN sr < 0.2 THEN 'high' WHEN sr < 0.5 THEN 'medium' ELSE 'low' END AS confidence_level, round(t / (t + s + r), 4) AS trend, round(r / (t + s + r), 4) AS residual, hn AS history_points, horizon,"
    " round(hm, 6) AS historical_mean, round(fm, 6) AS forecast_mean, round(sr, 6) AS spread_ratio, true AS auto_executed, 'confidence 0.90 >= threshold 0.80' AS reason FROM fa JOIN sh ON sh.series_id = fa.series_id",
)
def f40_decision_rows(spark, sf):
    history, f = fitted(spark, sf)
    d = ex.decision_rows(f, history, 0.9, 0.8, auto_execute=True)
    r = lambda c: F.round(c, 6).alias(c)
    return d.select("series_id", "direction", "confidence_level", "trend", "residual", "history_points", "horizon", r("historical_mean"), r("forecast_mean"), r("spread_ratio"), "auto_executed", "reason")


@query("f40_input_signals", "SELECT event_type AS signal FROM events GROUP BY 1 UNION SELECT 'internal_ts'")
def f40_input_signals(spark, sf):
    return ex.input_signals(table(spark, sf, "events").select(F.col("event_type").alias("name")))


RANKED = (
    BENCH + ", lm AS (SELECT model, 'mae' AS metric, mae AS v FROM ag UNION ALL SELECT model, 'rmse', rmse FROM ag UNION ALL SELECT model, 'mase', mase FROM ag),"
    " bw AS (SELECT *, v = min(v) OVER (PARTITION BY metric) AS best, v = max(v) OVER (PARTITION BY metric) AS worst FROM lm),"
    " rkm AS (SELECT model, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank, mae AS value, abs(mae - lead(mae) OVER (ORDER BY mae, model)) AS margin, lead(model) OVER (ORDER BY mae, model) AS nm, lead(mae) OVER (ORDER BY mae, model) AS nv FROM ag)"
)


@query(
    "f41_model_selection",
    RANKED + " SELECT r.model, rank, round(value, 2) AS value, round(margin, 2) AS margin, (SELECT count(*) FROM bw WHERE bw.model = r.model AND best) AS strengths, (SELECT count(*) FROM bw WHERE bw.model = r.model AND worst AND metric <> 'mae') AS weaknesses FROM rkm r",
)
def f41_model_selection(spark, sf):
    r = ex.rank_models(_bench(spark, sf)["aggregate"], "mae", ["rmse", "mase"])
    return r.select("model", "rank", F.round("value", 2).alias("value"), F.round("margin", 2).alias("margin"), F.size("strengths").cast("long").alias("strengths"), F.size("weaknesses").cast("long").alias("weaknesses"))


@query(
    "f41_selection_rationale",
    RANKED + " SELECT model, printf('%s selected: lowest mae (%.4f) across 3 models evaluated with expanding-window cross-validation (3 splits). Runner-up: %s (%.4f, margin: %.4f)', model, value, nm, nv, margin) AS rationale FROM rkm WHERE rank = 1",
)
def f41_selection_rationale(spark, sf):
    return ex.selection_text(ex.rank_models(_bench(spark, sf)["aggregate"], "mae", ["rmse", "mase"]), "mae", splits=3)


@query("f42_metric_matrix", BENCH + " SELECT model, round(mae, 2) AS mae, round(mase, 6) AS mase, round(rmse, 2) AS rmse FROM ag")
def f42_metric_matrix(spark, sf):
    m = ex.metric_matrix(_bench(spark, sf)["aggregate"], ["mae", "mase", "rmse"])
    return m.select("model", F.round("mae", 2).alias("mae"), F.round("mase", 6).alias("mase"), F.round("rmse", 2).alias("rmse"))


# Each event type is one decision; the customer payload numbered like the length of its name is its trust input.
F43 = (
    "WITH " + LAGC[5:] + ", " + _scores_sql("geopolitical") + ", " + MA7[5:].split("panel AS (SELECT * FROM orders_daily), ")[1].replace("panel", "panel")
)


@query(
    "f43_end_to_end_decisions",
    F43 + ", parts AS (SELECT *, y - trend - seasonal AS resid FROM m), vr AS (SELECT series_id, var_pop(trend) AS t, var_pop(seasonal) AS s, var_pop(resid) AS r FROM parts GROUP BY 1),"
    " tl AS (SELECT series_id, lag FROM lc QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY strength DESC, lag) = 1), k AS (SELECT series_id, length(series_id) AS k, arg_max(y, pos) AS fv FROM panel GROUP BY 1),"
    " ft AS (SELECT series_id, max(n) - 7 AS cut, arg_max(y, pos) AS lv, avg(y) AS my, avg(pos) AS mx, regr_slope(y, pos) AS b FROM panel WHERE pos < n - 7 GROUP BY 1),"
    " er AS (SELECT p.series_id, avg(abs(lv - y)) AS e1, avg(abs(my + b * (pos - mx) - y)) AS e2 FROM panel p JOIN ft USING (series_id) WHERE pos >= cut GROUP BY 1),"
    " ms AS (SELECT CASE WHEN avg(e1) <= avg(e2) THEN 'last_value' ELSE 'linear_trend' END AS model_selected FROM er)"
    " SELECT k.series_id, round(trust_score, 6) AS trust_score, risk_category, round(t / (t + s + r), 4) AS trend_share, round(s / (t + s + r), 4) AS seasonal_share, lag AS top_lag, model_selected, 0.9 >= 0.85 AND NOT (trust_score < 0.5 OR crit OR risk_category = 'RED') AS auto_executed"
    " FROM k JOIN geopolitical_r g ON g.item_id = CAST(k.k AS VARCHAR) JOIN vr ON vr.series_id = k.series_id JOIN tl ON tl.series_id = k.series_id, ms",
)
def f43_end_to_end_decisions(spark, sf):
    panel = pn.events_daily(spark, sf)
    k = panel.groupBy("series_id").agg(F.max_by("y", "pos").alias("forecast_value")).withColumn("k", F.length("series_id").cast("string"))
    trust = tr.score(payload(spark, sf, "geopolitical"), "geopolitical").join(k.select(F.col("k").alias("item_id"), "series_id"), "item_id").drop("item_id").withColumnRenamed("series_id", "item_id")
    before, actuals = folds.holdout(panel, 7)
    metrics = None
    for model in ("last_value", "linear_trend"):
        pairs = fc.forecast(before, model, 7).join(actuals, ["series_id", "step"])
        one = pairs.groupBy(F.lit(model).alias("model"), "series_id").agg(F.avg(F.abs(F.col("mean") - F.col("a"))).alias("v"))
        one = one.groupBy("model", F.lit("mae").alias("metric")).agg(F.avg("v").alias("value"))
        metrics = one if metrics is None else metrics.unionByName(one)
    d = ex.explain_decisions(k.select("series_id", "forecast_value", F.lit(0.9).alias("confidence")), trust, panel, metrics, 7)
    return d.select("series_id", F.round("trust_score", 6).alias("trust_score"), "risk_category", "trend_share", "seasonal_share", "top_lag", "model_selected", "auto_executed")
