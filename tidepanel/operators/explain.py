"""Explanations and narratives of forecasts and analyses, one row per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.operators import analysis as an, attribution as at, decompose as dc, trust as tr


def band_edges(quantiles: str = "quantiles") -> tuple[Column, Column]:
    """Values of the lowest and highest level of a {level: value} map; NULL with fewer than two levels."""
    e = F.array_sort(F.transform(F.map_entries(quantiles), lambda x: F.named_struct(F.lit("q"), x.key.try_cast("double"), F.lit("v"), x.value)))
    two = F.size(e) >= 2
    return F.when(two, F.element_at(e, 1)["v"]), F.when(two, F.element_at(e, -1)["v"])


def forecast_facts(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """Everything the explanations need per series: ends, means, spreads, monotonicity, history moments."""
    low, high = band_edges()
    by_step = Window.partitionBy("series_id").orderBy("step")  # one row per step
    f = forecast.withColumns({"_spread": F.abs(high - low), "_prev": F.lag("mean", 1).over(by_step)})
    fc = f.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("horizon"),
        F.min_by("mean", "step").alias("first"),
        F.max_by("mean", "step").alias("last"),
        F.avg("mean").alias("fc_mean"),
        F.avg(F.abs("mean")).alias("fc_abs"),
        F.stddev_pop("mean").alias("fc_sd"),
        F.min("mean").alias("fc_min"),
        F.min(F.col("mean") - F.col("_prev")).alias("step_lo"),
        F.max(F.col("mean") - F.col("_prev")).alias("step_hi"),
        F.avg("_spread").alias("spread"),
        F.min_by("_spread", "step").alias("spread_first"),
        F.max_by("_spread", "step").alias("spread_last"),
    )
    h = history.groupBy("series_id").agg(
        F.avg("y").alias("h_mean"), F.stddev_pop("y").alias("h_sd"), F.min("y").alias("h_min"), F.count("y").alias("h_n")
    )
    return fc.join(h, "series_id")


def direction() -> Column:
    """up / down / flat of the forecast ends, with a tolerance of 1 % of the first value."""
    delta, tol = F.col("last") - F.col("first"), F.greatest(F.abs("first") * 0.01, F.lit(1e-6))
    return F.when(delta > tol, "up").when(delta < -tol, "down").otherwise("flat")


def _graded(r: Column, high: str, mid: str, low: str, none: str) -> Column:
    return F.when(r.isNull(), none).when(r < 0.2, high).when(r < 0.5, mid).otherwise(low)


def spread_ratio() -> Column:
    """Mean band width over the mean absolute forecast (1 if that is 0)."""
    return F.col("spread") / F.when(F.col("fc_abs") > 0, F.col("fc_abs")).otherwise(1.0)


def explain_forecast(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """(series_id, direction, confidence, comparison, patterns)."""
    delta = F.col("fc_mean") - F.col("h_mean")
    pct = delta / F.abs("h_mean") * 100
    side = lambda word: F.concat(F.lit(f"forecast mean is {word} historical mean"))
    compare = (
        F.when(F.col("h_mean") == 0, F.when(delta > 0, side("above")).when(delta < 0, side("below")).otherwise(side("aligned with")))
        .when(F.abs(pct) < 2, side("close to"))
        .when(pct > 0, F.format_string("forecast mean is %.1f%% above historical mean", F.abs(pct)))
        .otherwise(F.format_string("forecast mean is %.1f%% below historical mean", F.abs(pct)))
    )
    d = F.col("direction")
    many = F.col("horizon") >= 2
    wide = many & (F.col("spread_first") > 0)
    patterns = F.array_compact(
        F.array(
            F.when(d == "up", "mean forecast shows an upward trajectory").when(d == "down", "mean forecast shows a downward trajectory").otherwise("mean forecast is relatively flat"),
            F.when(many & (F.col("step_lo") >= 0), "forecast is monotonic increasing").when(many & (F.col("step_hi") <= 0), "forecast is monotonic decreasing"),
            F.when((F.col("h_min") >= 0) & (F.col("fc_min") < 0), "forecast crosses below zero while history is non-negative"),
            F.when(wide & (F.col("spread_last") > F.col("spread_first") * 1.2), "uncertainty widens over the forecast horizon").when(
                wide & (F.col("spread_last") < F.col("spread_first") * 0.8), "uncertainty narrows over the forecast horizon"
            ),
        )
    )
    confidence = _graded(
        spread_ratio(), "high confidence (tight quantile spread)", "moderate confidence (medium quantile spread)", "low confidence (wide quantile spread)", "quantile uncertainty unavailable"
    )
    facts = forecast_facts(forecast, history).withColumn("direction", direction())
    return facts.select("series_id", "direction", confidence.alias("confidence"), compare.alias("comparison"), patterns.alias("patterns"))


def forecast_narrative(forecast: DataFrame, history: DataFrame, model: str) -> DataFrame:
    """Trend strength, confidence, seasonality, anomalies, change against history and a key insight."""
    marks = an.anomalies(history).groupBy("series_id").agg(F.count(F.lit(1)).alias("anomalies"))
    season = an.seasonality(history, top_k=1).select("series_id", F.get("periods", 0).alias("_p"))
    f = forecast_facts(forecast, history).join(season, "series_id", "left").join(marks, "series_id", "left")
    strength = F.least(F.abs(F.col("last") - F.col("first")) / F.greatest(F.abs("first"), F.lit(1.0)), F.lit(1.0))
    ratio_ = F.col("spread") / F.greatest("fc_abs", F.lit(1.0))
    pct = F.when(F.abs("h_mean") > 1e-9, (F.col("fc_mean") - F.col("h_mean")) / F.abs("h_mean") * 100)
    change = F.col("fc_sd") / F.col("h_sd")
    vol = (
        F.when(F.col("h_sd") <= 1e-9, F.when(F.col("fc_sd") <= 1e-9, "stable").otherwise("higher"))
        .when(change > 1.15, "higher").when(change < 0.85, "lower").otherwise("stable")
    )
    f = f.withColumns(
        {
            "direction": F.when(F.col("horizon") < 2, "flat").otherwise(direction()),
            "strength": F.when(F.col("horizon") < 2, 0.0).otherwise(strength),
            "spread_ratio": ratio_,
            "level": _graded(ratio_, "high", "medium", "low", "unknown"),
            "period": F.when(F.col("h_n") >= 6, F.col("_p")),
            "anomalies": F.coalesce("anomalies", F.lit(0)),
            "mean_delta_pct": pct,
            "volatility_change": vol,
        }
    )
    hint = (
        F.when(F.col("mean_delta_pct").isNull(), F.lit("stable against zero-centered history"))
        .when(F.abs("mean_delta_pct") < 2, F.lit("close to historical mean"))
        .when(F.col("mean_delta_pct") > 0, F.format_string("%.1f%% above historical mean", F.abs("mean_delta_pct")))
        .otherwise(F.format_string("%.1f%% below historical mean", F.abs("mean_delta_pct")))
    )
    insight = F.format_string("Trend is %s with %s confidence; forecast mean is %s.", F.col("direction"), F.col("level"), hint)
    summary = F.format_string(f"%d-step forecast narrative for series '%s' using model '{model}'", F.col("horizon"), F.col("series_id"))
    return f.select(
        "series_id", summary.alias("summary"), "direction", "strength", "level", "spread_ratio", "period", "anomalies", "mean_delta_pct", "volatility_change", insight.alias("key_insight")
    )


def analysis_narrative(analysis: DataFrame) -> DataFrame:
    """(series_id, summary, period, risks) of `analyze` rows; at most two warnings count as risks."""
    risks = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("anomalies") > 0, F.lit("anomalies_detected")),
                F.when(~F.col("stationary"), F.lit("non_stationary")),
                F.when(F.col("quality") < 0.7, F.lit("low_data_quality")),
            )
        ),
        F.slice("warnings", 1, 2),
    )
    summary = F.format_string("Series '%s' shows %s trend, %d anomalies, and data quality %.2f", F.col("series_id"), F.col("direction"), F.col("anomalies"), F.col("quality"))
    return analysis.select("series_id", summary.alias("summary"), F.get("periods", 0).alias("period"), risks.alias("risks"))


def overall_narrative(analysis: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: series analysed, most frequently chosen model, anomalies found."""
    a = analysis.agg(F.count(F.lit(1)).alias("series"), F.sum("anomalies").alias("anomalies"))
    c = chosen.groupBy("model").agg(F.count(F.lit(1)).alias("k")).agg(F.min_by("model", F.struct(-F.col("k"), "model")).alias("model"))
    one = a.withColumn("_j", F.lit(1)).join(c.withColumn("_j", F.lit(1)), "_j").drop("_j")
    text = F.format_string("Composite report selected model '%s' with %d detected anomalies across %d analyzed series.", F.col("model"), F.col("anomalies"), F.col("series"))
    return one.select("series", "anomalies", "model", text.alias("summary"))


def decision_rows(forecast: DataFrame, history: DataFrame, confidence: float | None = None, threshold: float | None = None, auto_execute: bool = False) -> DataFrame:
    """Per series: direction, confidence level, history shares, evidence numbers and the policy verdict."""
    shares = at.history_shares(history, forecast)
    f = forecast_facts(forecast, history).withColumn("direction", direction()).join(shares, "series_id")
    level = _graded(spread_ratio(), "high", "medium", "low", "unknown")
    if confidence is not None and threshold is not None:
        run = auto_execute and confidence >= threshold
        reason = f"confidence {confidence:.2f} {'>=' if confidence >= threshold else '<'} threshold {threshold:.2f}"
    elif auto_execute:
        run, reason = True, "policy explicitly requested auto execution without a numeric threshold"
    else:
        run, reason = False, "policy requested manual review"
    return f.select(
        "series_id", "direction", level.alias("confidence_level"), "trend", "seasonal", "residual", "dominant_driver", F.col("h_n").alias("history_points"), "horizon",
        F.col("h_mean").alias("historical_mean"), F.col("fc_mean").alias("forecast_mean"), spread_ratio().alias("spread_ratio"), F.lit(run).alias("auto_executed"), F.lit(reason).alias("reason"),
    )


def input_signals(covariates: DataFrame) -> DataFrame:
    """Distinct signal names a request uses, with the series itself as `internal_ts`."""
    names = covariates.select(F.col("name").alias("signal")).distinct()
    return names.unionByName(covariates.select(F.lit("internal_ts").alias("signal")).distinct())


def rank_models(
    metrics: DataFrame, primary: str = "mse", secondary: Sequence[str] = ("mae", "rmse", "mape"), higher_is_better: Sequence[str] = ("r2", "coverage")
) -> DataFrame:
    """(model, rank, value, margin, strengths, weaknesses) from (model, metric, value).

    Strength: best of its peers in a metric; weakness: worst in a secondary one. The margin is the
    distance to the next model.
    """
    sign = F.when(F.col("metric").isin(*higher_is_better), -1.0).otherwise(1.0) if higher_is_better else F.lit(1.0)
    peers = Window.partitionBy("metric")  # one row per model
    m = metrics.where(F.col("metric").isin(primary, *secondary)).withColumn("_s", F.col("value") * sign)
    m = m.withColumns({"_best": F.min("_s").over(peers), "_worst": F.max("_s").over(peers), "_n": F.count(F.lit(1)).over(peers)})
    label = lambda word: F.format_string(f"{word} %s (%.4f)", F.col("metric"), F.col("value"))
    per = m.groupBy("model").agg(
        F.max(F.when(F.col("metric") == primary, F.col("value"))).alias("value"),
        F.array_sort(F.collect_list(F.when(F.col("_s") == F.col("_best"), label("Best")))).alias("strengths"),
        F.array_sort(
            F.collect_list(F.when((F.col("_s") == F.col("_worst")) & (F.col("_n") > 1) & (F.col("metric") != primary), label("Worst")))
        ).alias("weaknesses"),
    )
    key = F.coalesce(-F.col("value") if primary in higher_is_better else F.col("value"), F.lit(float("inf")))
    order = Window.partitionBy().orderBy(key, "model")
    return per.withColumns({"rank": F.row_number().over(order), "margin": F.abs(F.col("value") - F.lead("value").over(order))})


def selection_text(ranked: DataFrame, primary: str, splits: int | None = None, strategy: str = "expanding-window") -> DataFrame:
    """One row: the winner and why."""
    w = Window.partitionBy().orderBy("rank")
    r = ranked.withColumns({"_next": F.lead("model").over(w), "_nv": F.lead("value").over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    text = F.format_string(
        f"%s selected: lowest {primary} (%.4f) across %d models evaluated with {strategy} cross-validation" + (f" ({splits} splits)" if splits else ""),
        F.col("model"), F.col("value"), F.col("_n"),
    )
    more = F.format_string(". Runner-up: %s (%.4f, margin: %.4f)", F.col("_next"), F.col("_nv"), F.col("margin"))
    return r.where("rank = 1").select("model", F.when(F.col("_next").isNull(), text).otherwise(F.concat(text, more)).alias("rationale"))


def metric_matrix(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per model, one column per metric."""
    return metrics.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))


def explain_decisions(
    decisions: DataFrame, trust: DataFrame, panel: DataFrame, model_metrics: DataFrame, period: int, primary: str = "mae", **policy
) -> DataFrame:
    """End-to-end rows per series: input trust, chosen model, variance shares, strongest lag, gated policy.

    `decisions` (series_id, confidence, forecast_value), `trust` results with item_id = series_id.
    """
    best = rank_models(model_metrics, primary).where("rank = 1").select(F.col("model").alias("model_selected"))
    shares = dc.strengths(dc.moving_average(panel, period)).select("series_id", "trend_share", "seasonal_share", "residual_share", F.col("dominant").alias("dominant_driver"))
    lags = at.top_lags(at.lag_correlation(panel), 1).select("series_id", F.col("lag").alias("top_lag"))
    t = trust.withColumnRenamed("item_id", "series_id").select("series_id", "trust_score", "risk_category", "violations")
    verdict = tr.decide(decisions.join(t, "series_id", "left"), **policy)
    out = verdict.join(shares, "series_id", "left").join(lags, "series_id", "left")
    return out.withColumn("_j", F.lit(1)).join(F.broadcast(best.withColumn("_j", F.lit(1))), "_j").drop("_j")  # one row
