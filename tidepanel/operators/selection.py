"""Per-series model recommendation and automatic selection: profile x capability table.

The capability table is a short list of rows, spread over each profile as a literal; profiles are one
row per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.registry import ACCURACY, COLUMNS, LEARNED_SCALE, MODELS, SPEED

def series_profile(panel: DataFrame, covariates: DataFrame | None = None, freq: DataFrame | None = None) -> DataFrame:
    """(series_id, points, freq, has_past, has_future, has_static, kind) per series.

    `covariates` is long: (series_id, role in past/future/static, name, num, cat).
    """
    base = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("points"))
    if freq is not None:
        base = base.join(freq.select("series_id", F.col("frequency").alias("freq")), "series_id", "left")
    else:
        base = base.withColumn("freq", F.lit("auto"))
    if covariates is None:
        return base.select(
            "*", F.lit(False).alias("has_past"), F.lit(False).alias("has_future"), F.lit(False).alias("has_static"), F.lit("numeric").alias("kind")
        )
    cov = covariates.groupBy("series_id").agg(
        F.bool_or(F.col("role") == "past").alias("has_past"),
        F.bool_or(F.col("role") == "future").alias("has_future"),
        F.bool_or(F.col("role") == "static").alias("has_static"),
        F.max(F.when((F.col("role") != "static") & F.col("cat").isNotNull(), 1).otherwise(0)).alias("_c"),
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return base.join(cov, "series_id", "left").select(
        "series_id", "points", "freq", flag("has_past"), flag("has_future"), flag("has_static"),
        F.when(F.col("_c") == 1, "categorical").otherwise("numeric").alias("kind"),
    )


def dataset_profile(profiles: DataFrame) -> DataFrame:
    """One row: series count, points, mean length, covariate flags, frequency if all explicit ones agree."""
    explicit = F.when(F.lower("freq") != "auto", F.col("freq"))
    return profiles.agg(
        F.count(F.lit(1)).alias("series_count"),
        F.sum("points").alias("history_points"),
        F.avg("points").alias("average_history_length"),
        F.bool_or("has_past").alias("has_past"),
        F.bool_or("has_future").alias("has_future"),
        F.bool_or("has_static").alias("has_static"),
        F.max("kind").alias("_hi"),
        F.min("kind").alias("_lo"),
        F.min(explicit).alias("_a"),
        F.max(explicit).alias("_b"),
    ).select(
        "series_count", "history_points", "average_history_length", "has_past", "has_future", "has_static",
        F.when((F.col("_hi") == "categorical") | (F.col("_lo") == "categorical"), "categorical").otherwise("numeric").alias("kind"),
        F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("auto").alias("freq_hint"),
    )


def _pairs(profiles: DataFrame, models: Sequence[tuple]) -> DataFrame:
    """Every profile with every model of the list."""
    types = [c.strip().split() for c in COLUMNS.split(",")]
    entry = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(m, types)]) for m in models]
    return profiles.select("*", F.inline(F.array(*entry)))


def _supports(prefix: str) -> Column:
    return F.when(F.col("kind") == "numeric", F.col(f"{prefix}_num")).otherwise(F.col(f"{prefix}_cat"))


def recommend(profiles: DataFrame, models: Sequence[tuple] = MODELS, horizon: int = 1, allow_restricted: bool = False) -> DataFrame:
    """(series_id, model, family, score, reasons, rank): excluded models have reasons and no rank."""
    restricted = F.col("needs_acceptance") | F.lower("license").contains("-nc")
    limit = F.col("max_horizon")
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("forecast_ready"), F.lit("forecast_not_ready")),
            F.when(restricted & F.lit(not allow_restricted), F.lit("restricted_license")),
            F.when(F.col("has_past") & ~_supports("past"), F.concat(F.lit("missing_past_covariates_"), "kind")),
            F.when(F.col("has_future") & ~_supports("fut"), F.concat(F.lit("missing_future_covariates_"), "kind")),
            F.when(F.col("has_static") & ~F.col("static"), F.lit("missing_static_covariates")),
            F.when(limit < horizon, F.concat(F.lit("horizon_exceeds_limit:"), limit.cast("string"))),
        )
    )
    near = (limit - horizon) <= F.greatest(F.lit(5), F.floor(limit / 10))
    score = (
        F.lit(100)
        + F.when(F.col("has_past"), 10).otherwise(0)
        + F.when(F.col("has_future"), 15).otherwise(0)
        + F.when(F.col("has_static"), 10).otherwise(0)
        + F.when(limit.isNull(), 4).when(near, 12).otherwise(8)
        + F.when(F.col("freq").isNotNull() & (F.lower("freq") != "auto"), 1).otherwise(0)
        + F.when(F.col("needs_acceptance"), -2).otherwise(0)
        + F.when(F.col("family") == "mock", -25).otherwise(0)
    )
    out = _pairs(profiles, models).withColumns({"reasons": reasons, "score": score})
    ok = F.size("reasons") == 0
    w = Window.partitionBy("series_id", ok).orderBy(F.col("score").desc(), F.col("name"))
    return out.withColumns({"rank": F.when(ok, F.row_number().over(w)), "model": F.col("name")}).withColumn(
        "score", F.when(ok, F.col("score"))
    )


def top_models(recommended: DataFrame, k: int = 3) -> DataFrame:
    return recommended.where(F.col("rank") <= k)


def _bonus(table: dict[str, float]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[F.col("family")], F.lit(0.0))


def auto_rank(
    profiles: DataFrame,
    models: Sequence[tuple] = MODELS,
    horizon: int = 1,
    strategy: str = "auto",
    series_count: int = 1,
    weights: DataFrame | None = None,
    allow_restricted: bool = False,
) -> DataFrame:
    """Compatible models per series by score with strategy and profile bonuses; best first in `rank`.

    `weights` (model, weight) replace the family accuracy bonus where a model has one.
    """
    base = recommend(profiles, models, horizon, allow_restricted).where(F.col("rank").isNotNull()).drop("rank")
    if weights is not None:
        base = base.join(weights.select("model", "weight"), "model", "left")
    else:
        base = base.withColumn("weight", F.lit(None).cast("double"))
    fam, limit = F.col("family"), F.col("max_horizon")
    use = F.lit(float(horizon)) / limit
    short = F.col("points") <= 64
    tight, roomy = F.coalesce(use >= 0.85, F.lit(False)), F.coalesce(use <= 0.35, F.lit(False))
    add = lambda cond, v: F.when(cond, F.lit(v)).otherwise(0.0)
    accuracy = (
        add(short & fam.isin("timesfm", "torch"), 3.0)
        + add(tight, -4.0)
        + add(roomy, 2.0)
        + add(F.col("has_future") & fam.isin("timesfm", "torch", "uni2ts"), 2.0)
    )
    speed = (
        add(short & (fam == "mock"), 2.0)
        + add(tight, -2.0)
        + add(roomy, 1.0)
        + add(F.lit(series_count >= 4) & fam.isin("timesfm", "sundial", "toto"), 2.0)
    )
    acc_bonus = F.coalesce(F.col("weight") * LEARNED_SCALE, _bonus(ACCURACY))
    total = {
        "fastest": _bonus(SPEED) + speed,
        "best_accuracy": acc_bonus + accuracy,
        "ensemble": 0.75 * acc_bonus + 0.25 * _bonus(SPEED) + accuracy,
        "auto": 0.55 * acc_bonus + 0.45 * _bonus(SPEED) + 0.6 * accuracy + 0.4 * speed,
    }[strategy]
    scored = base.withColumn("score", F.round(F.col("score") + total, 4))
    w = Window.partitionBy("series_id").orderBy(F.col("score").desc(), F.col("model"))
    return scored.withColumn("rank", F.row_number().over(w))


def chosen(ranked: DataFrame, strategy: str = "auto", ensemble_top_k: int = 3) -> DataFrame:
    """The selected model(s): one, or min(max(k, 2), available) for an ensemble."""
    k = max(ensemble_top_k, 2) if strategy == "ensemble" else 1
    return ranked.where(F.col("rank") <= k)


def two_stages(profiles: DataFrame, models: Sequence[tuple] = MODELS, horizon: int = 1, **kw) -> DataFrame:
    """Fastest model first, then the most accurate one where it differs: (series_id, stage, strategy, model)."""
    fast = chosen(auto_rank(profiles, models, horizon, "fastest", **kw)).select("series_id", F.col("model").alias("fast"))
    best = chosen(auto_rank(profiles, models, horizon, "best_accuracy", **kw)).select("series_id", F.col("model").alias("best"))
    both = fast.join(best, "series_id")
    plan = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("stage"), F.lit("fastest").alias("strategy"), F.col("fast").alias("model")),
            F.when(
                F.col("best") != F.col("fast"),
                F.struct(F.lit(2).alias("stage"), F.lit("best_accuracy").alias("strategy"), F.col("best").alias("model")),
            ),
        )
    )
    return both.select("series_id", F.explode(plan).alias("p")).select("series_id", "p.*")


def forecast_with_fallback(history: DataFrame, candidates: DataFrame, runners: dict, horizon: int, ranks: Sequence[int]) -> DataFrame:
    """Forecast every series by its best-ranked candidate that works.

    One round per rank, each over the series still without a result; `runners` maps model name to
    a function (history, horizon) -> (series_id, step, mean). A series for which all candidates fail, or which has
    none, gets one row with `error` and no model, rank, step or mean.
    """
    from tidepanel.session import cut_lineage

    spark = history.sparkSession
    done, open_series = None, history.select("series_id").distinct()
    for r in ranks:
        turn = candidates.where(F.col("rank") == r).join(open_series, "series_id", "left_semi").select("series_id", "model")
        out = None
        for name, run in runners.items():
            mine = history.join(turn.where(F.col("model") == name), "series_id", "left_semi")
            got = run(mine, horizon).where(F.col("mean").isNotNull()).select(
                F.lit(name).alias("model"), F.lit(r).alias("rank"), "series_id", "step", "mean", F.lit(None).cast("string").alias("error")
            )
            out = got if out is None else out.unionByName(got)
        out = cut_lineage(spark, out, f"fallback-{r}")
        done = out if done is None else done.unionByName(out)
        open_series = open_series.join(out.select("series_id").distinct(), "series_id", "left_anti")
    tried = candidates.where(F.col("rank").isin(*ranks)).groupBy("series_id").agg(F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("tried"))
    failed = open_series.join(tried, "series_id", "left").withColumn("error", F.concat(F.lit("no forecast, tried: "), F.coalesce("tried", F.lit("nothing"))))
    return done.unionByName(failed.select("series_id", "error"), allowMissingColumns=True)


def candidate_chain(history: DataFrame, ranked: DataFrame, lane: str | None = None, explicit: str | None = None) -> DataFrame:
    """(series_id, rank, model, stage): the model of the routing lane, then the one asked for, then the ranked ones; a model that
    comes twice keeps its first place."""
    series = history.select("series_id").distinct()
    first = [F.struct(F.lit(k).alias("at"), F.lit(m).alias("model"), F.lit(stage).alias("stage")) for k, (m, stage) in enumerate(((lane, "lane"), (explicit, "explicit")), -2) if m]
    chain = ranked.select("series_id", F.struct(F.col("rank").cast("int").alias("at"), "model", F.lit("ranked").alias("stage")).alias("c"))
    if first:
        chain = series.select("series_id", F.explode(F.array(*first)).alias("c")).unionByName(chain.join(series, "series_id", "left_semi"))
    own = chain.groupBy("series_id", "c.model").agg(F.min("c").alias("c"))
    turn = F.row_number().over(Window.partitionBy("series_id").orderBy("c.at", "c.model"))
    return own.select("series_id", turn.alias("rank"), "c.model", "c.stage")


def auto_forecast(
    history: DataFrame, ranked: DataFrame, runners: dict, horizon: int, lane: str | None = None, explicit: str | None = None, allow_fallback: bool = True
) -> dict[str, DataFrame]:
    """`forecast` (series_id, model, stage, rank, step, mean) and `attempts` (series_id, rank, stage, model, outcome, reason).

    Every series goes down its chain (candidate_chain) until a model answers; without `allow_fallback` only the first is asked.
    `runners` maps model names to functions (history, horizon) -> (series_id, step, mean[, error]). A model without a runner is
    an attempt that failed as well. Rounds are written, so that none is repeated.
    """
    from tidepanel.session import cut_lineage

    spark = history.sparkSession
    chain = cut_lineage(spark, candidate_chain(history, ranked, lane, explicit), "chain")
    last = chain.agg(F.max("rank")).first()[0] or 0
    open_series = history.select("series_id").distinct()
    forecast, attempts = None, None
    for r in range(1, (last if allow_fallback else min(last, 1)) + 1):
        turn = chain.where(F.col("rank") == r).join(open_series, "series_id", "left_semi")
        got = None
        for name, run in runners.items():
            mine = history.join(turn.where(F.col("model") == name).select("series_id"), "series_id", "left_semi")
            one = run(mine, horizon)
            error = F.col("error") if "error" in one.columns else F.lit(None).cast("string")
            one = one.select("series_id", "step", "mean", error.alias("error"))
            got = one if got is None else got.unionByName(one)
        if got is None:
            break
        got = cut_lineage(spark, got.join(turn, "series_id"), f"auto-{r}")
        answered = got.where(F.col("mean").isNotNull())
        per = got.groupBy("series_id").agg(F.count("mean").alias("points"), F.max("error").alias("error"))
        reason = (
            F.when(F.coalesce("points", F.lit(0)) > 0, F.lit(None).cast("string"))
            .when(~F.col("model").isin(*runners), F.lit("model is not available"))
            .otherwise(F.coalesce("error", F.lit("no forecast")))
        )
        tried = turn.join(per, "series_id", "left").select("series_id", "rank", "stage", "model", F.when(reason.isNull(), "ok").otherwise("failed").alias("outcome"), reason.alias("reason"))
        tried = cut_lineage(spark, tried, f"attempts-{r}")
        answered = answered.select("series_id", "model", "stage", "rank", "step", "mean")
        forecast = answered if forecast is None else forecast.unionByName(answered)
        attempts = tried if attempts is None else attempts.unionByName(tried)
        open_series = open_series.join(tried.where("outcome = 'ok'").select("series_id"), "series_id", "left_anti")
        if open_series.isEmpty():
            break
    if forecast is None:
        forecast = spark.createDataFrame([], "series_id string, model string, stage string, rank int, step int, mean double")
        attempts = spark.createDataFrame([], "series_id string, rank int, stage string, model string, outcome string, reason string")
    return {"forecast": forecast, "attempts": attempts}
