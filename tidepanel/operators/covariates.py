"""Covariates in long form: (series_id, role in past/future/static, name, ts or step, num, cat)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.registry import COLUMNS, MODELS
from tidepanel.operators.clean import add_steps

# Which covariates each model takes: all, numeric past and future, numeric past only, or none (fixed values).
POLICY = {
    "chronos2": "all",
    "granite-ttm-r2": "numeric",
    "timesfm-2.5-200m": "numeric",
    "moirai-2.0-R-small": "numeric",
    "nhits": "numeric",
    "nbeatsx": "numeric",
    "toto-open-base-1.0": "past_numeric",
    "sundial-base-128m": "none",
}


def kinds(cov: DataFrame) -> DataFrame:
    """(series_id, role, name, rows, kind): numeric, categorical, or a problem (`mixed`, `empty`)."""
    num, cat = F.count("num"), F.count("cat")
    kind = F.when((num > 0) & (cat > 0), "mixed").when(num > 0, "numeric").when(cat > 0, "categorical").otherwise("empty")
    return cov.groupBy("series_id", "role", "name").agg(F.count(F.lit(1)).alias("rows"), kind.alias("kind"))


def _paired(cov: DataFrame) -> DataFrame:
    """One row per (series_id, name) with the kinds and lengths of its past and future part."""
    k = kinds(cov.where("role in ('past', 'future')"))
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")
    return k.groupBy("series_id", "name").agg(*[pick(r, c) for r in ("past", "future") for c in ("kind", "rows")])


def covariate_violations(cov: DataFrame, lengths: DataFrame, horizon: int) -> DataFrame:
    """(series_id, name, problem): lengths, future-only names, differing or unusable kinds.

    `lengths` is (series_id, n).
    """
    p = _paired(cov).join(lengths, "series_id")
    problem = (
        F.when(F.col("past_kind").isin("mixed", "empty") | F.col("future_kind").isin("mixed", "empty"), "values must be all numeric or all text")
        .when(F.col("past_kind").isNull(), "missing in past covariates")
        .when(F.col("past_rows") != F.col("n"), "past length differs from target length")
        .when(F.col("future_rows") != horizon, "future length differs from horizon")
        .when(F.col("past_kind") != F.col("future_kind"), "kind differs between past and future")
    )
    return p.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("series_id", "name", "problem")


def request_violations(requests: DataFrame, horizon: int, quantiles: Sequence[float] = (), need_actuals: bool = False) -> DataFrame:
    """(series_id, problem) of array-form requests (series_id, timestamps, target, actuals)."""
    if list(quantiles) != sorted(quantiles) or len(set(quantiles)) != len(quantiles):
        raise ValueError("quantiles must be sorted and unique")
    actual = F.when(F.col("actuals").isNull(), "actuals are required").when(F.size("actuals") != horizon, "actuals length must match horizon")
    lengths = F.when(F.size("timestamps") != F.size("target"), "target length must match timestamps length")
    probs = F.array_compact(F.array(lengths, actual if need_actuals else F.lit(None).cast("string")))
    each = requests.select("series_id", F.explode(probs).alias("problem"))
    twice = requests.groupBy("series_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("series_id", F.lit("series ids must be unique").alias("problem"))
    return each.unionByName(twice)


def normalize(cov: DataFrame) -> DataFrame:
    """Past covariates, and future ones only for names the series also has in the past."""
    past = cov.where("role = 'past'").select("series_id", "name").distinct()
    future = cov.where("role = 'future'").join(past, ["series_id", "name"], "left_semi")
    return cov.where("role <> 'future'").unionByName(future)


def known_future(cov: DataFrame) -> DataFrame:
    """(series_id, name) present in both roles."""
    pick = lambda r: cov.where(F.col("role") == r).select("series_id", "name")
    return pick("past").intersect(pick("future"))


def future_only(cov: DataFrame) -> DataFrame:
    """(series_id, name) present in the future only."""
    pick = lambda r: cov.where(F.col("role") == r).select("series_id", "name")
    return pick("future").subtract(pick("past"))


def profile(cov: DataFrame) -> DataFrame:
    """(series_id, name, group, kind): past_only, known_future or static."""
    p = _paired(cov)
    group = F.when(F.col("past_kind").isNotNull() & F.col("future_kind").isNotNull(), "known_future").otherwise("past_only")
    dyn = p.where(F.col("past_kind").isNotNull()).select("series_id", "name", group.alias("group"), F.col("past_kind").alias("kind"))
    stat = cov.where("role = 'static'").select("series_id", "name").distinct().select("series_id", "name", F.lit("static").alias("group"), F.lit("static").alias("kind"))
    return dyn.unionByName(stat)


def _capability(model: tuple) -> dict[str, bool]:
    names = [c.strip().split()[0] for c in COLUMNS.split(",")]
    return dict(zip(names, model))


def apply_capabilities(cov: DataFrame, model: str, mode: str = "best_effort", models: Sequence[tuple] = MODELS) -> tuple[DataFrame, DataFrame]:
    """(kept covariates, warnings) for a model; `strict` raises if anything is unsupported."""
    cap = _capability(next(m for m in models if m[0] == model))
    g, k = F.col("group"), F.col("kind")
    ok = (
        F.when(g == "static", F.lit(cap["static"]))
        .when((g == "past_only") & (k == "numeric"), F.lit(cap["past_num"]))
        .when(g == "past_only", F.lit(cap["past_cat"]))
        .when(k == "numeric", F.lit(cap["fut_num"]))
        .otherwise(F.lit(cap["fut_cat"]))
    )
    prof = profile(cov).withColumn("ok", ok)
    label = F.when(g == "past_only", "past-only").when(g == "known_future", "known-future").otherwise("static")
    what = F.when(g == "static", "").otherwise(F.concat(F.lit(" "), k))
    text = F.format_string(
        f"ignoring unsupported covariate: model '{model}' (family={cap['family']}) does not support %s%s covariates; series='%s' covariate='%s'",
        label, what, F.col("series_id"), F.col("name"),
    )
    warnings = prof.where(~F.col("ok")).select("series_id", "name", text.alias("warning"))
    if mode == "strict":
        bad = warnings.orderBy("series_id", "name").limit(5).collect()
        if bad:
            raise ValueError("; ".join(r.warning for r in bad))
    kept = cov.join(prof.where("ok").select("series_id", "name", (F.col("group") == "static").alias("_s")), ["series_id", "name"])
    return kept.where((F.col("role") == "static") == F.col("_s")).drop("_s"), warnings


def apply_policy(cov: DataFrame, model: str) -> DataFrame:
    """Covariate subset by model policy."""
    if model not in POLICY:
        raise ValueError(f"unsupported model {model!r}")
    rule = POLICY[model]
    dyn = cov.where("role in ('past', 'future')")
    if rule == "all":
        return dyn
    if rule == "none":
        return dyn.where(F.lit(False))
    ok = kinds(dyn).where("kind = 'numeric'").select("series_id", "role", "name")
    numeric = dyn.join(ok, ["series_id", "role", "name"], "left_semi")
    past = numeric.where("role = 'past'")
    if rule == "past_numeric":
        return past
    future = numeric.where("role = 'future'").join(past.select("series_id", "name").distinct(), ["series_id", "name"], "left_semi")
    return past.unionByName(future)


def assemble_exogenous(history: DataFrame, cov: DataFrame, horizon: int, names: Sequence[str], freq: str) -> DataFrame:
    """(series_id, role, ts, <names>): model-ready columns over history and horizon.

    Missing past values are 0, missing future values the last observed past value (else 0), text is 0.
    """
    num = lambda n: F.max(F.when(F.col("name") == n, F.col("num")))
    wide = cov.groupBy("series_id", "role", "ts").agg(*[num(n).alias(n) for n in names])
    last = cov.where("role = 'past'").groupBy("series_id").agg(
        *[F.max_by("num", F.when((F.col("name") == n) & F.col("num").isNotNull(), F.col("ts"))).alias(f"_{n}") for n in names]
    )
    past = history.select("series_id", "ts").join(wide.where("role = 'past'").drop("role"), ["series_id", "ts"], "left")
    past = past.select("series_id", F.lit("past").alias("role"), "ts", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    ends = history.groupBy("series_id").agg(F.max("ts").alias("_t"))
    steps = ends.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"), "_t").select("series_id", add_steps(F.col("_t"), F.col("k"), freq).alias("ts"))
    fut = steps.join(wide.where("role = 'future'").drop("role"), ["series_id", "ts"], "left").join(last, "series_id", "left")
    fut = fut.select("series_id", F.lit("future").alias("role"), "ts", *[F.coalesce(n, f"_{n}", F.lit(0.0)).alias(n) for n in names])
    return past.unionByName(fut)


def _bucket(ts: Column, hourly: bool) -> Column:
    return (F.hour(ts) if hourly else F.weekday(ts)).cast("double")


def calendar(history: DataFrame, horizon: int, freq: str) -> DataFrame:
    """Known-future calendar covariates for history and horizon: hour or weekday number, weekend label."""
    hourly = freq.strip().upper().startswith("H")
    ends = history.groupBy("series_id").agg(F.max("ts").alias("_t"))
    ahead = ends.select("series_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"), "_t").select(
        "series_id", F.lit("future").alias("role"), add_steps(F.col("_t"), F.col("k"), "h" if hourly else "D").alias("ts")
    )
    rows = history.select("series_id", F.lit("past").alias("role"), "ts").unionByName(ahead)
    label = F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday")
    return rows.select("series_id", "role", "ts", _bucket(F.col("ts"), hourly).alias("calendar_num"), label.alias("calendar_cat"))
