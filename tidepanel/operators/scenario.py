"""What-if transforms, counterfactuals, scenario trees and panel augmentation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


from tidepanel.operators import blocks as bl, forecast as fc
from tidepanel.operators.blocks import attach, per_series
from tidepanel.operators.clean import add_steps
from tidepanel.session import cut_lineage

MAX_DEPTH = 6


@dataclass(frozen=True)
class Transform:
    """One what-if step: multiply / add / replace a target or covariate, for one series or all."""

    field: str  # target, past or future
    op: str  # multiply, add or replace
    value: float
    series_id: str | None = None
    key: str | None = None  # covariate name


def _apply(value: Column, transforms: Sequence[Transform], series: Column, name: Column | None) -> Column:
    out = value
    for t in transforms:
        hit = F.lit(True)
        if t.series_id is not None:
            hit = hit & (series == t.series_id)
        if name is not None:
            hit = hit & (name == t.key)
        v = F.lit(float(t.value))
        new = {"multiply": out * v, "add": out + v, "replace": v}[t.op]
        out = F.when(hit, new).otherwise(out)
    return out


def what_if_panel(panel: DataFrame, scenarios: dict[str, Sequence[Transform]]) -> DataFrame:
    """The panel once per scenario (column `scenario`), target transforms folded in order; the panel is read once."""
    made = [
        F.struct(F.lit(name).alias("scenario"), _apply(F.col("y"), [t for t in transforms if t.field == "target"], F.col("series_id"), None).alias("y"))
        for name, transforms in scenarios.items()
    ]
    spread = panel.select(*panel.columns, F.explode(F.array(*made)).alias("_s"))
    return spread.select(*[F.col("_s.y").alias("y") if c == "y" else c for c in panel.columns], F.col("_s.scenario").alias("scenario"))


def what_if_covariates(covariates: DataFrame, scenarios: dict[str, Sequence[Transform]]) -> DataFrame:
    """Long covariates (series_id, role, name, ..., num) once per scenario."""
    out = None
    for label, transforms in scenarios.items():
        num = F.col("num")
        for role in ("past", "future"):
            own = [t for t in transforms if t.field == role]
            num = F.when(F.col("role") == role, _apply(num, own, F.col("series_id"), F.col("name"))).otherwise(num)
        one = covariates.withColumn("num", num).withColumn("scenario", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


def unmatched_transforms(panel: DataFrame, scenarios: dict[str, Sequence[Transform]]) -> DataFrame:
    """(scenario, ordinal, series_id): transforms that name a series the panel does not have."""
    spark = panel.sparkSession
    rows = [(s, i, t.series_id) for s, ts in scenarios.items() for i, t in enumerate(ts) if t.series_id is not None]
    wanted = spark.createDataFrame(rows, "scenario string, ordinal int, series_id string")
    return wanted.join(panel.select("series_id").distinct(), "series_id", "left_anti")


def what_if(panel: DataFrame, scenarios: dict[str, Sequence[Transform]], model, horizon: int, **kw) -> DataFrame:
    """Baseline and scenario forecasts with their difference by step: (scenario, series_id, step, mean, delta)."""
    both = what_if_panel(panel, {"baseline": [], **scenarios})
    keys = ["scenario", "series_id"]
    rows = fc.forecast(both, model, horizon, keys=keys, **kw).where(F.col("error").isNull())
    base = rows.where("scenario = 'baseline'").select("series_id", "step", F.col("mean").alias("_b"))
    return rows.join(base, ["series_id", "step"]).select(
        "scenario", "series_id", "step", "mean", (F.col("mean") - F.col("_b")).alias("delta")
    )


def what_if_problems(panel: DataFrame, scenarios: dict[str, Sequence[Transform]], model, horizon: int, **kw) -> DataFrame:
    """(scenario, series_id, warning): series without a forecast in a scenario, with the model's error if it gave one."""
    both = what_if_panel(panel, {"baseline": [], **scenarios})
    keys = ["scenario", "series_id"]
    rows = fc.forecast(both, model, horizon, keys=keys, **kw).groupBy(*keys).agg(F.count("mean").alias("points"), F.max("error").alias("error"))
    asked = both.select(*keys).distinct().join(rows, keys, "left").where(F.coalesce("points", F.lit(0)) < horizon)
    text = F.format_string("missing forecast for series %s; skipped", "series_id")
    return asked.select(*keys, F.when(F.col("error").isNull(), text).otherwise(F.concat_ws(": ", text, "error")).alias("warning"))


def counterfactual_warnings(panel: DataFrame, at: Column, steps: DataFrame, horizon: int) -> DataFrame:
    """(series_id, warning) of a counterfactual: no points after the intervention, no forecast, or differing lengths."""
    after = panel.groupBy("series_id").agg(F.count_if(F.col("pos") >= at).alias("after"), F.count_if(F.col("pos") < at).alias("before"))
    found = after.join(steps.groupBy("series_id").agg(F.count(F.lit(1)).alias("steps")), "series_id", "left")
    text = (
        F.when(F.col("before") == 0, F.format_string("no history before the intervention for series %s; skipped", "series_id"))
        .when(F.col("after") == 0, F.format_string("no post-intervention points available for series %s", "series_id"))
        .when(F.col("steps").isNull(), F.format_string("missing baseline forecast for series %s; skipped", "series_id"))
        .when(F.col("after") != horizon, F.format_string("series %s has %d points after the intervention, the forecast %d; aligned to the shorter", "series_id", "after", F.lit(horizon)))
    )
    return found.withColumn("warning", text).where(F.col("warning").isNotNull()).select("series_id", "warning")


def counterfactual(panel: DataFrame, at: Column, model, **kw) -> tuple[DataFrame, DataFrame]:
    """Forecast from before position `at` against what was observed: (steps, summary per series).

    `at` may depend on `n`; the horizon is the longest stretch after it, shorter ones are aligned.
    """
    horizon = kw.pop("horizon")
    before = panel.where(F.col("pos") < at).withColumn("n", at.cast("long"))
    after = panel.where(F.col("pos") >= at).select("series_id", (F.col("pos") - at + 1).cast("int").alias("step"), F.col("y").alias("actual"))
    expected = fc.forecast(before, model, horizon, **kw).where(F.col("error").isNull())
    steps = after.join(expected.select("series_id", "step", F.col("mean").alias("counterfactual")), ["series_id", "step"])
    steps = steps.withColumn("delta", F.col("actual") - F.col("counterfactual"))
    s = steps.groupBy("series_id").agg(
        F.avg(F.abs("delta")).alias("mean_absolute_delta"),
        F.sum("delta").alias("total_delta"),
        F.avg("delta").alias("_md"),
        F.avg("actual").alias("_ma"),
    )
    pct = F.when(F.abs("_ma") > 1e-9, F.col("_md") / F.abs("_ma") * 100)
    direction = (
        F.when(F.col("total_delta") > 1e-9, "above_counterfactual").when(F.col("total_delta") < -1e-9, "below_counterfactual").otherwise("neutral")
    )
    return steps, s.select("series_id", "mean_absolute_delta", "total_delta", pct.alias("average_delta_pct"), direction.alias("direction"))


def _branch_value(level: float) -> Column:
    """The exact level, else the nearest one of the forecast, else its mean."""
    near = F.array_min(
        F.transform(F.map_entries("quantiles"), lambda e: F.struct(F.abs(e.key.cast("double") - F.lit(level)).alias("d"), e.value.alias("v")))
    )
    return F.coalesce(near["v"], F.col("mean"))


def _ahead(history: DataFrame, paths: DataFrame, model, levels: Sequence[float]) -> DataFrame:
    """One step from every open path: (series_id, node_id, mean, quantiles, error). The history travels once; models inside a
    task see it with the values of a path added. A native model without a per-series form gets a copy for each path."""
    if isinstance(model, str) and model in fc.LOCAL:
        model = fc.local_model(model)
    if isinstance(model, fc.GroupedModel):
        return model.run(history, 1, levels, ["series_id"], paths)
    keys, size = ["node_id", "series_id"], F.size("added")
    joined = history.select("series_id", "pos", "n", "y").join(paths, "series_id")
    tail = history.select("series_id", "n").distinct().join(paths, "series_id").select("*", F.posexplode("added").alias("_i", "y"))
    both = joined.select(*keys, "pos", (F.col("n") + size).alias("n"), "y").unionByName(
        tail.select(*keys, (F.col("n") + F.col("_i")).alias("pos"), (F.col("n") + size).alias("n"), "y")
    )
    return fc.forecast(both, model, 1, levels, keys)


def scenario_tree(
    panel: DataFrame, model, depth: int, levels: Sequence[float], context: int | None = None, max_nodes: int | None = None
) -> DataFrame:
    """Nodes (series_id, node_id, parent_id, depth, branch, quantile, value, probability, warning).

    Each level forecasts one step from every open path and branches on the quantile levels, splitting
    the probability evenly, so the open branches of a level add up to 1. Node ids are paths, so they do not
    depend on the partitioning. A tree larger than `max_nodes` per series is refused before any forecast.
    Models see the whole history, or the last `context` points, and the values of the path; the path is a short array, so no
    level copies the history. `warning` tells of a quantile that the mean stands in for, and of a path without a forecast (a row
    without branch and value).
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be in 1..{MAX_DEPTH}")
    size = sum(len(levels) ** d for d in range(depth + 1))
    if max_nodes is not None and size > max_nodes:
        raise ValueError(f"{size} nodes per series, more than {max_nodes}")
    spark, width = panel.sparkSession, len(levels)
    drop = F.greatest(F.col("n") - context, F.lit(0)) if context is not None else F.lit(0).cast("long")
    extra = [c for c in ("ts", "freq") if c in panel.columns]
    hist = panel.where(F.col("pos") >= drop).select("series_id", (F.col("pos") - drop).alias("pos"), (F.col("n") - drop).alias("n"), "y", *extra)
    none = F.lit(None).cast("string")
    nodes = panel.groupBy("series_id").agg(F.max_by("y", "pos").alias("value")).select(
        "series_id", F.lit("root").alias("node_id"), none.alias("parent_id"), F.lit(0).alias("depth"),
        F.lit("root").alias("branch"), F.lit(None).cast("double").alias("quantile"), "value", F.lit(1.0).alias("probability"), none.alias("warning"),
    )
    paths = nodes.select("series_id", "node_id", F.array().cast("array<double>").alias("added"))
    for d in range(1, depth + 1):
        ahead = _ahead(hist, paths, model, levels).select("series_id", "node_id", "mean", "quantiles", "error")
        asked = paths.join(ahead, ["series_id", "node_id"], "left")
        given = F.size(F.coalesce(F.map_keys("quantiles"), F.array().cast("array<string>"))) > 0

        def exact(q: float) -> Column:
            keys = F.coalesce(F.map_keys("quantiles"), F.array().cast("array<string>"))
            return F.exists(keys, lambda k: F.abs(k.try_cast("double") - F.lit(q)) <= 1e-9)

        def stands_in(q: float) -> Column:
            text = F.format_string(f"quantile {q:g} missing for series %s; used mean fallback", "series_id")
            return F.when(given & ~exact(q) & (_branch_value(q) == F.col("mean")), text)

        picks = F.array(*[F.struct(F.lit(f"q{q:g}").alias("branch"), F.lit(float(q)).alias("quantile"), _branch_value(float(q)).alias("value"), stands_in(float(q)).alias("warning")) for q in levels])
        lost = F.array(F.struct(none.alias("branch"), F.lit(None).cast("double").alias("quantile"), F.lit(None).cast("double").alias("value"), F.format_string(f"missing forecast for series %s at depth {d}; skipped", "series_id").alias("warning")))
        level = asked.select("series_id", F.col("node_id").alias("parent_id"), "added", F.explode(F.when(F.col("mean").isNull(), lost).otherwise(picks)).alias("b")).select(
            "series_id", F.concat_ws("/", "parent_id", F.coalesce("b.branch", F.lit("missing"))).alias("node_id"), "parent_id", F.lit(d).alias("depth"),
            "b.branch", "b.quantile", "b.value", F.lit(float(width) ** -d).alias("probability"), "b.warning",
            F.when(F.col("b.value").isNotNull(), F.concat("added", F.array("b.value"))).alias("added"),
        )
        level = cut_lineage(spark, level, f"tree-{d}")
        nodes = nodes.unionByName(level.where("value IS NOT NULL OR warning IS NOT NULL").drop("added"))
        paths = level.where("value IS NOT NULL").select("series_id", "node_id", "added")
    return nodes


def tree_warnings(nodes: DataFrame) -> DataFrame:
    """(series_id, warning) of a scenario tree, each once."""
    return nodes.where(F.col("warning").isNotNull()).select("series_id", "warning").distinct()


# Words that mark a scenario type in its name (fixed values).
TYPE_WORDS = {
    "base": ("base",),
    "upside": ("upside", "bull", "optimistic"),
    "downside": ("downside", "bear", "pessimistic"),
}
TYPE_TEXT = {
    "base": "Base case (%d%% probability): continuation of current trend and conditions",
    "upside": "Upside case (%d%% probability): favorable conditions materialize",
    "downside": "Downside case (%d%% probability): adverse conditions materialize",
    "alternative": "Alternative scenario (%d%% probability)",
}


def rationale(scenarios: DataFrame) -> DataFrame:
    """(group_id, name, type, probability, rationale) of (group_id, name, probability) rows."""
    name = F.lower("name")
    kind = F.when(name.contains("base"), "base")
    for k in ("upside", "downside"):
        kind = kind.when(name.rlike("|".join(TYPE_WORDS[k])), k)
    pct = F.round(F.col("probability") * 100).cast("int")
    out = scenarios.withColumn("type", kind.otherwise("alternative"))
    text = None
    for k, t in TYPE_TEXT.items():
        one = F.format_string(t, pct)
        text = F.when(F.col("type") == k, one) if text is None else text.when(F.col("type") == k, one)
    return out.withColumn("rationale", text)


def rationale_summary(explained: DataFrame) -> DataFrame:
    """(group_id, scenarios, most_likely, spread, uncertain): uncertain where probabilities span over 0.3."""
    s = explained.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.min_by("name", F.struct(-F.col("probability"), "name")).alias("most_likely"),
        (F.max("probability") - F.min("probability")).alias("spread"),
    )
    return s.withColumn("uncertain", F.col("spread") > 0.3)


# ---- augmentation ----------------------------------------------------------------------------


def series_profile(panel: DataFrame, period: int) -> DataFrame:
    """(series_id, n, level, slope, noise_std, non_negative, template): template by phase, if any."""
    use = F.col("n") >= 8
    prof = fc.profile(panel, period)
    half = F.greatest(F.floor(F.col("n") / 2), F.lit(2))
    seasonal = F.when(use & (half >= period) & F.lit(period >= 2), F.col("seasonal")).otherwise(0.0)
    prof = prof.withColumn("seasonal", seasonal)
    base = F.col("level") + F.col("slope") * (F.col("pos") - (F.col("n") - 1) / 2) + F.col("seasonal")
    rows = attach(panel.withColumn("phase", F.col("pos") % max(period, 1)), prof, extra=["phase"])
    noise = per_series(
        rows.withColumn("_r", F.col("y") - base),
        F.stddev_pop("_r").alias("_a"),
        F.stddev_pop("y").alias("_b"),
        F.min("y").alias("_min"),
        F.max("level").alias("level"),
        F.max("slope").alias("slope"),
    )
    shape = prof.groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "seasonal")))).alias("template"))
    return noise.join(shape, "series_id").select(
        "series_id", "n", "level", "slope",
        F.greatest(F.col("_a"), F.col("_b") * 0.05, F.lit(1e-6)).alias("noise_std"),
        (F.col("_min") >= 0).alias("non_negative"),
        "template",
    )


def _uniform(*parts) -> Column:
    """Uniform in (0, 1) hashed from the parts; any engine with MD5 draws the same."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def augment(
    panel: DataFrame,
    period: int,
    count: int,
    length: int | None = None,
    seed: int = 0,
    level_jitter: float = 0.05,
    trend_jitter: float = 0.1,
    seasonality_jitter: float = 0.1,
    noise_scale: float = 1.0,
    freq: str | None = None,
) -> DataFrame:
    """`count` variants of every series: (source_id, series_id, pos, y[, ts]).

    Level, slope and season are jittered per variant, Gaussian noise is added per point, and series that
    never go below 0 stay there. All draws are hashed from (seed, series, variant, point).
    """
    prof = series_profile(panel, period)
    size = F.lit(length).cast("long") if length else F.col("n")
    v = prof.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(count))))
    draw = lambda tag: 2 * _uniform(F.lit(seed), F.lit(tag), "series_id", "variant") - 1
    v = v.withColumns(
        {
            "_l": F.col("level") * (1 + level_jitter * draw("level")),
            "_s": F.col("slope") * (1 + trend_jitter * draw("trend")),
            "_k": 1 + seasonality_jitter * draw("season"),
            "_len": size,
        }
    )
    size = bl.BLOCK_ROWS  # a variant is spread over blocks before its points are made
    v = v.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_len") - 1) / size)))).repartition("series_id", "variant", "_b")
    v = v.withColumn("pos", F.explode(F.sequence(F.col("_b") * size, F.least((F.col("_b") + 1) * size, F.col("_len")) - 1)))
    u1 = _uniform(F.lit(seed), F.lit("u1"), "series_id", "variant", "pos")
    u2 = _uniform(F.lit(seed), F.lit("u2"), "series_id", "variant", "pos")
    gauss = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.pi() * u2)
    season = F.coalesce(F.col("template")[F.col("pos") % max(period, 1)], F.lit(0.0)) * F.col("_k")
    y = F.col("_l") + F.col("_s") * (F.col("pos") - (F.col("_len") - 1) / 2) + season + gauss * F.col("noise_std") * noise_scale
    y = F.when(F.col("non_negative"), F.greatest(y, F.lit(0.0))).otherwise(y)
    out = v.withColumn("y", F.round(y, 6))
    cols = [F.col("series_id").alias("source_id"), F.concat("series_id", F.lit("_synthetic_"), F.col("variant").cast("string")).alias("series_id"), "pos", "y"]
    if freq is None:
        return out.select(*cols)
    start = panel.groupBy("series_id").agg(F.min("ts").alias("_t0"))
    return out.join(start, "series_id").select(*cols, add_steps(F.col("_t0"), F.col("pos"), freq).alias("ts"))


def probability_check(nodes: DataFrame) -> DataFrame:
    """Probabilities per series and depth add up to 1."""
    return nodes.groupBy("series_id", "depth").agg(F.sum("probability").alias("total"))
