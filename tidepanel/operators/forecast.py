"""Forecasters over a panel: native ones as plain DataFrame jobs, others through a grouped-map slot.

Every forecaster takes a history panel (keys, pos, n, y) and returns (keys, step, mean).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidepanel.operators.blocks import KEY, UPPER_MEDIAN, attach, exact_quantiles, framed, per_series


def steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon)))


def last_value(history: DataFrame, horizon: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Repeat the last observation."""
    tail = history.groupBy(*keys).agg(F.max_by("y", "pos").alias("mean"))
    return tail.select(*keys, steps(horizon).alias("step"), "mean")


def seasonal_naive(history: DataFrame, horizon: int, season: int = 7, keys: Sequence[str] = KEY) -> DataFrame:
    """Repeat the last full season; series shorter than a season repeat their last value."""
    m = F.when(F.col("n") >= season, F.lit(season)).otherwise(F.lit(1))
    first = (F.col("pos") - (F.col("n") - m) + 1).cast("int")
    tail = history.where((F.col("pos") >= F.col("n") - m) & (first <= horizon))
    return tail.select(*keys, F.explode(F.sequence(first, F.lit(horizon), m)).alias("step"), F.col("y").alias("mean"))


def linear_trend(history: DataFrame, horizon: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Extrapolate the least-squares line over position; a constant for one point."""
    fit = per_series(
        history,
        F.coalesce(F.regr_slope("y", "pos"), F.lit(0.0)).alias("b"),
        F.avg("y").alias("my"),
        F.avg("pos").alias("mx"),
        keys=keys,
    )
    x = F.col("n") - 1 + F.col("step")
    return fit.select("*", steps(horizon).alias("step")).select(
        *keys, "step", (F.col("my") + F.col("b") * (x - F.col("mx"))).alias("mean")
    )


def profile(history: DataFrame, period: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Level, OLS slope and centred seasonal template (as one row per phase) of each series."""
    line = per_series(
        history,
        F.avg("y").alias("level"),
        F.coalesce(F.regr_slope("y", "pos"), F.lit(0.0)).alias("slope"),
        keys=keys,
    )
    if period < 2:
        return line.select("*", F.lit(0).cast("long").alias("phase"), F.lit(0.0).alias("seasonal"))
    base = F.col("level") + F.col("slope") * (F.col("pos") - (F.col("n") - 1) / 2)
    seasonal_means = (
        attach(history.select(*keys, "pos", "n", "y"), line.select(*keys, "n", "level", "slope"), keys=keys)
        .groupBy(*keys, (F.col("pos") % period).alias("phase"))
        .agg(F.avg(F.col("y") - base).alias("m"))
    )
    centred = seasonal_means.groupBy(*keys).agg(
        F.collect_list(F.struct("phase", "m")).alias("t"), F.avg("m").alias("c")
    )  # at most `period` entries
    return (
        line.join(centred, list(keys))
        .select("*", F.explode("t").alias("e"))
        .select(*keys, "n", "level", "slope", F.col("e.phase").alias("phase"), (F.col("e.m") - F.col("c")).alias("seasonal"))
    )


def seasonal_profile(history: DataFrame, horizon: int, period: int = 7, keys: Sequence[str] = KEY) -> DataFrame:
    """Continue level + slope + seasonal template."""
    prof = profile(history, period, keys)
    x = F.col("n") - 1 + F.col("step")
    on_phase = (x % period) == F.col("phase") if period >= 2 else F.lit(True)
    return (
        prof.select("*", steps(horizon).alias("step"))
        .where(on_phase)
        .select(
            *keys,
            "step",
            (F.col("level") + F.col("slope") * (x - (F.col("n") - 1) / 2) + F.col("seasonal")).alias("mean"),
        )
    )


# Name -> native forecaster (history, horizon, keys) -> (keys, step, mean). Users may add entries.
NATIVE: dict[str, Callable[..., DataFrame]] = {
    "last_value": last_value,
    "seasonal_naive": seasonal_naive,
    "linear_trend": linear_trend,
    "seasonal_profile": seasonal_profile,
}


# ---- per-series models ------------------------------------------------------------------------


class GroupedModel:
    """A per-series Python model: fn(history values as numpy array, horizon, quantile levels) -> dict.

    The result holds `mean` (list of horizon values) and optionally `quantiles` ({level: list}). Rows stream into the task in
    order and one series is held at a time, as plain arrays; the function sees all of it, or the last `max_context` points.
    """

    def __init__(self, name: str, fn: Callable, max_context: int | None = None):
        self.name, self.fn, self.max_context = name, fn, max_context
        self.covariates: DataFrame | None = None
        self.freq: str | None = None

    @staticmethod
    def _call(fn: Callable, request: dict) -> dict:
        return fn(request["target"], request["horizon"], request["quantiles"])

    def run(
        self, history: DataFrame, horizon: int, quantiles: Sequence[float] = (), keys: Sequence[str] = KEY, paths: DataFrame | None = None
    ) -> DataFrame:
        """(keys, step, mean, quantiles, error, elapsed_ms). With `paths` (keys, node_id, added values), every path of a series
        is one call on the history and the values added to it; the history itself travels once."""
        keys = list(keys)
        rows = _slot_rows(self, history, keys, paths)
        tagged = keys if paths is None else [*keys, "node_id"]
        types = {f.name: f.dataType.simpleString() for f in history.schema.fields} | {"node_id": "string"}
        ddl = ", ".join(f"{k} {types[k]}" for k in tagged) + ", step int, mean double, quantiles map<string,double>, error string, elapsed_ms double"
        levels = [float(q) for q in quantiles]
        tag_types = [to_arrow_type(history.schema[k].dataType) for k in keys] + [pa.string()] * (len(tagged) - len(keys))
        work = _Slot(type(self)._call, self.fn, keys, horizon, levels, self.max_context, self.freq, paths is not None, tag_types)
        return rows.repartition(*keys).sortWithinPartitions(*keys, "_kind", "_name", "_at", "_ts").mapInArrow(work, ddl)


class RequestModel(GroupedModel):
    """A per-series Python model that sees a whole request: fn(request) -> {"mean": ..., "quantiles": ...}.

    A request has keys (of the series), freq, timestamps, target, past_covariates and future_covariates ({name: array}), static
    ({name: value}), horizon and quantiles. `covariates` is a table (series_id, role, name, ts, num, cat). Of a history that ends
    at time t, covariates up to t are past ones; those after it are passed for names that are known in advance (that have rows
    of role `future`), the first `horizon` of them. So folds, counterfactuals and trees see what was known at their time.
    """

    def __init__(self, name: str, fn: Callable, covariates: DataFrame | None = None, freq: str | None = None, max_context: int | None = None):
        super().__init__(name, fn, max_context)
        self.covariates, self.freq = covariates, freq

    @staticmethod
    def _call(fn: Callable, request: dict) -> dict:
        return fn(request)


def _slot_rows(model: GroupedModel, history: DataFrame, keys: list[str], paths: DataFrame | None) -> DataFrame:
    """History, covariates and paths as rows of one shape."""
    null = lambda t: F.lit(None).cast(t)
    has = set(history.columns)
    ts = F.col("ts").cast("timestamp") if "ts" in has else null("timestamp")
    freq = F.col("freq") if "freq" in has else null("string")
    rows = history.select(
        *keys, F.lit(0).alias("_kind"), null("string").alias("_name"), F.col("pos").cast("long").alias("_at"), ts.alias("_ts"),
        F.col("y").cast("double").alias("_num"), freq.alias("_cat"), null("array<double>").alias("_more"),
    )
    if model.covariates is not None:
        c, has = model.covariates, set(model.covariates.columns)
        cov = c.select(
            "series_id", F.col("role").alias("_role"), F.col("name").alias("_name"), F.col("ts").cast("timestamp").alias("_ts"),
            F.col("num").cast("double").alias("_num"), (F.col("cat") if "cat" in has else null("string")).alias("_cat"),
        )
        if keys != ["series_id"]:
            cov = cov.join(history.select(*keys).distinct(), "series_id")
        kind = F.when(F.col("_role") == "static", 1).when(F.col("_role") == "past", 2).otherwise(3)
        rows = rows.unionByName(cov.select(*keys, kind.alias("_kind"), "_name", null("long").alias("_at"), "_ts", "_num", "_cat", null("array<double>").alias("_more")))
    if paths is not None:
        rows = rows.unionByName(
            paths.select(
                *keys, F.lit(4).alias("_kind"), F.col("node_id").alias("_name"), null("long").alias("_at"), null("timestamp").alias("_ts"),
                null("double").alias("_num"), null("string").alias("_cat"), F.col("added").alias("_more"),
            )
        )
    return rows


class _Slot:
    """Arrow batches of sorted slot rows to forecasts, one series at a time."""

    def __init__(self, call, fn, keys, horizon, levels, max_context, freq, by_path, tag_types):
        self.call, self.fn, self.keys, self.horizon, self.levels = call, fn, keys, horizon, levels
        self.max_context, self.freq, self.by_path, self.tag_types = max_context, freq, by_path, tag_types

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # pieces (kind, name, ts, num, cat, more) of the series at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c) for c in batch.schema.names}
            marks = [columns[c].to_numpy(zero_copy_only=False) for c in (*self.keys, "_kind", "_name")]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for m in marks:
                change[1:] |= np.array(m[1:] != m[:-1], bool)
            ts = columns["_ts"].cast(pa.timestamp("us")).to_numpy(zero_copy_only=False)
            num = columns["_num"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(change).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(columns[k][a].as_py() for k in self.keys)
                if key != at:
                    if held:
                        yield from self.series(at, held)
                    at, held = key, []
                kind = int(marks[-2][a])
                cat = columns["_cat"].slice(a, b - a).to_pylist() if kind in (1, 2, 3) else [columns["_cat"][a].as_py()]
                more = columns["_more"][a].as_py() if kind == 4 else None
                held.append((kind, marks[-1][a], ts[a:b], num[a:b], cat, more))
        if held:
            yield from self.series(at, held)

    def requests(self, key: tuple, held: list) -> Iterator[tuple[str | None, dict]]:
        target = np.concatenate([h[3] for h in held if h[0] == 0] or [np.zeros(0)])
        stamps = np.concatenate([h[2] for h in held if h[0] == 0] or [np.zeros(0, "datetime64[us]")])
        freq = self.freq or next((h[4][0] for h in held if h[0] == 0), None)
        static = {h[1]: (h[4][0] if h[4][0] is not None else float(h[3][0])) for h in held if h[0] == 1}
        names: dict[str, list] = {}
        known = {h[1] for h in held if h[0] == 3}
        for h in held:
            if h[0] in (2, 3):
                names.setdefault(h[1], []).append(h)
        joined = {}
        for name, parts in names.items():
            when = np.concatenate([p[2] for p in parts])
            order = np.argsort(when, kind="stable")
            text = [c for p in parts for c in p[4]]
            values = np.array(text, object) if any(c is not None for c in text) else np.concatenate([p[3] for p in parts])
            when, values = when[order], values[order]
            first = np.concatenate([[True], when[1:] != when[:-1]])  # a time given as past and as future counts once
            joined[name] = (when[first], values[first])
        step = stamps[-1] - stamps[-2] if len(stamps) > 1 else None
        for node, added in [(h[1], h[5]) for h in held if h[0] == 4] if self.by_path else [(None, [])]:
            y = np.concatenate([target, np.array(added, float)]) if added else target
            t = stamps
            if added and step is not None:
                t = np.concatenate([stamps, stamps[-1] + step * np.arange(1, len(added) + 1)])
            keep = slice(-self.max_context, None) if self.max_context else slice(None)
            y, t, past, future = y[keep], t[keep], {}, {}
            if joined and len(t):
                for name, (when, values) in joined.items():
                    past[name] = values[(when >= t[0]) & (when <= t[-1])]
                    if name in known:
                        future[name] = values[when > t[-1]][: self.horizon]
            yield node, {
                "keys": dict(zip(self.keys, key)), "freq": freq, "timestamps": t, "target": y, "past_covariates": past, "future_covariates": future,
                "static": static, "horizon": self.horizon, "quantiles": self.levels,
            }

    def series(self, key: tuple, held: list) -> Iterator[pa.RecordBatch]:
        if not any(h[0] == 0 for h in held):
            return
        names = [f"{q:g}" for q in self.levels]
        rows = []
        for node, request in self.requests(key, held):
            head = [*key, *([node] if self.by_path else [])]
            began = time.perf_counter()
            try:
                res = self.call(self.fn, request)
                spent = (time.perf_counter() - began) * 1000
                bands = res.get("quantiles") or {}
                mean = [float(v) for v in res["mean"]]
                rows += [(*head, i + 1, m, [(q, float(bands[q][i])) for q in names if q in bands], None, spent) for i, m in enumerate(mean) if m == m]
            except Exception as exc:  # noqa: BLE001 - one failing series must not fail the job
                rows.append((*head, None, None, None, f"{type(exc).__name__}: {exc}", (time.perf_counter() - began) * 1000))
        if rows:
            columns = list(zip(*rows))
            tagged = [*self.keys, *(["node_id"] if self.by_path else [])]
            types = [pa.int32(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.string(), pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, [*self.tag_types, *types])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*tagged, "step", "mean", "quantiles", "error", "elapsed_ms"])


# ---- the native models on one array, for calls inside a task ------------------------------------


def _local_scale(y: np.ndarray) -> float:
    d = np.diff(y)
    d = np.sort(d[~np.isnan(d)])
    if len(d):
        sigma = 1.4826 * float(np.sort(np.abs(d - d[len(d) // 2]))[len(d) // 2])
        if sigma > 1e-9:
            return sigma
    span = float(np.nanmax(y) - np.nanmin(y))
    return span / 6 if span > 0 else max(abs(float(y[-1])) * 0.01, 1e-6)


LOCAL = ("last_value", "seasonal_naive", "linear_trend", "seasonal_profile")


def local_model(name: str, season: int = 7, period: int = 7) -> GroupedModel:
    """A native model as a per-series one, with the same values; quantiles by the fallback."""

    def mean(y: np.ndarray, horizon: int) -> np.ndarray:
        n, x = len(y), len(y) + np.arange(horizon)
        if name == "last_value":
            return np.full(horizon, y[-1])
        if name == "seasonal_naive":
            m = season if n >= season else 1
            return y[n - m + np.arange(horizon) % m]
        at = np.arange(n) - (n - 1) / 2
        slope = float(at @ y / (at @ at)) if n > 1 else 0.0
        line = y.mean() + slope * (x - (n - 1) / 2)
        if name == "linear_trend" or period < 2:
            return line
        rest = y - y.mean() - slope * at
        means = np.array([rest[k::period].mean() if k < n else np.nan for k in range(period)])
        return line + (means - np.nanmean(means))[x % period]

    if name not in LOCAL:
        raise ValueError(f"{name!r} has no per-series form")

    def run(y: np.ndarray, horizon: int, levels: Sequence[float]) -> dict:
        value = mean(y, horizon)
        width = _local_scale(y) * np.sqrt(np.arange(1, horizon + 1)) if levels else None
        return {"mean": value, "quantiles": {f"{q:g}": value + NormalDist().inv_cdf(q) * width for q in levels}}

    return GroupedModel(name, run)


def forecast(
    history: DataFrame,
    model: str | GroupedModel,
    horizon: int,
    quantiles: Sequence[float] = (),
    keys: Sequence[str] = KEY,
    **params,
) -> DataFrame:
    """Batch forecast: (model, keys, step, mean, quantiles, error), failures isolated per series."""
    if isinstance(model, GroupedModel):
        return model.run(history, horizon, quantiles, keys).select(
            F.lit(model.name).alias("model"), *keys, "step", "mean", "quantiles", "error"
        )
    if model not in NATIVE:
        raise ValueError(f"unknown model {model!r}")
    base = NATIVE[model](history, horizon, keys=keys, **params)
    if quantiles:
        base = quantile_fallback(base, history, quantiles, keys)
    else:
        base = base.withColumn("quantiles", F.lit(None).cast("map<string,double>"))
    return base.select(
        F.lit(model).alias("model"), *keys, "step", "mean", "quantiles", F.lit(None).cast("string").alias("error")
    )


def timed_forecast(history: DataFrame, model: str | GroupedModel, horizon: int, quantiles: Sequence[float] = (), keys: Sequence[str] = KEY) -> DataFrame:
    """forecast() with `elapsed_ms`, the time of the call that made the row, measured inside the task. Native models are called
    series by series too."""
    slot = local_model(model) if isinstance(model, str) else model
    return slot.run(history, horizon, quantiles, keys).select(F.lit(slot.name).alias("model"), *keys, "step", "mean", "quantiles", "error", "elapsed_ms")


def series_scale(history: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Robust step scale: 1.4826 * MAD of first differences (upper order statistics), else range / 6,
    else 1 % of |last|, never below 1e-6."""
    keys = list(keys)
    diffs = framed(
        history.select(*keys, "pos", "n", "y"), lambda w: {"_d": F.col("y") - F.lag("y", 1).over(w)}, back=1, keys=keys
    )
    med = exact_quantiles(diffs, "_d", {"_m": UPPER_MEDIAN}, keys)
    dev = attach(diffs, med, keys=keys).withColumn("_dev", F.abs(F.col("_d") - F.col("_m")))
    mad = exact_quantiles(dev, "_dev", {"_mad": UPPER_MEDIAN}, keys).drop("n")
    shape = per_series(
        history, (F.max("y") - F.min("y")).alias("_rng"), F.abs(F.max_by("y", "pos")).alias("_last"), keys=keys
    )
    sigma = F.lit(1.4826) * F.col("_mad")
    scale = (
        F.when(F.coalesce(sigma > 1e-9, F.lit(False)), sigma)
        .when(F.col("_rng") > 0, F.col("_rng") / 6)
        .otherwise(F.greatest(F.col("_last") * 0.01, F.lit(1e-6)))
    )
    return shape.join(mad, keys, "left").select(*keys, scale.alias("scale"))


def quantile_fallback(mean: DataFrame, history: DataFrame, levels: Sequence[float], keys: Sequence[str] = KEY) -> DataFrame:
    """Add quantiles mean + z(q) * scale * sqrt(step) around a point forecast."""
    z = {f"{q:g}": NormalDist().inv_cdf(float(q)) for q in levels}
    width = F.col("scale") * F.sqrt(F.col("step").cast("double"))
    pairs = [x for q, zq in z.items() for x in (F.lit(q), F.col("mean") + F.lit(zq) * width)]
    return mean.join(series_scale(history, keys), list(keys)).withColumn("quantiles", F.create_map(*pairs)).drop("scale")


def flat_quantiles(mean: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Every requested quantile equals the mean (the last-value model's bands)."""
    pairs = [x for q in levels for x in (F.lit(f"{q:g}"), F.col("mean"))]
    return mean.withColumn("quantiles", F.create_map(*pairs))


def quantiles_from_samples(samples: DataFrame, levels: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Exact per-(series, step) quantiles of sample paths; `samples` carries pos/n within keys and y."""
    named = {f"q{q:g}": float(q) for q in levels}
    return exact_quantiles(samples, "y", named, keys).drop("n")


def pick_channels(forecast_rows: DataFrame, levels: Sequence[float], tolerance: float = 1e-6) -> DataFrame:
    """Map requested levels onto the model's own levels: the entry within `tolerance`, else NULL."""

    def lookup(q: float) -> Column:
        near = F.filter(F.map_entries("quantiles"), lambda e: F.abs(e.key.try_cast("double") - F.lit(float(q))) <= tolerance)
        return F.get(near, 0)["value"]

    pairs = [x for q in levels for x in (F.lit(f"{q:g}"), lookup(q))]
    mapped = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return forecast_rows.withColumn("quantiles", mapped)


def failed(history: DataFrame, name: str, problem: str, keys: Sequence[str] = KEY) -> DataFrame:
    """The rows of a model that couldn't be asked: one per series, with the error."""
    return history.select(*keys).distinct().select(
        F.lit(name).alias("model"), *keys, F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast("map<string,double>").alias("quantiles"), F.lit(problem).alias("error"),
    )


def compare(history: DataFrame, models: Sequence[str | GroupedModel], horizon: int, keys: Sequence[str] = KEY, **kw) -> DataFrame:
    """One request over several distinct models, stacked. A model that is unknown or can't be asked answers with error rows;
    the others are not affected."""
    names = [m.name if isinstance(m, GroupedModel) else m for m in models]
    if len(names) < 2 or len(set(names)) != len(names):
        raise ValueError("compare needs at least two distinct models")
    out = None
    for name, m in zip(names, models):
        try:
            one = forecast(history, m, horizon, keys=keys, **kw)
        except Exception as exc:  # noqa: BLE001 - reported as rows of this model
            one = failed(history, name, f"{type(exc).__name__}: {exc}", keys)
        out = one if out is None else out.unionByName(one)
    return out


def compare_summary(stacked: DataFrame, horizon: int) -> DataFrame:
    """ok / error per model: a model is ok when every series it answered has a full horizon and no error."""
    per = stacked.groupBy("model", "series_id").agg(
        F.count("mean").alias("points"), F.count("error").alias("errors")
    )
    return per.groupBy("model").agg(
        F.count(F.lit(1)).alias("series"),
        F.count_if((F.col("errors") > 0) | (F.col("points") != horizon)).alias("failed"),
    ).withColumn("status", F.when(F.col("failed") == 0, "ok").otherwise("error"))
