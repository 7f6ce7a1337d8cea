"""Series analysis: frequency, regularity, seasonality, trend, anomalies, stationarity, quality."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.freq import alias_of_seconds
from tidepanel.functions.numeric import clip, ratio, variance_ratio
from tidepanel.operators.blocks import KEY, attach, exact_quantiles, framed, halo, per_series
from tidepanel.operators.windows import downsample

# Analysis thresholds (fixed values).
MIN_SEASONAL_POINTS = 8
MIN_STATIONARY_POINTS = 8
SEASONAL_CORRELATION = 0.3
FLAT_SLOPE = 1e-3
# Nearest-alias table: alias and length in seconds (fixed values).
NEAREST = (
    ("S", 1.0),
    ("min", 60.0),
    ("H", 3600.0),
    ("D", 86400.0),
    ("W", 604800.0),
    ("MS", 2629800.0),
    ("QS", 7889400.0),
    ("YS", 31557600.0),
)
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DAYS = "MON TUE WED THU FRI SAT SUN".split()


# ---- autocorrelation -------------------------------------------------------------------------


def _degenerate_to_zero(c: Column) -> Column:
    return clip(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), -1.0, 1.0)


def autocorrelation(panel: DataFrame, lags: Sequence[int], keys: Sequence[str] = KEY) -> DataFrame:
    """corr_<k> per series for a few lags (0 where undefined)."""
    ahead = framed(panel, lambda w: {f"_l{k}": F.lead("y", k).over(w) for k in lags}, fwd=max(lags), keys=keys)
    return ahead.groupBy(*keys).agg(*[_degenerate_to_zero(F.corr("y", f"_l{k}")).alias(f"corr_{k}") for k in lags])


def _lag_sums(max_lag: int):
    """Partial sums per lag of one block: products, and moments of the leading and trailing parts."""

    def run(batches):
        for pdf in batches:
            ids, lags, cols = [], [], []
            for sid, n, p0, own, d in pdf.itertuples(index=False):
                x = np.asarray(d, float)
                k = np.arange(0, min(max_lag, n - 1) + 1)
                mine = x[:own]
                s1, s2 = np.concatenate([[0], np.cumsum(mine)]), np.concatenate([[0], np.cumsum(mine * mine)])
                lead = np.clip(n - k - p0, 0, own)  # rows that have a partner k ahead
                skip = np.clip(k - p0, 0, own)  # rows too early to be a partner
                prod = [float(x[: min(own, len(x) - j)] @ x[j : j + min(own, len(x) - j)]) if j < len(x) else 0.0 for j in k]
                cols.append(np.column_stack([prod, s1[lead], s2[lead], s1[own] - s1[skip], s2[own] - s2[skip]]))
                ids.extend([sid] * len(k))
                lags.extend(k.tolist())
            body = np.vstack(cols) if cols else np.empty((0, 5))
            out = pd.DataFrame(body, columns=["xy", "x", "xx", "y", "yy"])
            out.insert(0, "lag", np.asarray(lags, dtype=np.int32))
            out.insert(0, "series_id", ids)
            yield out

    return run


def acf(panel: DataFrame, max_lag: int = 365, from_lag: int = 1) -> DataFrame:
    """(series_id, n, lag, pearson, biased, unbiased) for lags from_lag..max_lag of series of any length.

    Blocks of consecutive rows plus `max_lag` rows of lookahead give partial sums that add up.
    """
    stats = per_series(panel, F.avg("y").alias("_mean"), F.var_pop("y").alias("_var"))
    centred = attach(panel.select("series_id", "pos", "n", "y"), stats.select("series_id", "n", "_mean")).withColumn(
        "_d", F.col("y") - F.col("_mean")
    )
    blocks = (
        halo(centred.select("series_id", "pos", "n", "_d"), fwd=max_lag)
        .groupBy("series_id", "_blk")
        .agg(
            F.max("n").alias("n"),
            F.min("pos").alias("p0"),
            F.count_if("_own").cast("int").alias("own"),
            F.array_sort(F.collect_list(F.struct("pos", "_d"))).alias("_a"),
        )
        .select("series_id", "n", "p0", "own", F.transform("_a", lambda s: s["_d"]).alias("d"))
    )
    sums = (
        blocks.mapInPandas(
            _lag_sums(max_lag), "series_id string, lag int, xy double, x double, xx double, y double, yy double"
        )
        .groupBy("series_id", "lag")
        .agg(*[F.sum(c).alias(c) for c in ("xy", "x", "xx", "y", "yy")])
        .join(stats.select("series_id", "n", "_var"), "series_id")
    )
    m = F.col("n") - F.col("lag")
    cov = F.col("xy") - F.col("x") * F.col("y") / m
    spread = F.sqrt(
        F.greatest(F.col("xx") - F.col("x") * F.col("x") / m, F.lit(0.0))
        * F.greatest(F.col("yy") - F.col("y") * F.col("y") / m, F.lit(0.0))
    )
    live = F.col("_var") > 0
    return sums.where(F.col("lag") >= from_lag).select(
        "series_id",
        "n",
        "lag",
        F.when(live & (spread > 1e-12 * F.col("_var") * m), clip(cov / spread, -1.0, 1.0)).otherwise(0.0).alias("pearson"),
        F.when(live, F.col("xy") / (F.col("n") * F.col("_var"))).alias("biased"),
        F.when(live, F.col("xy") / (m * F.col("_var"))).alias("unbiased"),
    )


def lag_axis(correlations: DataFrame, usable: Column, value: str) -> DataFrame:
    """One row per series with its usable correlations as an array ordered by lag (at most max_lag entries)."""
    point = F.when(usable, F.struct("lag", F.col(value).alias("c")))
    return correlations.groupBy("series_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(point)).alias("a"))


def seasonality(panel: DataFrame, max_lag: int = 365, top_k: int = 3) -> DataFrame:
    """(series_id, periods): lags of the strongest autocorrelation peaks, ascending.

    Peaks reach 0.3 and both neighbours; without any peak every lag of at least 0.3 counts.
    Series with fewer than 8 points have none.
    """
    usable = (F.col("lag") >= 2) & (F.col("lag") <= F.least(F.lit(max_lag), F.greatest(F.lit(2), F.floor(F.col("n") / 2))))
    axis = lag_axis(acf(panel, max_lag, from_lag=0), usable & (F.col("n") >= MIN_SEASONAL_POINTS), "pearson")
    a = F.col("a")

    def at(i: Column) -> Column:
        return F.coalesce(F.get(a, i)["c"], F.lit(-1.0))

    strong = F.filter(a, lambda e: e.c >= SEASONAL_CORRELATION)
    peaks = F.filter(
        a, lambda e, i: (e.c >= SEASONAL_CORRELATION) & (e.c >= F.when(i > 0, at(i - 1)).otherwise(-1.0)) & (e.c >= at(i + 1))
    )
    pool = F.when(F.size(peaks) > 0, peaks).otherwise(strong)
    best = F.slice(F.array_sort(F.transform(pool, lambda e: F.struct((-e.c).alias("w"), e.lag.alias("lag")))), 1, top_k)
    return axis.select("series_id", F.array_sort(F.transform(best, lambda s: s.lag)).alias("periods"))


def detect_period(panel: DataFrame) -> DataFrame:
    """(series_id, period): first strict peak above 0.1 of the biased ACF, else 7 / 12 / 1 by length."""
    usable = F.col("lag") < F.least(F.floor(F.col("n") / 2), F.lit(365))
    axis = lag_axis(acf(panel, 365, from_lag=0), usable & (F.col("lag") >= 1) & F.col("biased").isNotNull(), "biased")
    a = F.col("a")
    peaks = F.filter(
        a,
        lambda e, i: (e.lag >= 2)
        & (e.c > 0.1)
        & (e.c > F.get(a, i - 1)["c"])
        & (e.c > F.get(a, i + 1)["c"]),
    )
    default = F.when(F.col("n") >= 365, 7).when(F.col("n") >= 52, 12).otherwise(1)
    found = F.when(F.size(a) == 0, 1).otherwise(F.coalesce(F.get(peaks, 0)["lag"], default))  # no lags: constant series
    return axis.select("series_id", F.when(F.col("n") < 10, 1).otherwise(found).cast("int").alias("period"))


def dominant_period(panel: DataFrame, rows: int | None = None, tile_bits: int | None = None) -> DataFrame:
    """(series_id, period) of the strongest Fourier bin of the valid values; NULL where none is usable.

    Series of up to `rows` (a block) are transformed in one task, longer ones by distributed transforms.
    """
    from tidepanel.operators import blocks as bl, fourier

    rows = rows or bl.BLOCK_ROWS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("pos")["d"].to_numpy(float)
        n = len(y)
        strongest = int(np.argmax(np.abs(np.fft.rfft(y))[1:])) + 1 if n >= 6 else None
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "n": [n], "bin": pd.array([strongest], dtype="Int64")})

    valid = fourier.centred(panel)
    short = valid.where(F.col("n") <= rows).groupBy("series_id").applyInPandas(run, "series_id string, n long, bin long")
    long = valid.where(F.col("n") > rows)
    if not long.isEmpty():
        ends = per_series(long).join(fourier.strongest(fourier.spectrum(long, "d", tile_bits, half=True), tile_bits), "series_id")
        short = short.unionByName(ends.select("series_id", "n", "bin"))
    period = F.floor(F.col("n") / F.col("bin"))
    found = short.select(
        "series_id", F.when((F.col("n") >= 6) & (period >= 2) & (period <= F.floor(F.col("n") / 2)), period).cast("int").alias("period")
    )
    return panel.select("series_id").distinct().join(found, "series_id", "left")


# ---- frequency -------------------------------------------------------------------------------


def deltas(panel: DataFrame) -> DataFrame:
    """Panel with `_prev` timestamp and `delta` seconds to it."""
    out = framed(panel, lambda w: {"_prev": F.lag("ts", 1).over(w)}, back=1)
    return out.withColumn("delta", (F.unix_micros("ts") - F.unix_micros("_prev")) / F.lit(1_000_000.0))


def step_facts(panel: DataFrame) -> DataFrame:
    """One row per series with everything frequency rules need, from one pass over its time steps.

    Rows are first merged per (series, step length), so a hot series is spread over its step lengths.
    """
    d = deltas(panel)
    ts, gap = F.col("ts"), F.col("delta")
    dow, dom = F.weekday(ts), F.dayofmonth(ts)
    left = F.dayofmonth(F.last_day(ts)) - dom
    months = F.year(ts) * 12 + F.month(ts) - F.year("_prev") * 12 - F.month("_prev")
    years = F.year(ts) - F.year("_prev")
    days = F.round(gap / 86400)
    start, first = F.struct("pos", F.month(ts).alias("m"), dow.alias("w")), F.col("delta").isNull()
    flags = {
        "cs": dom == 1,
        "bs": (dom == 1) & (dow < 5) | ((dom <= 3) & (dow == 0)),
        "ce": left == 0,
        "be": (left == 0) & (dow < 5) | ((left < 3) & (dow == 4)),
        "biz": (dow < 5) & (first | (gap == 86400) | ((gap == 3 * 86400) & (dow == 0))),
        "weekdays": dow < 5,
    }
    per_step = d.groupBy("series_id", "delta").agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("c"),
        F.min(months).alias("mlo"), F.max(months).alias("mhi"), F.min(years).alias("ylo"), F.max(years).alias("yhi"),
        F.min(F.month(ts)).alias("m_lo"), F.max(F.month(ts)).alias("m_hi"),
        F.min(start).alias("s0"),
        *[F.bool_and(c).alias(k) for k, c in flags.items()],
        F.first(days).alias("days"),
    )
    up = gap > 0
    spaced = F.col("days") > 0
    return per_step.groupBy("series_id").agg(
        F.max("n").alias("n"),
        F.min(gap).alias("lo"), F.max(gap).alias("hi"),
        F.min("mlo").alias("mlo"), F.max("mhi").alias("mhi"), F.min("ylo").alias("ylo"), F.max("yhi").alias("yhi"),
        F.min("m_lo").alias("m_lo"), F.max("m_hi").alias("m_hi"),
        F.min("s0")["m"].alias("m0"), F.min("s0")["w"].alias("w0"),
        *[F.bool_and(k).alias(k) for k in flags],
        F.max_by("delta", F.when(up, F.struct(F.col("c"), -gap))).alias("dominant"),
        F.max(F.when(up, F.col("c"))).alias("_top"),
        F.sum(F.when(up, F.col("c"))).alias("_positive"),
        F.sum(F.when(gap.isNotNull(), F.col("c"))).alias("_all"),
        ratio(F.sum(F.when(spaced & F.col("days").isin(1, 3, 4), F.col("c")).otherwise(0)), F.sum(F.when(spaced, F.col("c")))).alias("usual"),
        F.max((F.col("days") >= 3).cast("int")).alias("wide"),
    ).withColumns(
        {
            "share": ratio("_top", "_positive"),
            "all_share": F.coalesce(ratio("_top", "_all"), F.lit(0.0)),
            "deltas": F.coalesce("_positive", F.lit(0)),
        }
    ).drop("_top", "_positive", "_all")


def regularity(panel: DataFrame) -> DataFrame:
    """(series_id, dominant, share, all_share, deltas): most common positive delta, smallest on ties.

    `share` is over positive deltas, `all_share` (the regularity score) over all of them.
    """
    return step_facts(panel).select("series_id", "dominant", "share", "all_share", "deltas")


def _alias() -> Column:
    """Calendar and constant-step alias of strictly regular series over `step_facts`, else NULL.

    Rules in order: year, quarter, month (calendar or business start / end), weeks, days, business
    days, hours, minutes, seconds.
    """
    kind = F.when(F.col("cs"), "cs").when(F.col("bs"), "bs").when(F.col("ce"), "ce").when(F.col("be"), "be")
    pre = {"cs": "", "bs": "B", "ce": "", "be": "B"}
    suf = {"cs": "S", "bs": "S", "ce": "E", "be": "E"}

    def named(letter: str) -> Column:
        out = None
        for k in ("cs", "bs", "ce", "be"):
            lit = F.lit(pre[k] + letter + suf[k])
            out = F.when(kind == k, lit) if out is None else out.when(kind == k, lit)
        return out

    def counted(count: Column, text: Column) -> Column:
        return F.when(count == 1, text).otherwise(F.concat(count.cast("string"), text))

    month_name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("m0"))
    # Anchor month of a quarter rule: the month class modulo 3 maps to DEC, OCT or NOV.
    quarter_name = F.when(F.col("m0") % 3 == 0, "DEC").when(F.col("m0") % 3 == 1, "OCT").otherwise("NOV")
    day_name = F.element_at(F.array(*[F.lit(x) for x in DAYS]), F.col("w0") + 1)
    whole_days = F.col("lo") % 86400 == 0
    unique = F.col("lo") == F.col("hi")
    days = (F.col("lo") / 86400).cast("long")
    calendar = whole_days & kind.isNotNull()
    same_step = calendar & (F.col("mlo") == F.col("mhi")) & (F.col("mlo") > 0)
    return (
        F.when((F.col("n") < 3) | (F.col("lo") <= 0), F.lit(None).cast("string"))
        .when(
            calendar & (F.col("ylo") == F.col("yhi")) & (F.col("m_lo") == F.col("m_hi")),
            counted(F.col("ylo"), F.concat(named("Y"), F.lit("-"), month_name)),
        )
        .when(same_step & (F.col("mlo") % 3 == 0), counted((F.col("mlo") / 3).cast("int"), F.concat(named("Q"), F.lit("-"), quarter_name)))
        .when(same_step, counted(F.col("mlo"), named("M")))
        .when(whole_days & unique & (days % 7 == 0), counted((days / 7).cast("long"), F.concat(F.lit("W-"), day_name)))
        .when(whole_days & unique, counted(days, F.lit("D")))
        .when(whole_days & F.col("biz"), F.lit("B"))
        .when(~whole_days & unique & (F.col("lo") == F.col("lo").cast("long")), alias_of_seconds(F.col("lo")))
    )


def inferred_alias(panel: DataFrame) -> DataFrame:
    """(series_id, n, alias): NULL alias unless the series is strictly regular."""
    return step_facts(panel).select("series_id", "n", _alias().alias("alias"))


def _nearest(seconds: Column) -> Column:
    """Alias nearest to a step on a logarithmic scale."""
    options = [
        F.struct(F.abs(F.ln(F.greatest(seconds, F.lit(1e-9)) / sec)).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("a"))
        for i, (a, sec) in enumerate(NEAREST)
    ]
    return F.array_min(F.array(*options))["a"]


def detect_frequency(panel: DataFrame) -> DataFrame:
    """(series_id, frequency, regularity): inferred alias, else nearest alias if regular, else irregular.

    Where at least 80 % of the steps are equal, their median is that dominant step.
    """
    facts = step_facts(panel).withColumn("alias", _alias())
    freq = (
        F.when(F.col("n") < 3, "unknown")
        .when(F.col("alias").isNotNull(), F.col("alias"))
        .when(F.col("all_share") >= 0.8, F.coalesce(_nearest(F.col("dominant")), F.lit("irregular")))
        .otherwise("irregular")
    )
    score = F.when(F.col("n") < 3, 0.0).otherwise(F.col("all_share"))
    return facts.select("series_id", freq.alias("frequency"), score.alias("regularity"))


def dominant_alias(min_share: float = 0.8, share: str = "share") -> Column:
    """Alias of the dominant step where its share (or half of at least 1000 steps) suffices."""
    ok = (F.col(share) >= min_share) | ((F.col("deltas") >= 1000) & (F.col(share) >= 0.5))
    return F.when((F.col("deltas") >= 2) & ok, alias_of_seconds(F.col("dominant")))


def ingest_frequency(panel: DataFrame, freq: str | None = None, freq_column: str | None = None, imputing: bool = False) -> DataFrame:
    """(series_id, frequency): explicit, then first non-blank of the column, inferred, dominant, `auto`."""
    if freq is not None:
        return panel.select("series_id").distinct().withColumn("frequency", F.lit(freq))
    out = step_facts(panel)
    chain = [_alias(), dominant_alias()]
    if imputing:
        chain.append(dominant_alias(0.5))
    if freq_column:
        text = F.trim(F.col(freq_column))
        first = panel.groupBy("series_id").agg(F.min_by(text, F.when(text != "", F.col("pos"))).alias("_f"))
        out = out.join(first, "series_id", "left")
        chain.insert(0, F.col("_f"))
    return out.select("series_id", F.coalesce(*chain, F.lit("auto")).alias("frequency"))


def request_frequency(panel: DataFrame) -> DataFrame:
    """Like ingest, recognising business-daily data among mostly daily steps."""
    business = (F.col("dominant") == 86400) & F.col("weekdays") & (F.col("wide") == 1) & (F.col("usual") >= 0.95)
    dom = dominant_alias(share="all_share")
    return step_facts(panel).select(
        "series_id", F.coalesce(_alias(), F.when(dom.isNotNull() & business, "B").otherwise(dom)).alias("frequency")
    )


# Canonical steps of the median ladder and its fallback bounds in seconds (fixed values).
LADDER = ((1.0, "S"), (60.0, "MIN"), (1800.0, "30MIN"), (3600.0, "H"), (86400.0, "D"), (604800.0, "W"), (2592000.0, "M"))
LADDER_BELOW = ((1800.0, "MIN"), (43200.0, "H"), (432000.0, "D"), (1209600.0, "W"))


def median_frequency(panel: DataFrame) -> DataFrame:
    """(series_id, frequency) from the median positive step within 25 % of a canonical one."""
    d = deltas(panel).withColumn("_pd", F.when(F.col("delta") > 0, F.col("delta")))
    med = F.col("med")
    out = F.when(med.isNull(), "D")
    for sec, name in LADDER:
        out = out.when(F.abs(med - sec) <= max(1.0, sec * 0.25), name)
    for bound, name in LADDER_BELOW:
        out = out.when(med < bound, name)
    return exact_quantiles(d, "_pd", {"med": 0.5}).select("series_id", out.otherwise("M").alias("frequency"))


# ---- trend, anomalies, stationarity, quality -------------------------------------------------


def _trend_aggregates() -> list[Column]:
    return [F.regr_slope("y", "pos").alias("_b"), F.regr_r2("y", "pos").alias("_r2"), F.var_pop("y").alias("_v"), F.avg("y").alias("_m")]


def _trend_columns() -> list[Column]:
    slope = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("_b", F.lit(0.0)))
    flat = F.abs(slope) / F.greatest(F.abs("_m"), F.lit(1.0)) < FLAT_SLOPE
    r2 = F.when((F.col("n") < 2) | (F.col("_v") == 0), 0.0).otherwise(clip(F.col("_r2")))
    return [slope.alias("slope"), r2.alias("r2"), F.when(flat, "flat").when(slope > 0, "up").otherwise("down").alias("direction")]


def trend(panel: DataFrame) -> DataFrame:
    """(series_id, slope, r2, direction) of the least-squares line over position."""
    return per_series(panel, *_trend_aggregates()).select("series_id", *_trend_columns())


def anomaly_bounds(panel: DataFrame, k: float = 1.5) -> DataFrame:
    """(series_id, n, iqr, lo, hi): IQR fences of series with at least 4 points and a positive IQR."""
    q = exact_quantiles(panel, "y", {"q1": 0.25, "q3": 0.75}).withColumn("iqr", F.col("q3") - F.col("q1"))
    return q.where((F.col("n") >= 4) & (F.col("iqr") > 0)).select(
        "series_id", "n", "iqr", (F.col("q1") - k * F.col("iqr")).alias("lo"), (F.col("q3") + k * F.col("iqr")).alias("hi")
    )


def anomalies(panel: DataFrame, k: float = 1.5) -> DataFrame:
    """Points outside the fences of their series."""
    return attach(panel, anomaly_bounds(panel, k)).where((F.col("y") < F.col("lo")) | (F.col("y") > F.col("hi")))


# Advice per anomaly type (fixed values).
HANDLING = {
    "spike": "Validate event drivers and cap/clip if this is an external shock.",
    "dip": "Check data gaps and business outages before retraining.",
    "shift": "Evaluate regime change and retrain with a recent window.",
    "trend_break": "Review structural change assumptions and segment the series if needed.",
}


def anomaly_records(panel: DataFrame, k: float = 1.5) -> DataFrame:
    """(series_id, pos, type, severity, value, range_start, range_end, handling) per anomaly."""
    y, lo, hi, iqr = F.col("y"), F.col("lo"), F.col("hi"), F.col("iqr")
    marked = attach(panel.select("series_id", "pos", "n", "y"), anomaly_bounds(panel, k)).withColumn("_x", (y < lo) | (y > hi))
    ctx = framed(
        marked,
        lambda w: {
            "_px": F.coalesce(F.lag("_x", 1).over(w), F.lit(False)),
            "_nx": F.coalesce(F.lead("_x", 1).over(w), F.lit(False)),
            "_py": F.coalesce(F.lag("y", 1).over(w), y),
            "_ny": F.coalesce(F.lead("y", 1).over(w), y),
        },
        back=1,
        fwd=1,
    ).where("_x")
    before, after = y - F.col("_py"), F.col("_ny") - y
    turn = (before * after < 0) & ((F.abs(before) > iqr) | (F.abs(after) > iqr))
    kind = (
        F.when(F.col("_px") | F.col("_nx"), "shift")
        .when(turn, "trend_break")
        .when(y > hi, "spike")
        .when(y < lo, "dip")
        .otherwise("trend_break")
    )
    far = F.greatest(F.when(y > hi, y - hi).otherwise(lo - y), F.lit(0.0)) / iqr
    advice = F.create_map(*[F.lit(x) for kv in HANDLING.items() for x in kv])
    return ctx.select(
        "series_id",
        "pos",
        kind.alias("type"),
        F.when(far >= 2, "high").when(far >= 1, "medium").otherwise("low").alias("severity"),
        y.alias("value"),
        F.greatest(F.col("pos") - 1, F.lit(0)).alias("range_start"),
        F.least(F.col("n") - 1, F.col("pos") + 1).alias("range_end"),
        advice[kind].alias("handling"),
    )


def _half_aggregates() -> list[Column]:
    first = F.col("pos") < F.floor(F.col("n") / 2)
    a, b = F.when(first, F.col("y")), F.when(~first, F.col("y"))
    return [
        F.avg(a).alias("mean_1"), F.avg(b).alias("mean_2"), F.var_pop(a).alias("var_1"), F.var_pop(b).alias("var_2"),
        F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"),
    ]


def _stationary() -> Column:
    shift = F.abs(F.col("mean_1") - F.col("mean_2")) / F.greatest(F.abs("mean"), "sd", F.lit(1.0))
    calm = (shift <= 0.25) & (variance_ratio(F.col("var_1"), F.col("var_2")) <= 2.5)
    return F.when(F.col("n") >= MIN_STATIONARY_POINTS, calm).alias("stationary")


def split_halves(panel: DataFrame) -> DataFrame:
    """Means and variances of the first floor(n/2) points and the rest, and of the whole."""
    return per_series(panel, *_half_aggregates())


def stationarity(panel: DataFrame) -> DataFrame:
    """(series_id, stationary): small mean shift and variance ratio between halves; NULL below 8 points."""
    return split_halves(panel).select("series_id", _stationary())


def data_quality(panel: DataFrame, scores: DataFrame) -> DataFrame:
    """(series_id, quality) = 0.50 completeness + 0.35 regularity + 0.15 timestamp uniqueness.

    `scores` is (series_id, regularity).
    """
    per_ts = panel.groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("c"), F.count("y").alias("v"))
    s = per_ts.groupBy("series_id").agg(
        F.sum("c").alias("len"), F.sum("v").alias("values"), F.sum(F.when(F.col("ts").isNotNull(), F.col("c"))).alias("stamps"),
        F.count(F.lit(1)).alias("unique"),
    )
    score = (
        0.50 * (F.col("values") + F.col("stamps")) / (2 * F.col("len"))
        + 0.35 * clip("regularity")
        + 0.15 * F.col("unique") / F.col("len")
    )
    return s.join(scores, "series_id").select("series_id", F.round(clip(score), 6).alias("quality"))


def analyze(
    panel: DataFrame, max_points: int | None = None, max_lag: int = 365, top_k: int = 3, iqr_k: float = 1.5
) -> DataFrame:
    """One row per series with every analysis result and its warnings, from all rows.

    `max_points` makes trend, season, stationarity and quality work on a stride sample of longer series, and says so.
    The anomalous points themselves are rows of `anomaly_records`; here they are counted.
    """
    freq = detect_frequency(panel)
    if max_points is None:
        sampled = panel.withColumn("_n", F.col("n"))
    else:
        sampled = downsample(panel, max_points).drop("pos").withColumnsRenamed({"n": "_n", "k": "pos", "m": "n"})
    marks = anomalies(panel, iqr_k).groupBy("series_id").agg(F.count(F.lit(1)).alias("anomalies"))
    shape = per_series(sampled.withColumn("_full", F.col("_n")), F.max("_full").alias("_full"), *_trend_aggregates(), *_half_aggregates())
    shape = shape.select("series_id", F.col("_full"), *_trend_columns(), _stationary()).withColumnRenamed("_full", "n")
    out = (
        shape.join(freq, "series_id")
        .join(seasonality(sampled, max_lag, top_k), "series_id")
        .join(marks, "series_id", "left")
        .join(data_quality(sampled, freq.select("series_id", "regularity")), "series_id")
    )
    n = F.col("n")
    warnings = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(n > (max_points or 2**62), F.format_string("series downsampled from %d points for analysis", n)),
                F.when(n < 3, F.lit("insufficient valid timestamps for frequency detection")),
                F.when(F.col("frequency") == "irregular", F.lit("timestamps are irregular")),
                F.when(n < MIN_SEASONAL_POINTS, F.lit("insufficient points for seasonality detection")),
                F.when(n < 2, F.lit("insufficient points for trend detection")),
                F.when(n < 4, F.lit("insufficient points for anomaly detection")),
                F.when(n < MIN_STATIONARY_POINTS, F.lit("insufficient points for stationarity detection")),
            )
        )
    )
    return out.withColumns(
        {"anomalies": F.coalesce("anomalies", F.lit(0)), "warnings": warnings}
    )


def merged_warnings(analysis: DataFrame) -> DataFrame:
    """Distinct "series: warning" lines of all series."""
    lines = analysis.select("series_id", F.explode("warnings").alias("w"))
    return lines.select(F.concat("series_id", F.lit(": "), "w").alias("warning")).distinct()
