"""Cleaning: validation, duplicate collapse, regular grids and gap filling.

Problems never abort a job: a series that breaks a rule shows up in a violations DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.functions.freq import require_known, steps_between, steps_from
from tidepanel.functions.numeric import finite
from tidepanel.operators.blocks import BLOCK_ROWS, KEY, attach, framed, nearest_valid, per_series

# Default limits of series validation and of gap filling (fixed values).
MISSING_RATIO_MAX = 0.30
MAX_GAP = 24


def normalize_ids(df: DataFrame, column: str = "series_id", default: str = "series_0") -> DataFrame:
    """Trim ids; blank and NULL become the default id."""
    text = F.trim(F.col(column).cast("string"))
    return df.withColumn(column, F.coalesce(F.when(text != "", text), F.lit(default)))


def drop_null_targets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a target, violations for series without any)."""
    bad = df.groupBy("series_id").agg(F.count("y").alias("c")).where("c = 0")
    return df.where(F.col("y").isNotNull()), bad.select("series_id", F.lit("target column contains only null values").alias("reason"))


def check_target(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Numeric targets as `y`, and a violation per non-numeric or boolean text value with its row index."""
    text = F.trim(F.col(raw).cast("string"))
    is_bool = F.lower(text).isin("true", "false")
    value = finite(F.when(~is_bool, text).try_cast("double"))
    reason = F.when(is_bool, F.lit("target contains boolean value")).when(
        text.isNotNull() & value.isNull(), F.lit("target contains non-numeric value")
    )
    marked = df.withColumns({"y": value, "_reason": reason})
    good = marked.where(F.col("_reason").isNull()).drop("_reason")
    bad = marked.where(F.col("_reason").isNotNull()).select("series_id", "pos", F.col("_reason").alias("reason"))
    return good, bad


def collapse_duplicates(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per (series, ts): mean of the non-null targets, with the number of rows merged away."""
    return df.groupBy(*keys, "ts").agg(
        F.avg("y").alias("y"), (F.count(F.lit(1)) - 1).alias("merged"), (F.count(F.lit(1)) - F.count("y")).alias("nulls")
    )


def keep_first(df: DataFrame, order: str, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per (series, ts): the one that came first in `order`."""
    rest = [c for c in df.columns if c not in (*keys, "ts")]
    picked = df.groupBy(*keys, "ts").agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "ts", "_r.*")


def missing_runs(panel: DataFrame, value: str = "y") -> DataFrame:
    """Longest run of missing points per series (0 if none)."""
    filled = nearest_valid(panel.select("series_id", "pos", "n", value), value)
    run = F.when(F.col(value).isNull(), F.col("pos") - F.coalesce(F.col("prev_pos"), F.lit(-1)))
    return filled.groupBy("series_id").agg(F.coalesce(F.max(run), F.lit(0)).cast("long").alias("max_gap"))


def validate_series(
    panel: DataFrame,
    missing_ratio_max: float = MISSING_RATIO_MAX,
    max_gap: int | None = MAX_GAP,
    min_length: int | None = None,
) -> DataFrame:
    """(series_id, ok, reasons) with every rule a series breaks."""
    raw = F.col("y")
    infinite = F.abs(raw) == F.lit(float("inf"))
    valid = F.when(~F.isnan(raw), raw)
    steps = framed(
        panel.withColumns({"_inf": infinite, "_v": valid}),
        lambda w: {"_gap": F.col("ts") > F.lag("ts", 1).over(w), "_prev": F.lag("ts", 1).over(w)},
        back=1,
    )
    stats = per_series(
        steps,
        F.count_if(F.col("_prev").isNotNull() & ~F.col("_gap")).alias("bad_steps"),
        F.count_if("_inf").alias("infinite"),
        F.count("_v").alias("valid"),
        F.stddev_pop("_v").alias("sd"),
    )
    gaps = missing_runs(panel.withColumn("y", valid))
    s = stats.join(gaps, "series_id")
    ratio = 1 - F.col("valid") / F.col("n")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("bad_steps") > 0, F.lit("timestamps must be strictly increasing")),
            F.when(F.col("infinite") > 0, F.lit("target contains Inf/-Inf")),
            F.when(
                (F.col("valid") > 0) & (ratio > missing_ratio_max),
                F.format_string(f"target missing ratio %.4f exceeds limit {missing_ratio_max:.4f}", ratio),
            ),
            F.when(
                F.col("max_gap") > (max_gap if max_gap is not None else 2**62),
                F.format_string(f"target max missing gap %d exceeds limit {max_gap}", F.col("max_gap")),
            ),
            F.when(F.col("valid") == 0, F.lit("target has no valid numeric values")),
            F.when((F.col("valid") > 0) & (F.col("sd") == 0), F.lit("target is constant (zero variance)")),
            F.when(
                F.col("n") < (min_length or 0), F.format_string(f"series length %d is below minimum {min_length}", F.col("n"))
            ),
        )
    )
    return s.select("series_id", (F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"))


# ---- regular grid ----------------------------------------------------------------------------


def alias_of(freq: str | None) -> Column | str:
    """The alias, or the column `freq` of the rows where each series has its own. An unknown alias fails here."""
    return F.col("freq") if freq is None else require_known(freq)


def add_steps(ts: Column, count: Column, freq: str | None) -> Column:
    """ts plus `count` steps of the frequency (None: of the column `freq`); calendar units keep to the calendar."""
    return steps_from(ts, count, alias_of(freq))


def grid(bounds: DataFrame, freq: str | None) -> DataFrame:
    """Regular grid (series_id, ts, pos, n) from per-series `lo` and `hi` timestamps (None: and `freq`).

    The grid is generated chunk by chunk, so a long series is neither one array nor one task. It starts at the first
    timestamp of the frequency at or after `lo`; a series whose alias is not known has no grid.
    """
    alias = alias_of(freq)
    start = steps_from(F.col("lo"), F.lit(0), alias)
    lo = F.when(start < F.col("lo"), steps_from(F.col("lo"), F.lit(1), alias)).otherwise(start)
    own = [] if freq is not None else ["freq"]
    n = (steps_between(F.col("lo"), F.col("hi"), alias) + 1).cast("long")
    chunks = (
        bounds.select("series_id", *own, lo.alias("lo"), "hi")
        .where(F.col("lo") <= F.col("hi"))
        .select("series_id", *own, "lo", n.alias("n"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(BLOCK_ROWS)))))
        .repartition("series_id", "_c")
    )
    pos = F.explode(
        F.sequence(F.col("_c") * BLOCK_ROWS, F.least((F.col("_c") + 1) * BLOCK_ROWS, F.col("n")) - 1)
    )
    return chunks.select("series_id", *own, "lo", "n", pos.alias("pos")).select(
        "series_id", steps_from(F.col("lo"), F.col("pos"), alias).alias("ts"), "pos", "n"
    )


def regularize(df: DataFrame, freq: str | None) -> DataFrame:
    """Panel on the regular grid from first to last observation; holes have NULL `y`, `observed` is false.

    `df` holds one row per (series, ts) with a target and, with `freq` None, the alias of its series in the column `freq`.
    Observations beside the grid are left out; `off_grid` counts them.
    """
    own = [] if freq is not None else [F.first("freq", True).alias("freq")]
    bounds = df.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), *own)
    seen = df.select("series_id", "ts", "y", F.lit(True).alias("observed"))
    return (
        grid(bounds, freq)
        .join(seen, ["series_id", "ts"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(False)))
    )


def off_grid(df: DataFrame, regular: DataFrame) -> DataFrame:
    """(series_id, off_grid, reason): series with observations that are not on their grid, or without any grid."""
    have = df.groupBy("series_id").agg(F.count(F.lit(1)).alias("_rows"))
    met = regular.groupBy("series_id").agg(F.count_if("observed").alias("_met"))
    lost = F.col("_rows") - F.coalesce("_met", F.lit(0))
    out = have.join(met, "series_id", "left").select("series_id", lost.alias("off_grid")).where("off_grid > 0")
    return out.withColumn("reason", F.format_string("%d observations are not on the grid of the frequency", F.col("off_grid")))


# ---- imputation ------------------------------------------------------------------------------


def forward_fill(panel: DataFrame) -> DataFrame:
    """Last valid value; leading gaps stay."""
    return _with_y(nearest_valid(panel), F.col("prev_y"))


def backward_fill(panel: DataFrame) -> DataFrame:
    """Next valid value; trailing gaps stay."""
    return _with_y(nearest_valid(panel), F.col("next_y"))


def fill_edges(panel: DataFrame) -> DataFrame:
    """Leading and trailing gaps take the nearest valid value."""
    inner = F.when(F.col("prev_pos").isNull(), F.col("next_y")).when(F.col("next_pos").isNull(), F.col("prev_y"))
    return _with_y(nearest_valid(panel), F.coalesce("y", inner))


def linear(panel: DataFrame) -> DataFrame:
    """Straight line between neighbours on position, nearest value at the edges."""
    slope = (F.col("next_y") - F.col("prev_y")) / (F.col("next_pos") - F.col("prev_pos"))
    between = F.when(
        F.col("prev_pos").isNotNull() & F.col("next_pos").isNotNull(),
        slope * (F.col("pos") - F.col("prev_pos")) + F.col("prev_y"),
    )
    return _with_y(nearest_valid(panel), F.coalesce("y", between, "prev_y", "next_y"))


def seasonal(panel: DataFrame, period: int) -> DataFrame:
    """Mean of the valid values in the same phase, remaining holes linear; period < 2 is linear."""
    if period < 2:
        return linear(panel)
    phased = panel.withColumn("_ph", F.col("pos") % period)
    means = phased.groupBy("series_id", "_ph").agg(F.max("n").alias("n"), F.avg("y").alias("_m"))
    spread = attach(phased, means, extra=["_ph"], how="left")
    return linear(_with_y(spread.drop("_ph"), F.coalesce("y", "_m"), ("_m",)))


_TRAIL = ("prev_pos", "prev_y", "next_pos", "next_y")


def _with_y(df: DataFrame, y: Column, extra: Sequence[str] = ()) -> DataFrame:
    return df.withColumn("y", y).drop(*_TRAIL, *extra)


def impute(panel: DataFrame, method: str = "linear", period: int = 7) -> DataFrame:
    """Fill holes by name: forward_fill, backward_fill, linear, seasonal or cubic."""
    if method == "forward_fill":
        return forward_fill(panel)
    if method == "backward_fill":
        return backward_fill(panel)
    if method == "linear":
        return linear(panel)
    if method == "seasonal":
        return seasonal(panel, period)
    if method == "cubic":
        from tidepanel.operators.spline import cubic

        return cubic(panel)
    raise ValueError(f"unknown imputation method {method!r}")


def regularize_and_impute(
    df: DataFrame,
    freq: str | None,
    method: str = "auto",
    period: int = 7,
    max_missing_ratio: float = MISSING_RATIO_MAX,
    max_gap: int | None = None,
    edge: str = "nearest",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Duplicate collapse, grid, limits, edges and gaps: (panel, diagnostics, violations).

    `auto` and `bspline` interpolate cubically where a series has at least 4 valid points, else linearly. With `freq` None
    every series takes the frequency that `ingest_frequency` finds for it; series without a usable one, and series with
    observations beside their grid, are violations.
    """
    if freq is None:
        from tidepanel.operators.analysis import ingest_frequency
        from tidepanel.operators.blocks import number_rows

        known = ingest_frequency(number_rows(collapse_duplicates(df).drop("merged")), imputing=True)
        df = df.join(known.select("series_id", F.col("frequency").alias("freq")), "series_id", "left")
    raw = df.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("original_rows"), (F.count(F.lit(1)) - F.count("y")).alias("raw_nulls")
    )
    flat = collapse_duplicates(df)
    if freq is None:
        flat = flat.join(df.groupBy("series_id").agg(F.first("freq", True).alias("freq")), "series_id")
    merged = flat.groupBy("series_id").agg(F.sum("merged").alias("collapsed"))
    reg = regularize(flat, freq)
    ends = nearest_valid(reg)
    run = F.when(F.col("y").isNull(), F.col("pos") - F.coalesce(F.col("prev_pos"), F.lit(-1)))
    shape = ends.groupBy("series_id").agg(
        F.max("n").alias("regular_rows"),
        F.count_if(~F.col("observed")).alias("missing_timestamps"),
        F.count_if(F.col("y").isNull()).alias("imputed"),
        F.coalesce(F.max(run), F.lit(0)).cast("long").alias("max_gap"),
        F.count_if(F.col("prev_pos").isNull() | F.col("next_pos").isNull()).alias("edge_rows"),
        F.count("y").alias("valid"),
    )
    d = raw.join(merged, "series_id").join(shape, "series_id").withColumn(
        "missing_ratio", F.col("imputed") / F.col("regular_rows")
    )
    cubic_ok = (F.col("valid") + F.col("edge_rows")) >= 4
    inner_holes = F.col("imputed") > F.col("edge_rows")
    used = F.when(F.col("imputed") == 0, "none").when(~inner_holes, "nearest")
    if method in ("auto", "bspline"):
        used = used.when(cubic_ok, "bspline").otherwise("linear")
    else:
        used = used.otherwise(method)
    reason = F.when(F.col("valid") == 0, F.lit("target column contains only null values")).when(
        F.col("missing_ratio") > max_missing_ratio,
        F.format_string(f"target missing ratio %.4f exceeds limit {max_missing_ratio:.4f}", F.col("missing_ratio")),
    )
    if max_gap is not None:
        reason = reason.when(
            F.col("max_gap") > max_gap, F.format_string(f"target max missing gap %d exceeds limit {max_gap}", F.col("max_gap"))
        )
    if edge == "reject":
        reason = reason.when(F.col("edge_rows") > 0, F.lit("target contains leading or trailing missing values"))
    d = d.withColumns({"used_method": used, "reason": reason})
    beside = off_grid(flat, reg).select("series_id", F.col("reason").alias("beside"))
    d = raw.select("series_id").join(d, "series_id", "left").join(beside, "series_id", "left")
    d = d.withColumn("reason", F.coalesce("beside", "reason")).drop("beside")
    violations = d.where(F.col("reason").isNotNull()).select("series_id", "reason")
    diagnostics = d.where(F.col("reason").isNull()).drop("reason", "edge_rows", "valid")
    kept = attach(
        _with_y(ends, F.coalesce("y", F.when(F.col("prev_pos").isNull(), F.col("next_y")).when(F.col("next_pos").isNull(), F.col("prev_y")))),
        diagnostics.select("series_id", F.col("regular_rows").alias("n"), "used_method"),
    )
    if method in ("auto", "bspline"):
        panel = impute(kept.where("used_method = 'bspline'"), "cubic").unionByName(linear(kept.where("used_method <> 'bspline'")))
    else:
        panel = impute(kept, method, period)
    return panel.drop("used_method"), diagnostics, violations
