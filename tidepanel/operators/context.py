"""Model-side context preparation: truncation, padding, masks and repair of model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.numeric import finite
from tidepanel.operators.blocks import per_series
from tidepanel.operators.clean import add_steps


def clean_values_and_mask(panel: DataFrame) -> DataFrame:
    """`value` with non-finite points as 0, and `valid` telling which were real."""
    good = finite("y")
    return panel.withColumns({"value": F.coalesce(good, F.lit(0.0)), "valid": good.isNotNull()})


def _own(freq: str | None) -> list:
    """The alias of each series, where it has its own in the column `freq`."""
    return [] if freq is not None else [F.first("freq", True).alias("freq")]


def left_pad(panel: DataFrame, length: int, freq: str | None) -> DataFrame:
    """Short series get their first value in front, with back-dated timestamps, up to `length` rows."""
    short = per_series(panel, F.min_by("ts", "pos").alias("ts0"), F.min_by("y", "pos").alias("y0"), *_own(freq)).where(F.col("n") < length)
    missing = F.lit(length) - F.col("n")
    rows = short.select("*", F.explode(F.sequence(F.lit(1).cast("long"), missing)).alias("k"))
    pad = rows.select(
        "series_id",
        add_steps(F.col("ts0"), -F.col("k"), freq).alias("ts"),
        F.col("y0").alias("y"),
        (missing - F.col("k")).alias("pos"),
        F.lit(length).cast("long").alias("n"),
        F.lit(True).alias("padded"),
    )
    shift = F.greatest(F.lit(length) - F.col("n"), F.lit(0))
    real = panel.select(
        "series_id", "ts", "y", (F.col("pos") + shift).alias("pos"), (F.col("n") + shift).alias("n"), F.lit(False).alias("padded")
    )
    return real.unionByName(pad)


def repair_non_finite(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """Non-finite means take the last finite history value (else 0); non-finite quantiles the repaired mean."""
    ok = finite("y")
    last = history.groupBy("series_id").agg(F.max_by(ok, F.when(ok.isNotNull(), F.col("pos"))).alias("_last"))
    mean = F.coalesce(finite("mean"), F.col("_last"), F.lit(0.0))
    fixed = forecast.join(last, "series_id", "left").withColumn("mean", mean)
    bands = F.transform_values("quantiles", lambda _, v: F.coalesce(finite(v), F.col("mean")))
    return fixed.withColumn("quantiles", bands).drop("_last")


def limit_series(panel: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the first `count` series by id, one warning row if any series was left out)."""
    ids = panel.select("series_id").distinct()
    kept = ids.orderBy("series_id").limit(count)
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    warning = total.where(F.col("total") > count).select(
        F.format_string(f"input series limited to first {count} of %d", F.col("total")).alias("warning")
    )
    return panel.join(kept, "series_id", "left_semi"), warning


def index_grid(panel: DataFrame, freq: str | None) -> DataFrame:
    """Replace timestamps by first timestamp + position * step (same length)."""
    from tidepanel.operators.blocks import attach

    first = per_series(panel, F.min("ts").alias("_t0"))
    return attach(panel, first).withColumn("ts", add_steps(F.col("_t0"), F.col("pos"), freq)).drop("_t0")


def future_timestamps(panel: DataFrame, horizon: int, freq: str | None) -> DataFrame:
    """(series_id, step, ts) after the last observation; freq None takes the column `freq` of the panel."""
    last = panel.groupBy("series_id").agg(F.max("ts").alias("_t"), *_own(freq))
    rows = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return rows.select("series_id", "step", add_steps(F.col("_t"), F.col("step"), freq).alias("ts"))
