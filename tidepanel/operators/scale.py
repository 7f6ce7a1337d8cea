"""Scalers and invertible transforms: `fit` gives a parameter row per series, `apply`/`invert` use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.blocks import attach, framed, per_series, running_sum


class Standard:
    """(y - mean) / population deviation; a zero deviation counts as 1."""

    params = ("mean", "sd")

    def fit(self, panel: DataFrame) -> DataFrame:
        sd = F.stddev_pop("y")
        return per_series(panel, F.avg("y").alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"))

    def forward(self, y: Column) -> Column:
        return (y - F.col("mean")) / F.col("sd")

    def backward(self, z: Column) -> Column:
        return z * F.col("sd") + F.col("mean")


class MinMax:
    """(y - min) / (max - min); a zero range counts as 1."""

    params = ("lo", "range")

    def fit(self, panel: DataFrame) -> DataFrame:
        width = F.max("y") - F.min("y")
        return per_series(panel, F.min("y").alias("lo"), F.when(width == 0, F.lit(1.0)).otherwise(width).alias("range"))

    def forward(self, y: Column) -> Column:
        return (y - F.col("lo")) / F.col("range")

    def backward(self, z: Column) -> Column:
        return z * F.col("range") + F.col("lo")


SCALERS = {"standard": Standard, "minmax": MinMax}


def build(name: str):
    """Scaler by name; None for "none"."""
    if name == "none":
        return None
    if name not in SCALERS:
        raise ValueError(f"unknown scaler {name!r}")
    return SCALERS[name]()


def fit(panel: DataFrame, scaler, where: Column | None = None) -> DataFrame:
    """Parameters from the rows selected by `where` (e.g. the training split), with the full length `n`."""
    return scaler.fit(panel if where is None else panel.where(where))


def apply(panel: DataFrame, scaler, params: DataFrame, column: str = "y", out: str = "scaled") -> DataFrame:
    joined = attach(panel, params)
    return joined.withColumn(out, scaler.forward(F.col(column))).drop(*scaler.params)


def invert(panel: DataFrame, scaler, params: DataFrame, column: str = "scaled", out: str = "restored") -> DataFrame:
    joined = attach(panel, params)
    return joined.withColumn(out, scaler.backward(F.col(column))).drop(*scaler.params)


def difference(panel: DataFrame) -> DataFrame:
    """First differences with the first value kept as the anchor."""
    return framed(panel, lambda w: {"diff": F.col("y") - F.lag("y", 1).over(w)}, back=1)


def undifference(panel: DataFrame, firsts: DataFrame) -> DataFrame:
    """Cumulative sum of `diff` plus the first value (`first_y` per series)."""
    summed = running_sum(panel, "diff", "_cum")
    return attach(summed, firsts).withColumn("restored", F.col("_cum") + F.col("first_y")).drop("_cum")


def log_forward(y: Column) -> Column:
    """log1p; negative values are NULL (rejected)."""
    return F.when(y >= 0, F.log1p(y))


def log_backward(z: Column) -> Column:
    return F.expm1(z)
